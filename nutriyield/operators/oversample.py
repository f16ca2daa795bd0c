"""SMOTE: synthetic rows between a row of a small class and one of its nearest neighbours.

Every class is filled up to the largest one.  Row i of a class of n rows that lacks
m rows is the seed of floor(m / n) synthetic rows, the m mod n rows with the
smallest hash of one more.  A synthetic row takes one of the k nearest rows of its
class (by squared distance over the columns, then by id) and a point on the line to
it, both chosen by a hash of seed, id and number, so results do not depend on the
partitioning.

Neighbours are exact and need no pairs of rows: rows that agree in all columns are
one cell with its k + 1 smallest ids.  Cells are dealt into ranges of a projection on
a fixed unit vector, and ranges with many cells into parts.  A cell's k-th distance
inside its own part bounds how far its neighbours can lie; a projection never
stretches a distance, so only the ranges within that bound are searched, all of them.
Parts hold a bounded number of cells, and the cells that search a class come in
bounded shares, so no task holds a class.

Rows with a null or NaN in a column or in the label take no part.  A class of a
single row has no neighbour and is not filled up.  Ids must be distinct.
"""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutriyield.operators.verbs import hash_key, rank_cuts
from nutriyield.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package on their path


def unit_vector(d: int, seed: int) -> list[float]:
    g = random.Random(seed)
    w = [g.gauss(0, 1) for _ in range(d)]
    return [x / math.sqrt(sum(y * y for y in w)) for x in w]


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed column by column as SQL would."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j:j + 1] - b[None, :, j]
        out += diff * diff
    return out


def _nearest(far: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    """The k nearest columns of each row, by distance and then first id."""
    by_id = np.argsort(first_id, kind="stable")
    return by_id[np.argsort(far[:, by_id], axis=1, kind="stable")[:, :k]]


def nearest_cells(cells: DataFrame, k: int, seed: int = 1, part_cells: int = 2048, max_ranges: int = 1000, share: int = 16_384, ask_rows: int = 20_000) -> DataFrame:
    """(label, cell, near): the k nearest other cells of each cell's label, as structs (d, first, other).

    ``cells``: label, cell (key), first (smallest id), x (array of doubles).
    """
    d = cells.select(F.max(F.size("x"))).first()[0] or 0
    w = unit_vector(d, seed)
    place = None
    for j, c in enumerate(w):
        e = F.col("x")[j] * F.lit(c)
        place = e if place is None else place + e
    cells = cut_lineage(cells.withColumn("place", place))
    size = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per class
    cuts = {}
    for label, n in size.items():
        ranges = min(max_ranges, -(-n // part_cells))
        q = [i / ranges for i in range(1, ranges)]
        cuts[label] = sorted({*cells.where(F.col("label") == label).approxQuantile("place", q, 0.2 / ranges)}) if q else []

    def with_range(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = pdf["label"].to_numpy()
        at = np.empty(len(pdf), np.int64)
        for label in pd.unique(labels):
            mine = labels == label
            at[mine] = np.searchsorted(cuts[label], pdf["place"].to_numpy()[mine], "right")
        return pdf.assign(at=at)

    schema = "label string, cell string, first string, x array<double>, place double, at long"
    ranged = cells.select("label", "cell", "first", "x", "place").mapInPandas(lambda parts: map(with_range, parts), schema)
    # at most max_ranges rows a class
    spans = {(r["label"], r["at"]): (r["lo"], r["hi"], -(-r["n"] // part_cells))
             for r in ranged.groupBy("label", "at").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("n")).collect()}
    by_label: dict[str, list] = {}
    for (label, at), (lo, hi, parts) in sorted(spans.items()):
        by_label.setdefault(label, []).append((at, lo, hi, parts))
    shares = {label: -(-n // share) for label, n in size.items()}
    parts_of = F.create_map(*[F.lit(v) for (label, at), (_, _, n) in spans.items() for v in (f"{at}|{label}", n)]) if len(spans) < 64 else None
    if parts_of is None:
        spark = cells.sparkSession
        table = spark.createDataFrame([(label, at, n) for (label, at), (_, _, n) in spans.items()], "label string, at long, parts int")
        dealt = ranged.join(F.broadcast(table), ["label", "at"])  # at most max_ranges rows a class
    else:
        dealt = ranged.withColumn("parts", parts_of[F.concat_ws("|", F.col("at").cast("string"), "label")])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cell"), F.col("parts").cast("long"))).drop("parts")

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        limit = np.full(len(x), np.inf)
        for i in range(0, len(x), 512):
            far = squared_distances(x[i:i + 512], x)
            far[np.arange(len(far)), i + np.arange(len(far))] = np.inf
            if len(x) > k:
                limit[i:i + 512] = np.sqrt(np.partition(far, k - 1, axis=1)[:, k - 1])
        return pdf[["label", "cell", "first", "x", "place"]].assign(limit=limit)

    bounded = dealt.groupBy("label", "at", "part").applyInPandas(bound, "label string, cell string, first string, x array<double>, place double, limit double")

    def asks(pdf, rows, at, part):
        out = pdf.iloc[rows][["label", "cell", "x"]].assign(at=at, part=part)
        return out.assign(share=pd.util.hash_array(out["cell"].to_numpy(dtype=object), categorize=False) % np.array([shares[v] for v in out["label"]], np.uint64))

    def ask(batches):
        for pdf in batches:
            rows, at, part = [], [], []
            for i, (label, place, limit) in enumerate(zip(pdf["label"], pdf["place"], pdf["limit"])):
                slack = limit * (1 + 1e-9) + 1e-9 * abs(place)
                for a, lo, hi, parts in by_label[label]:
                    if lo <= place + slack and hi >= place - slack:
                        rows += [i] * parts
                        at += [a] * parts
                        part += range(parts)
                if len(rows) >= ask_rows:  # a cell may ask many ranges
                    yield asks(pdf, rows, at, part)
                    rows, at, part = [], [], []
            yield asks(pdf, rows, at, part)

    asked = bounded.mapInPandas(ask, "label string, cell string, x array<double>, at long, part long, share long")
    copies = F.create_map(*[F.lit(v) for label, n in shares.items() for v in (label, n)])
    held = dealt.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), copies[F.col("label")].cast("long") - 1)))

    def search(mine: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(there):
            x, y = np.stack(mine["x"].to_numpy()), np.stack(there["x"].to_numpy())
            cell, first, own = there["cell"].to_numpy(), there["first"].to_numpy(), mine["cell"].to_numpy()
            for i in range(0, len(x), 512):
                far = squared_distances(x[i:i + 512], y)
                far[own[i:i + 512, None] == cell[None, :]] = np.inf
                top = _nearest(far, first, k)
                row = np.repeat(np.arange(len(far)), top.shape[1])
                out.append(pd.DataFrame({"label": mine["label"].iloc[0], "cell": own[i:i + 512][row], "d": far[row, top.ravel()],
                                         "first": first[top.ravel()], "other": cell[top.ravel()]}))
        found = pd.concat(out) if out else pd.DataFrame(columns=["label", "cell", "d", "first", "other"])
        return found[np.isfinite(found["d"].astype(float))]

    keys = ["label", "at", "part", "share"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "label string, cell string, d double, first string, other string")
    order = F.row_number().over(Window.partitionBy("label", "cell").orderBy("d", "first"))  # k rows a part
    return found.withColumn("pos", order).where(F.col("pos") <= k).drop("pos")


def hash_unit(*parts) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def smote(df: DataFrame, label: str, cols: Sequence[str], id_col: str, k: int = 5, seed: int = 1, **sizes) -> DataFrame:
    """The synthetic rows: (id of the seed row, number, id of its neighbour, label, columns)."""
    cols = list(cols)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    rows = df.select(F.col(label).cast("string").alias("label"), F.col(id_col).cast("string").alias("id"), x.alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = cut_lineage(rows.withColumn("cell", F.md5(F.to_json("x"))))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per class
    top = max(counts.values(), default=0)
    lack = {c: top - n for c, n in counts.items() if 1 < n < top}
    out = f"`{id_col}` string, number int, neighbour string, `{label}` string, " + ", ".join(f"`{c}` double" for c in cols)
    if not lack:
        return df.sparkSession.createDataFrame([], out)
    small = rows.where(F.col("label").isin(*lack))
    # one cell per distinct point, with its k + 1 smallest ids (limited before the shuffle)
    nth = F.row_number().over(Window.partitionBy("label", "cell").orderBy("id"))
    cells = small.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("label", "cell") \
        .agg(F.min("id").alias("first"), F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids"))
    cells = cut_lineage(cells)
    near = nearest_cells(cells.drop("ids"), k, seed, **sizes)
    other = cells.select(F.col("label"), F.col("cell").alias("other"), F.col("x").alias("ox"), "ids")
    close = near.join(other, ["label", "other"]).select("label", "cell", F.explode("ids").alias("id"), "d", F.col("ox").alias("x"))
    own = cells.select("label", "cell", F.explode("ids").alias("id"), F.lit(0.0).alias("d"), "x")
    # at most (k + 1) squared candidates a cell, of which k + 1 can matter
    both = close.unionByName(own).withColumn("pos", F.row_number().over(Window.partitionBy("label", "cell").orderBy("d", "id"))).where(F.col("pos") <= k + 1)
    lists = both.groupBy("label", "cell").agg(F.array_sort(F.collect_list(F.struct("d", "id", "x"))).alias("near"))
    # how many synthetic rows each row seeds
    ranked = small.withColumn("h", hash_key(seed, "id"))
    ranks = df.sparkSession.createDataFrame([(c, m % counts[c]) for c, m in lack.items()], "label string, __rank long")
    whole = F.create_map(*[F.lit(v) for c, m in lack.items() for v in (c, m // counts[c])])
    cut = rank_cuts(ranked, ["label"], ranks, "h", ["id"])
    seeds = ranked.join(F.broadcast(cut), "label", "left")  # one row per class
    more = F.coalesce((F.struct("h", "id") <= F.col("__cut")).cast("int"), F.lit(0))
    seeds = seeds.withColumn("m", whole[F.col("label")] + more).where(F.col("m") > 0)
    made = seeds.join(lists, ["label", "cell"]).withColumn("number", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    made = made.withColumn("near", F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, k))
    pick = F.floor(hash_unit(f"{seed}n", "id", "number") * F.size("near")).cast("int")
    made = made.withColumns({"to": F.col("near")[pick], "u": hash_unit(f"{seed}u", "id", "number")})
    return made.select(F.col("id").alias(id_col), "number", F.col("to")["id"].alias("neighbour"), F.col("label").alias(label),
                       *[(F.col("x")[j] + F.col("u") * (F.col("to")["x"][j] - F.col("x")[j])).alias(c) for j, c in enumerate(cols)])
