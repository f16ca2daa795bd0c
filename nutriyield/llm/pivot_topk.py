"""Exact top-k inner products by a Voronoi kNN join.

Vectors become integers ``floor(scale * x)``.  Pivots (a bounded number of query
vectors) cut queries and data into Voronoi cells.  Summaries give every query cell
i its radius ``U_i`` about its pivot, and every data cell its radius; since
``|q.s - p_i.s| <= U_i |s|``, the (k+1)-th best ``p_i.s - U_i |s|`` over rows of
different ids bounds the k-th best score of all the cell's queries from below.
A data row goes only to groups of query cells in which ``p_i.s + U_i |s|`` reaches
that bound, after whole data cells that cannot reach it are passed over.  Groups
and their rows meet in tiles of bounded size, each solved by matrix products; the
best k of a query's tiles are merged.  Bounds are widened by rounding slack, scores
are exact.

Defined cases: rows whose vector is null, empty, of another length than most, or
holds a null or non-finite entry take no part.  Rows with the query's id are its own
and no candidates.  Repeated candidate rows count one by one; a repeated query row is
answered each time.  Ties go to the smaller id, a null id (never a query) comes last
and is returned as null.  With fewer than k candidates all are returned; no queries
or no rows: no output.  Other columns are ignored.  Scores must fit a long (an error
says so).

Moves: queries once per tile column, data rows once per group that needs them.
Collected: pivots and the summaries of their cells (at most ``max_pivots``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutriyield.llm.common import mix, shared_table
from nutriyield.llm.vectors import exact_products, matrix, pieces, usable

NO_ID = 2**63 - 1
RESULT = "query_id long, rank int, vec_id long, score long"


class Cells:
    """Pivots, and what the summaries tell of their query and data cells."""

    def __init__(self, pivots: np.ndarray, scale: int, kind: str):
        self.pivots, self.scale, self.kind = pivots, scale, kind
        self.squares = (pivots * pivots).sum(1)
        p = len(pivots)
        self.radius, self.bound = np.full(p, -1.0), np.full(p, -np.inf)  # of queries; radius -1: no query
        self.reach = np.full(p, -1.0)  # of data rows

    def whole(self, vectors: np.ndarray) -> np.ndarray:
        return np.floor(vectors * self.scale).astype(np.int64)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(products with the pivots, nearest pivot, distance to it, length) of integer rows."""
        products, squares = exact_products(x, self.pivots), (x * x).sum(1)
        far = self.squares - 2 * products
        cell = far.argmin(1)
        away = np.sqrt(np.maximum(far[np.arange(len(x)), cell] + squares, 0).astype(np.float64))
        return products.astype(np.float64), cell, away, np.sqrt(squares.astype(np.float64))

    def lowest(self, products: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a row scores at least with every query of a cell."""
        spread = self.radius * length[:, None]
        return products - spread - 1e-9 * (np.abs(products) + spread + 1)

    def meet(self) -> np.ndarray:
        """(query cell, data cell): can any of their pairs reach the query cell's bound?"""
        p = exact_products(self.pivots, self.pivots).astype(np.float64)
        size = np.sqrt(self.squares.astype(np.float64))
        top = p + np.outer(self.radius, size) + np.outer(size, self.reach) + np.outer(self.radius, self.reach)
        return (top + 1e-9 * (np.abs(top) + 1) >= self.bound[:, None]) & (self.radius >= 0)[:, None] & (self.reach >= 0)[None, :]

    def needed(self, products: np.ndarray, cell: np.ndarray, length: np.ndarray, meet: np.ndarray) -> np.ndarray:
        """(row, query cell): may the row be among the best k of a query of the cell?"""
        spread = self.radius * length[:, None]
        top = products + spread
        return (top + 1e-9 * (np.abs(products) + spread + 1) >= self.bound) & meet[:, cell].T


def chain(pivots: np.ndarray) -> list[int]:
    """Pivots in an order that keeps near ones together (each next one is the nearest left)."""
    left, at, out = set(range(1, len(pivots))), 0, [0]
    far = pivots.astype(np.float64)
    while left:
        rest = sorted(left)
        at = rest[int(((far[rest] - far[at]) ** 2).sum(1).argmin())]
        left.remove(at)
        out.append(at)
    return out


def best_of_tile(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of the k best columns of each row of ``scores``; columns come in order of their ids."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = (a.ravel() for a in np.indices(scores.shape))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def top_products(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
                 max_pivots: int = 1024, group_queries: int = 65_536, tile_rows: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row that ``is_query`` marks."""
    spark = df.sparkSession
    rows, d = usable(df.withColumn("__query", F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False))), id_col, vector_col, "__query")
    if not d:
        return spark.createDataFrame([], RESULT)
    rows = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), "vector", "__query")
    size = rows.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("top"), F.count_if("__query").alias("q")).first()
    if not size["q"]:
        return spark.createDataFrame([], RESULT)
    top = int(size["top"] * scale) + 1
    if 4 * d * top * top >= 1 << 63:
        raise ValueError(f"components up to {size['top']}: their scores need not fit a long")
    kind = "<i2" if top < 1 << 15 else "<i8"

    # pivots: some of the queries, by hash
    count = min(max_pivots, math.isqrt(size["q"] - 1) + 1)
    picked = rows.where("__query").orderBy(F.xxhash64("id", "vector"), "id", "vector").limit(count).collect()
    cells = Cells(np.floor(np.array([r["vector"] for r in picked], np.float64) * scale).astype(np.int64), scale, kind)

    # queries with their cells, kept in a scratch table
    def place_queries(batches):
        for piece in pieces(batches):
            x = cells.whole(matrix(piece.column("vector"), d))
            _, cell, away, _ = cells.place(x)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(cell, pa.int32()), pa.array(away), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())],
                                             names=["id", "cell", "away", "code"])

    queries = rows.where("__query").select("id", "vector").mapInArrow(place_queries, "id long, cell int, away double, code binary")
    queries = shared_table(queries.withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    per_cell = {r["cell"]: r for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}  # at most max_pivots
    for c, r in per_cell.items():
        cells.radius[c] = r["away"] * (1 + 1e-9)

    # data summaries: radius of each data cell; the best lower bounds of each query cell
    def summarise(batches):
        p = len(cells.pivots)
        reach, low, who = np.full(p, -1.0), np.zeros((0, p)), np.zeros((0, p), np.int64)
        for piece in pieces(batches):
            ids = piece.column("id").to_numpy()
            products, cell, away, length = cells.place(cells.whole(matrix(piece.column("vector"), d)))
            np.maximum.at(reach, cell, away)
            low, who = np.concatenate([low, cells.lowest(products, length)]), np.concatenate([who, np.repeat(ids[:, None], p, 1)])
            if len(low) > k + 1:
                keep = np.argpartition(-low, k, axis=0)[:k + 1]
                low, who = np.take_along_axis(low, keep, 0), np.take_along_axis(who, keep, 0)
        c = np.concatenate([np.arange(p), np.tile(np.arange(p), len(low))])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(np.concatenate([reach, np.full(low.size, np.nan)]), from_pandas=True),
                                          pa.array(np.concatenate([np.zeros(p, np.int64), who.ravel()])),
                                          pa.array(np.concatenate([np.full(p, np.nan), low.ravel()]), from_pandas=True)], names=["cell", "reach", "id", "low"])

    seen = rows.select("id", "vector").mapInArrow(summarise, "cell int, reach double, id long, low double").groupBy("cell", "id") \
        .agg(F.max("reach").alias("reach"), F.max("low").alias("low"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("low").desc_nulls_last()))  # at most k + 1 rows a task and cell
    seen = seen.withColumn("nth", nth).groupBy("cell").agg(F.max("reach").alias("reach"), F.max(F.when(F.col("nth") == k + 1, F.col("low"))).alias("bound"))
    for r in seen.collect():  # at most max_pivots
        cells.reach[r["cell"]] = r["reach"] * (1 + 1e-9) if r["reach"] >= 0 else -1.0
        cells.bound[r["cell"]] = -np.inf if r["bound"] is None else r["bound"]
    meet = cells.meet()

    # query cells packed into groups of at most group_queries; a larger cell takes several groups of its own
    first, splits, g, held = np.full(len(cells.pivots), -1), np.ones(len(cells.pivots), np.int64), 0, 0
    for c in chain(cells.pivots):
        n = per_cell[c]["n"] if c in per_cell else 0
        if not n:
            continue
        if held and held + n > group_queries:
            g, held = g + 1, 0
        first[c], splits[c] = g, -(-n // group_queries)
        g, held = (g + int(splits[c]), 0) if splits[c] > 1 else (g, held + n)
    groups = g + 1
    group_cells = np.zeros((groups, len(cells.pivots)), bool)
    for c in per_cell:
        group_cells[first[c]:first[c] + splits[c], c] = True

    def wanted(x: np.ndarray):
        """(row, group) pairs: the rows that each group needs."""
        products, cell, _, length = cells.place(x)
        need = cells.needed(products, cell, length, meet).astype(np.float32)
        return np.nonzero(need @ group_cells.T.astype(np.float32) > 0)

    def count_wanted(batches):
        total = np.zeros(groups, np.int64)
        for piece in pieces(batches):
            total += np.bincount(wanted(cells.whole(matrix(piece.column(0), d)))[1], minlength=groups)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups), pa.int32()), pa.array(total)], names=["g", "n"])

    load = {r["g"]: r["n"] for r in rows.select("vector").mapInArrow(count_wanted, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # tiles of a group: few enough rows for one task, and work for all tasks when there are few rows
    tiles = np.array([max(1, -(-load[i] // tile_rows), min(lanes, -(-load[i] // 2048))) for i in range(groups)], np.int64)

    spread = 2 * np.arange(d, dtype=np.int64) + 1

    def send_rows(batches):
        for piece in pieces(batches):
            x = cells.whole(matrix(piece.column("vector"), d))
            row, to = wanted(x)
            key = mix(piece.column("id").to_numpy().astype(np.uint64) ^ (x * spread).sum(1).astype(np.uint64))  # of the row alone: a task run again deals alike
            spot = (key[row] >> np.uint64(33)).astype(np.int64)
            codes = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(spot % tiles[to], pa.int32()), piece.column("id").take(pa.array(row)), codes.take(pa.array(row))],
                                             names=["g", "tile", "id", "code"])

    def send_queries(batches):
        for piece in pieces(batches):
            q, cell = piece.column("q").to_numpy(), piece.column("cell").to_numpy()
            to = first[cell] + q % splits[cell]
            row = np.repeat(np.arange(len(q)), tiles[to])
            tile = np.arange(len(row)) - np.repeat(np.cumsum(tiles[to]) - tiles[to], tiles[to])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(to[row], pa.int32()), pa.array(tile, pa.int32()), *[piece.column(c).take(at) for c in ("q", "id", "cell", "code")]],
                                             names=["g", "tile", "q", "id", "cell", "code"])

    def solve(ask: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "query_id": [], "vec_id": [], "score": []}
        if len(ask) and len(data):
            data = data.sort_values("id", kind="stable")
            ids, x = data["id"].to_numpy(), np.frombuffer(b"".join(data["code"]), kind).reshape(-1, d).astype(np.int64)
            products, cell, _, length = cells.place(x)
            need = cells.needed(products, cell, length, meet)
            del products
            for c, part in ask.groupby("cell"):
                use = np.nonzero(need[:, c])[0]
                for a in range(0, len(part), 512):
                    some = part.iloc[a:a + 512]
                    mine, y = some["id"].to_numpy(), np.frombuffer(b"".join(some["code"]), kind).reshape(-1, d).astype(np.int64)
                    for b in range(0, len(use), 8192):
                        at = use[b:b + 8192]
                        scores = exact_products(y, x[at])
                        own = mine[:, None] == ids[at][None, :]
                        scores[own] = np.iinfo(np.int64).min
                        row, col = best_of_tile(ids[at], scores, k)
                        real = ~own[row, col]
                        row, col = row[real], col[real]
                        for name, values in zip(out, (some["q"].to_numpy()[row], mine[row], ids[at][col], scores[row, col])):
                            out[name].append(values)
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()})

    asked = queries.select("q", "id", "cell", "code").mapInArrow(send_queries, "g int, tile int, q long, id long, cell int, code binary")
    sent = rows.select("id", "vector").mapInArrow(send_rows, "g int, tile int, id long, code binary")
    found = asked.groupBy("g", "tile").cogroup(sent.groupBy("g", "tile")).applyInPandas(solve, "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))  # k rows a tile piece
    best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """DuckDB SQL for the query over embeddings whose ids are distinct and whose lengths agree."""
    return f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
nums AS (SELECT vec_id, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM kept),
scores AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM nums a JOIN nums b ON a.j = b.j AND a.vec_id <> b.vec_id
  WHERE a.vec_id % {every} = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
