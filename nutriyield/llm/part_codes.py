"""Vector compression: codebooks per part, assigned by exact limb-split matrix products.

Every vector becomes integers ``floor(scale * x)`` and is cut into equal parts.
A part's nearest codebook entry comes from ``|x|^2 - 2 x.c + |c|^2``: the products
``x.c`` are float64 BLAS products of integer limbs below 2^53, recombined in int64,
so distances are exact and the first smallest one is the lowest index.

Defined cases: rows whose vector is null, empty, of another length than most, or
holds a null or non-finite entry are dropped.  Repeated rows and ids are kept and
coded alike; a null id is coded and sorts last among the seeds, equal ids by their
vectors.  With fewer rows than ``entries`` the codebooks are that short.  No rows:
no output.  Other columns are ignored.  The length must be a multiple of ``parts``,
and components must stay within ``MAX_COMPONENT`` (an error says so), which keeps
squared distances in a long.

Moves: per task and round one row per part and entry; the codes go through a
scratch table.  Collected: the codebooks (parts x entries x part length).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import shared_table
from nutriyield.llm.vectors import exact_products, matrix, pieces, usable

#: largest |floor(scale * x)|: 2 * 2^27 squared, times up to 64 numbers a part, is below 2^63
MAX_COMPONENT = 1 << 27


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(vectors * scale)
    if x.size and np.abs(x).max() > MAX_COMPONENT:
        raise ValueError(f"a component is beyond {MAX_COMPONENT} after scaling: its squared distances need not fit a long")
    return x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, exact squared distance) of each row of ``x``."""
    far = (book * book).sum(1) - 2 * exact_products(x, book)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(1)


def _round(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: assign every part, then the componentwise floor of each entry's mean; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for piece in pieces(batches):
            x = whole(matrix(piece.column(0), parts * width), scale).reshape(-1, parts, width)
            for p in range(parts):
                at, _ = nearest(x[:, p], books[p])
                count[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, x[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                                          *[pa.array(total[p, e, j]) for j in range(width)]], names=names)

    names = ["p", "e", "n", *[f"s{j}" for j in range(width)]]
    schema = "p int, e int, " + ", ".join(f"{c} long" for c in names[2:])
    sums = rows.select("vector").mapInArrow(run, schema).groupBy("p", "e").agg(*[F.sum(c).alias(c) for c in names[2:]])
    out = books.copy()
    for r in sums.collect():  # parts x entries rows
        out[r["p"], r["e"]] = [r[c] // r["n"] for c in names[3:]]
    return out


def fit_codebooks(rows: DataFrame, d: int, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks (parts, entries, width) over all ``rows`` of ``usable``; seeds are the smallest ids."""
    if d % parts or entries > 256:
        raise ValueError(f"vectors of {d} numbers cannot be cut into {parts} equal parts, or over 256 entries")
    seeds = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    first = whole(np.array([r["vector"] for r in seeds], np.float64).reshape(-1, d), scale)
    books = first.reshape(len(seeds), parts, d // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _round(rows, books, scale)
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """(id, label, code, error): two hex digits per part, and the squared distances summed over parts."""
    parts, _, width = books.shape

    def run(batches):
        for piece in pieces(batches):
            x = whole(matrix(piece.column("vector"), parts * width), scale).reshape(-1, parts, width)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at, far = nearest(x[:, p], books[p])
                code[:, p] = at
                error += far
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                                             names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "vector").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16,
             entries: int = 64, rounds: int = 2, scale: int = 256, few_labels: int = 100_000) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable row.

    ``label_error`` sums errors over equal labels (nulls together).  Up to
    ``few_labels`` label sums are broadcast; beyond that, rows and sums meet in a
    join whose hot labels are spread by a salt.
    """
    rows, d = usable(df, id_col, vector_col, label_col)
    rows = rows.withColumnRenamed(label_col, "label") if label_col != "label" else rows
    if not d:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {dict(rows.dtypes)['id']}, code string, error long, label_error long, codebooks_sha256 string")
    books = fit_codebooks(rows, d, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = shared_table(encode(rows, books, scale), "part-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = shared_table(sums, "label-errors")
    same = F.col("c.label").eqNullSafe(F.col("s.label"))
    if sums.count() <= few_labels:
        both = coded.alias("c").join(F.broadcast(sums).alias("s"), same)
    else:
        salts = 64
        spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int"))
        both = salted.alias("c").join(spread.alias("s"), same & (F.col("c.salt") == F.col("s.salt")))
    return both.select(F.col("c.id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL for ``compress`` of embeddings whose ids are distinct and whose lengths agree."""
    ctes = [
        "kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"nums AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"width AS (SELECT (max(j) + 1) // {parts} AS w FROM nums)",
        "cells AS (SELECT vec_id, j // w AS p, j % w AS k, x FROM nums, width)",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})",
        "book0 AS (SELECT p, e, k, x AS c FROM cells JOIN seeds USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes += [f"far{r} AS (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS far FROM cells JOIN book{r} USING (p, k) GROUP BY vec_id, p, e)",
                 f"best{r} AS (SELECT vec_id, p, e, far FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) AS pos FROM far{r}) t WHERE pos = 1)"]
        if r < rounds:
            ctes += [f"mean{r} AS (SELECT p, e, k, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM cells JOIN best{r} USING (vec_id, p) GROUP BY p, e, k)",
                     f"book{r + 1} AS (SELECT p, e, k, coalesce(m, c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e, k))"]
    last = rounds
    ctes += [f"coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM best{last} GROUP BY vec_id)",
             "labelled AS (SELECT vec_id, code, error, label FROM coded JOIN kept USING (vec_id))",
             f"digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) AS h FROM book{last})"]
    return ("WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
            "h AS codebooks_sha256 FROM labelled, digest")
