"""Helpers shared by the vector operators: usable rows, integer matrices and exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embeddings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def usable(df: DataFrame, id_col: str, vector_col: str, *others: str) -> tuple[DataFrame, int]:
    """(rows as ``id``, ``vector``, others.., vector length) of the rows that take part.

    A vector that is null or holds a null or non-finite entry takes no part;
    neither does one of another length than most have (ties: the longest), or
    an empty one.  Without usable rows the length is 0.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), *[F.col(f"`{c}`") for c in others])
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = int(lengths[0]["d"]) if lengths else 0
    return rows.where(F.size("vector") == d), d


def matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a double matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def pieces(batches, rows: int = 4096):
    """Arrow batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def limb_bits(d: int) -> int:
    """Bits a limb so that ``d`` products of two limbs add up to less than 2^53."""
    return (52 - max(d - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs of ``bits`` bits, lowest first; the last one carries the sign."""
    top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    out = []
    for _ in range(max(1, -(-top.bit_length() // bits)) - 1):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with the rows of ``b`` (int64), exact.

    Both sides are broken into limbs whose float64 BLAS products stay below
    2^53; the limbs' products are shifted and added in int64.  Small integers
    have one limb, and so one product.  The products must fit a long.
    """
    bits = limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    right = [q.T.copy() for q in limbs(b, bits)]
    for i, p in enumerate(limbs(a, bits)):
        for j, q in enumerate(right):
            total += (p @ q).astype(np.int64) << np.int64(bits * (i + j))
    return total
