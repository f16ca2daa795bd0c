"""Helpers shared by the training-data operators: shared scratch tables and word arrays."""

from __future__ import annotations

import pickle
import sys
import types
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nutriyield.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under spark.checkpoint.dir and read it back.

    Cuts lineage in a folder that every executor and the driver can read, so a
    lost executor costs a re-read, not a recomputation.  The shuffle files behind
    it go when it is written, the folder when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def process_cache() -> dict:
    """A dict that lives as long as the Python process; functions sent by value have no lasting globals."""
    name = "_nutriyield_process_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].held = {}
    return sys.modules[name].held


def share(spark: SparkSession, model) -> Broadcast:
    """Broadcast a model of proven size, its class included (see the package's docstring)."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shared(model: Broadcast):
    return pickle.loads(model.value)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """crc32(id as text) mod ``mod`` = ``rest``; a null id is held out (never learned from)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % mod == rest, F.lit(True))


def slices(batch: pa.RecordBatch, col: str, limit: int = 4_000_000):
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
        # a copy: some string kernels misread an array that begins inside its buffers
        yield batch.take(pa.array(np.arange(start, end)))
        start = end


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text as codes into a word list.

    Returns (code per word, first word of each text plus the total, distinct
    words).  Null counts as empty; ``lower`` maps A-Z only.
    """
    texts = pc.fill_null(texts, "")
    texts = (pc.ascii_lower(texts) if lower else texts).cast(pa.large_string())
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    codes, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    if empty >= 0:  # runs of blanks at the ends of a text
        real = codes != empty
        kept = np.concatenate([[0], np.cumsum(real)])
        codes, offsets = codes[real], kept[offsets]
    return codes, offsets, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; the same in every process."""
    if not len(words):
        return np.zeros(0, U64)
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit mixer (two rounds of shift, xor, multiply); works on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit hash of two 64-bit hashes."""
    return mix(mix(a) * U64(3) + b)


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .., n-1 for each n of ``lengths``, one after another."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run offsets[i]:offsets[i+1]; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
