"""Importance resampling of documents towards labelled good text.

Two generative models over hashed word n-grams (one and two words): the target
model from documents labelled good, the raw model from all documents.  A
document's log weight is the sum over its n-grams of log(target / raw); adding
Gumbel noise and keeping the k largest keys draws k documents without
replacement in proportion to their weights.

Both models are count tables of ``buckets`` entries, added up in the tasks and
then by shuffle: bounded whatever the corpus.  The target model reads at most
``target_rows`` labelled documents (those with the smallest hash of their id);
raw counts, scores and the selection cover every row.  The k-th largest key is
found by counting keys in ever finer bins, never by sorting all rows in one
place.

Defined cases: a null or empty text has no n-gram, log weight 0, and takes part
with its noise; without target documents all weights are 0; rows that repeat an
id share their noise, and keys equal to the k-th are all kept; an empty table
gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import U64, mix, pair_hash, share, shared, shared_table, slices, word_codes, word_hashes


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every one- and two-word n-gram, and where each text's begin (total last)."""
    codes, at, words = word_codes(texts, lower=True)
    n = np.diff(at)
    m = n + np.maximum(n - 1, 0)
    begin = np.concatenate([[0], np.cumsum(m)])
    out = np.empty(int(begin[-1]), np.int64)
    if len(codes):
        w = mix(word_hashes(words))[codes]
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(codes)) - at[:-1][owner]
        out[begin[owner] + place] = (w % U64(buckets)).astype(np.int64)
        two = np.nonzero(owner[:-1] == owner[1:])[0]
        out[begin[owner[two]] + n[owner[two]] + place[two]] = (pair_hash(w[two], w[two + 1]) % U64(buckets)).astype(np.int64)
    return out, begin


def _counts(buckets: int):
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                f, begin = features(part.column("text"), buckets)
                raw += np.bincount(f, minlength=buckets)
                good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
                target += np.bincount(f[np.repeat(good, np.diff(begin))], minlength=buckets)
        used = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])
    return run


def fit(docs: DataFrame, good_ids: DataFrame, buckets: int = 1 << 16, target_rows: int = 20_000) -> np.ndarray:
    """log(target / raw) of each bucket, one added to every count."""
    ids = good_ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    ids = shared_table(ids.withColumn("good", F.lit(True)), "target")
    rows = docs.join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))  # target_rows at most
    table = rows.mapInArrow(_counts(buckets), "bucket bigint, raw bigint, target bigint").groupBy("bucket") \
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # one row per bucket
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[table["bucket"]] += table["raw"]
    target[table["bucket"]] += table["target"]
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    u = (mix(ids.astype(np.int64).view(U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, log_weight, sample_key) for every row."""
    model = share(docs.sparkSession, ratio)

    def run(batches):
        r = shared(model)
        for batch in batches:
            for part in slices(batch, "text"):
                f, begin = features(part.column("text"), len(r))
                w = np.add.reduceat(np.append(r[f], 0.0), begin[:-1]) if len(begin) > 1 else np.zeros(0)
                w = np.where(np.diff(begin) > 0, w, 0.0)  # summed text by text: the same in any batch
                ids = part.column("doc_id")
                noise = gumbel(ids.fill_null(-1).to_numpy(zero_copy_only=False), seed)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(begin)), pa.array(w), pa.array(w + noise)],
                                                 ["doc_id", "n_features", "log_weight", "sample_key"])

    return docs.mapInArrow(run, "doc_id bigint, n_features bigint, log_weight double, sample_key double")


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096, exact_below: int = 4096) -> float:
    """The k-th largest value of a column (without nulls or NaN), by counting in ever finer bins."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    while True:
        width = (high - low) / bins
        inside = df.where(F.col(col).between(low, high))
        if width <= 0 or low + width == low:
            return float(low)
        counts = dict(inside.groupBy(F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).alias("b")).count().collect())  # bins rows
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                break
            k -= counts[b]
        own = inside.where(F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)) == b)
        if counts[b] <= exact_below:
            return float(sorted((r[0] for r in own.select(col).collect()), reverse=True)[k - 1])  # exact_below rows
        low, high = own.agg(F.min(col), F.max(col)).first()


def resample(docs: DataFrame, good_ids: DataFrame, fraction: float = 0.8, buckets: int = 1 << 16, target_rows: int = 20_000,
             seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, log_weight, sample_key, kept): ceil(fraction * rows) documents are kept."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scored = shared_table(weigh(rows, fit(rows, good_ids, buckets, target_rows), seed), "weights")
    n = scored.count()
    least = kth_largest(scored, "sample_key", max(1, math.ceil(fraction * n))) if n else 0.0
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(least))
