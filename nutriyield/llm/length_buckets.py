"""Optimal length buckets and token-budget batches.

Texts longer than ``max_tokens`` are cut into segments of that length (nothing
is dropped), so the histogram of lengths has at most ``max_tokens`` entries: the
proven bound on what the driver holds.  Dynamic programming over the global
histogram chooses the bucket bounds that minimise padding.  Inside a bucket the
segments stand in the order of a hash; every batch takes as many as fit the
token budget at the bucket's bound.

Places inside a bucket are counted in two steps (segments by hash range, then
the ranges' totals), so that a bucket that holds a third of all rows is spread
over as many tasks as its size asks for.

Defined cases: a null or empty text is one segment of 0 tokens in bucket 0 with
no batch; rows that repeat an id are all packed; a null id is an id of its own;
an empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nutriyield.llm.common import WORD, shared_table


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding (exact).

    f[k][j]: least padded size of the j shortest lengths in k buckets.  Ties
    take the earliest cut.
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), np.cumsum(np.concatenate([[0], counts[order]])).astype(np.int64)
    n, k = len(x), min(buckets, len(x))
    if not n:
        return []
    f = np.concatenate([[0], np.full(n, np.iinfo(np.int64).max // 4)])
    cuts = []
    for _ in range(k):
        g, cut = f.copy(), np.zeros(n + 1, np.int64)
        g[0] = 0
        for j in range(1, n + 1):
            cost = f[:j] + (c[j] - c[:j]) * x[j - 1]
            cut[j] = int(cost.argmin())
            g[j] = cost[cut[j]]
        cuts.append(cut)
        f = g
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(x[j - 1]))
        j = int(cut[j])
    return sorted(bounds)


def segments(docs: DataFrame, max_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seg, n_tokens): words of each text, cut every ``max_tokens``."""
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", n.cast("bigint").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_tokens).cast("bigint"), F.lit(1)) - 1
    return rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("seg")) \
        .select("doc_id", "seg", F.least(F.lit(max_tokens).cast("bigint"), F.col("n") - F.col("seg") * max_tokens).alias("n_tokens"))


def pack_buckets(docs: DataFrame, buckets: int = 12, max_tokens: int = 2048, budget: int = 16384, id_col: str = "doc_id",
                 text_col: str = "text", rows_per_range: int = 200_000) -> DataFrame:
    """(doc_id, seg, n_tokens, bucket, padded_tokens, batch) for every segment."""
    segs = shared_table(segments(docs, max_tokens, id_col, text_col), "segments")
    hist = segs.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()  # at most max_tokens rows
    bounds = optimal_bounds(hist["n_tokens"].to_numpy(np.int64), hist["n"].to_numpy(np.int64), buckets)
    bucket = F.lit(0)
    for k, b in reversed(list(enumerate(bounds, 1))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(k)).otherwise(bucket)
    bucket = F.when(F.col("n_tokens") == 0, F.lit(0)).otherwise(bucket)
    padded = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in [0, *bounds]]), bucket + 1)
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("seg").cast("string")).cast("binary"))
    ranges = int(hist["n"].sum()) // rows_per_range + 1 if len(hist) else 1
    # the range of a hash follows the order of the hashes, so the places don't depend on their number
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * ranges / (1 << 32)).cast("bigint")
    rows = segs.withColumns({"bucket": bucket, "h": order}).withColumns({"padded_tokens": padded, "part": part})
    inner = Window.partitionBy("bucket", "part").orderBy("h", F.col("doc_id").asc_nulls_first(), "seg", "n_tokens")
    size = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")
    start = size.select("bucket", "part", before.alias("before"))
    placed = rows.withColumn("place", F.row_number().over(inner) - 1).join(start, ["bucket", "part"])
    fit = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.col("padded_tokens")))
    batch = F.when(F.col("bucket") > 0, F.floor((F.col("before") + F.col("place")) / fit))
    return placed.select("doc_id", "seg", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "padded_tokens", batch.cast("bigint").alias("batch"))


def oracle(buckets: int = 12, max_tokens: int = 2048, budget: int = 16384, table: str = "documents") -> str:
    """DuckDB SQL with the same dynamic programme, one CTE a bucket."""
    word = "'" + WORD + "'"
    s = f"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {word})) AS n FROM {table}),
segs AS (SELECT doc_id, n, unnest(range(CAST(greatest(ceil(n / {max_tokens}.0), 1) AS BIGINT))) AS seg FROM n),
seg AS (SELECT doc_id, seg, least({max_tokens}, n - seg * {max_tokens}) AS n_tokens FROM segs),
hist AS (SELECT n_tokens AS x, count(*) AS c FROM seg WHERE n_tokens > 0 GROUP BY 1),
cum AS (SELECT row_number() OVER (ORDER BY x) AS j, x, sum(c) OVER (ORDER BY x) AS c FROM hist UNION ALL SELECT 0, 0, 0),
f0 AS (SELECT j, CASE WHEN j = 0 THEN 0 ELSE 4e18 END AS f, 0 AS cut FROM cum)"""
    for k in range(1, buckets + 1):
        s += f""",
f{k} AS MATERIALIZED (SELECT 0 AS j, 0.0 AS f, 0 AS cut UNION ALL SELECT b.j, min(p.f + (b.c - a.c) * b.x), arg_min(a.j, (p.f + (b.c - a.c) * b.x) * 1e5 + a.j)
  FROM cum b JOIN cum a ON a.j < b.j JOIN f{k - 1} p ON p.j = a.j WHERE p.f < 1e18 GROUP BY b.j),
"""[:-2]
    s += f""",
best AS (SELECT least({buckets}, (SELECT max(j) FROM cum)) AS k),
c{buckets} AS (SELECT (SELECT max(j) FROM cum) AS j)"""
    for k in range(buckets, 0, -1):
        s += f",\nc{k - 1} AS (SELECT CASE WHEN {k} > (SELECT k FROM best) THEN (SELECT j FROM c{k}) ELSE coalesce((SELECT cut FROM f{k} WHERE j = (SELECT j FROM c{k})), 0) END AS j)"
    s += ",\nbounds AS (" + " UNION ".join(f"SELECT x FROM cum WHERE j = (SELECT j FROM c{k}) AND j > 0" for k in range(buckets + 1)) + ")"
    return s + f""",
numbered AS (SELECT row_number() OVER (ORDER BY x) AS bucket, x FROM bounds UNION ALL SELECT 0, 0),
placed AS (SELECT s.*, b.bucket, b.x AS padded, row_number() OVER (PARTITION BY b.bucket ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || seg), doc_id NULLS FIRST, seg, n_tokens) - 1 AS place
  FROM seg s JOIN numbered b ON b.x = (SELECT min(x) FROM numbered m WHERE m.x >= s.n_tokens))
SELECT doc_id, CAST(seg AS BIGINT) AS seg, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(padded AS BIGINT) AS padded_tokens,
  CASE WHEN bucket > 0 THEN CAST(place // greatest(1, {budget} // padded) AS BIGINT) END AS batch FROM placed"""
