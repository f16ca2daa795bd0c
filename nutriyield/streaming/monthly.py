"""Incremental monthly regional totals with Structured Streaming.

The batch operator ``supply.monthly_totals`` sums yields per (region, month).
When adjusted yield rows arrive as files over time, the same aggregate runs as
a streaming query: state is one row per (region, month) kept in the checkpoint
folder, and a watermark on the month bin lets Spark drop state for months
that can no longer change.  NULL-poisoning sums keep R's rule: a NULL count
per group is carried so the output is NULL when any input was NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutriyield.sources import literals as L

YIELD_COLS = ["catch"] + L.NUTRIENTS

ADJ_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("date_bin_start", T.DateType()),
    T.StructField("grouped_taxa", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in YIELD_COLS],
])


def monthly_totals_stream(spark: SparkSession, source_dir: str, late_months: int = 2) -> DataFrame:
    """Streaming (region, month) strict sums over parquet files landing in ``source_dir``."""
    s = spark.readStream.schema(ADJ_SCHEMA).parquet(source_dir)
    s = s.withColumn("__ts", F.col("date_bin_start").cast("timestamp")) \
        .withWatermark("__ts", f"{31 * late_months} days")
    agg = s.groupBy("region", "__ts").agg(
        *[F.sum(c).alias(c) for c in YIELD_COLS],
        *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"__nulls_{c}") for c in YIELD_COLS])
    out = agg.select("region", F.to_date("__ts").alias("date_bin_start"),
                     *[F.when(F.col(f"__nulls_{c}") == 0, F.col(c)).alias(c) for c in YIELD_COLS])
    return out


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, once: bool = True):
    """Run the stream into a parquet sink (append: a month is written once final)."""
    q = (monthly_totals_stream(spark, source_dir).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if once else q.trigger(processingTime="1 minute")
    return q.start()


def start_memory(spark: SparkSession, source_dir: str, name: str, checkpoint: str):
    """Complete-mode in-memory sink (tests and interactive use)."""
    return (monthly_totals_stream(spark, source_dir).writeStream.format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start())
