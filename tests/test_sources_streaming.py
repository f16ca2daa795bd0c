"""Readers, sinks, object-version resolution and the streaming totals."""

import tempfile

from pyspark.sql import functions as F

from nutriyield.operators import supply as S
from nutriyield.plans.inputs import Inputs
from nutriyield.sources import io as IO
from nutriyield.sources import literals as L
from nutriyield.streaming import monthly
from tests.conftest import SF_SMALL


def test_csv_with_bom_and_empty_fields(spark):
    d = tempfile.mkdtemp(prefix="nutriyield-csv-")
    with open(f"{d}/groups.csv", "w", encoding="utf-8") as f:
        f.write("﻿catch_name,family,interagency_code\n")
        for name, fam, code in L.CATCH_GROUPS:
            f.write(f"{name},{fam or ''},{code}\n")
    df = IO.read_csv(spark, f"{d}/groups.csv", IO.CATCH_GROUPS_SCHEMA)
    rows = df.collect()
    assert len(rows) == len(L.CATCH_GROUPS)
    assert rows[0].catch_name == "Lobster" and rows[0].family is None


def test_latest_version_ties_and_missing_ext(spark):
    rows = [("a__1__rds", "2024-01-01 00:00:00"), ("a__2__rds", "2024-01-02 00:00:00"),
            ("a__3__rds", "2024-01-02 00:00:00"), ("a__4", "2024-01-05 00:00:00"),
            ("b__1__csv", "2024-01-01 00:00:00"), (None, "2024-01-09 00:00:00")]
    listing = spark.createDataFrame(rows, "name string, updated string") \
        .withColumn("updated", F.col("updated").cast("timestamp_ntz"))
    got = sorted(r.name for r in IO.latest_version(listing, "a", extension="rds").collect())
    assert got == ["a__2__rds", "a__3__rds"]
    got = sorted(r.name for r in IO.latest_version(listing, "", version="1").collect())
    assert got == ["a__1__rds", "b__1__csv"]


def test_parquet_roundtrip_nested_trips(spark):
    d = tempfile.mkdtemp(prefix="nutriyield-trips-")
    i = Inputs(spark, SF_SMALL)
    IO.write_table(i.trips, f"{d}/trips")
    back = IO.read_table(spark, f"{d}/trips")
    assert back.count() == i.trips.count()
    assert "landing_catch" in back.columns


def test_streaming_monthly_totals_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="nutriyield-stream-src-")
    ck = tempfile.mkdtemp(prefix="nutriyield-stream-ck-")
    i = Inputs(spark, SF_SMALL)
    adj = i.region_stats_adj
    adj.where(F.year("date_bin_start") < 1998).write.mode("append").parquet(src)
    adj.where(F.year("date_bin_start") >= 1998).write.mode("append").parquet(src)
    q = monthly.start_memory(spark, src, "monthly_totals_test", ck)
    q.awaitTermination(120)
    got = spark.table("monthly_totals_test")
    want = S.monthly_totals(adj).drop("year")
    diff = got.join(want, ["region", "date_bin_start"], "full_outer").where(
        (F.abs(got["catch"] - want["catch"]) > 1e-6) | got["region"].isNull() | want["region"].isNull())
    assert got.count() == want.count()
    assert diff.count() == 0
