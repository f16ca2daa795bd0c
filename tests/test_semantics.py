"""Planted fixtures for the R missing-value, tie and rounding rules."""

from pyspark.sql import functions as F

from nutriyield.functions import paste, r_ifelse, sig, strict_sum, sum_na_rm
from nutriyield.operators.verbs import (add_total_row, anti_in, bucketed_rank, exact_median_by, mode_by,
                                        nullsafe_join, top_n_with_ties)
from nutriyield.operators.trips import unnest_catch


def test_strict_sum_poisons_and_na_rm(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", 2.0), ("b", 3.0), ("c", None)],
                               "g string, x double")
    out = {r.g: (r.s, r.n) for r in df.groupBy("g").agg(strict_sum("x").alias("s"), sum_na_rm("x").alias("n")).collect()}
    assert out["a"] == (None, 5.0)
    assert out["b"] == (5.0, 5.0)
    assert out["c"] == (None, 0.0)


def test_nullsafe_join_matches_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    right = spark.createDataFrame([(None, 10), ("k", 20)], "k string, b int")
    rows = sorted((r.a, r.b) for r in nullsafe_join(left, right, ["k"]).collect())
    assert rows == [(1, 10), (2, 20)]


def test_anti_in_keeps_null_left_keys(spark):
    left = spark.createDataFrame([(None,), ("x",), ("y",)], "k string")
    right = spark.createDataFrame([("x",), (None,)], "k string")
    assert sorted(r.k or "NULL" for r in anti_in(left, right, "k").collect()) == ["NULL", "y"]


def test_mode_tie_goes_to_alphabetical_first(spark):
    df = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "b"), ("t", "a"), ("u", None), ("u", "z")],
                               "t string, m string")
    out = {r.t: r.mode for r in mode_by(df, "t", "m").collect()}
    assert out == {"t": "a", "u": "z"}


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([("g", "a", 5.0), ("g", "b", 5.0), ("g", "c", 1.0)], "g string, k string, v double")
    assert sorted(r.k for r in top_n_with_ties(df, ["g"], F.col("v"), 1).collect()) == ["a", "b"]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r.y for r in df.select(F.bround("x", 0).alias("y")).collect()] == [0.0, 2.0, 2.0]


def test_total_row_keeps_real_null(spark):
    df = spark.createDataFrame([(None, 1.0), ("r", 2.0)], "region string, v double")
    out = add_total_row(df, "region", {"v": F.sum("v")}, "All")
    got = sorted(((r.region or "NULL"), r.v) for r in out.collect())
    assert got == [("All", 3.0), ("NULL", 1.0), ("r", 2.0)]


def test_ifelse_and_paste_na(spark):
    df = spark.createDataFrame([(None, None), (True, "x"), (False, "y")], "c boolean, s string")
    out = df.select(r_ifelse(F.col("c"), "yes", "no").alias("a"), paste("s", F.lit(1), sep="_").alias("b")).collect()
    assert [(r.a, r.b) for r in out] == [(None, "NA_1"), ("yes", "x_1"), ("no", "y_1")]


def test_unnest_drops_null_and_empty_lists(spark):
    schema = ("id string, landing_catch array<struct<catch_taxon:string, "
              "length_frequency:array<struct<catch:double, weight:double>>>>")
    df = spark.createDataFrame([
        ("a", None), ("b", []), ("c", [("T", [])]), ("d", [("T", [(1.0, 2.0)]), ("U", None)])], schema)
    rows = unnest_catch(df).collect()
    assert [(r.id, r.catch_taxon, r.catch) for r in rows] == [("d", "T", 1.0)]


def test_exact_median_matches_builtin(spark):
    import random
    rnd = random.Random(3)
    data = [("a" if i % 3 else "b", rnd.random() * 100) for i in range(2500)] + [("c", None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.x for r in exact_median_by(df, ["g"], ["x"], accuracy=100).collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    for g in ("a", "b"):
        assert abs(got[g] - want[g]) < 1e-9
    assert got.get("c") is None


def test_bucketed_rank_equals_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"),
                                  F.col("id"))
    a = bucketed_rank(df, ["g"], "h", bucket_digits=2, tie_cols=["id"])
    w = Window.partitionBy("g").orderBy("h", "id")
    b = df.withColumn("rn", F.row_number().over(w))
    j = a.join(b, ["g", "id"]).where(F.col("__pos") != F.col("rn"))
    assert j.count() == 0


def test_sig_snaps_last_bits(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (0.3,), (None,), (0.0,)], "x double")
    vals = [r.y for r in df.select(sig("x", 8).alias("y")).collect()]
    assert vals[0] == vals[1] and vals[2] is None and vals[3] == 0.0
