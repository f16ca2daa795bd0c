"""Zero weights, NaN, missing classes, tied medians and thresholds in place of ranks."""

import random
import statistics

from pyspark.sql import functions as F

from nutriyield.operators import density as DN
from nutriyield.operators import models as M
from nutriyield.operators import profiles as PR
from nutriyield.operators.verbs import exact_median_by, hash_key, sample_fraction
from nutriyield.sources import literals as L


def _trips(spark):
    cols = ", ".join(f"{c} double" for c in L.NUTRIENTS_MU)
    rows = [("1", "2000-01-05", "canoe", "Reef", "gill net", 30.0, w, *([0.5] * len(L.NUTRIENTS_MU))) for w in (2.0, 4.0)]
    rows += [("2", "2000-01-05", "canoe", "Reef", "gill net", 30.0, 0.0, *([0.5] * len(L.NUTRIENTS_MU)))]
    rows = [(str(i), *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "landing_id string, landing_date string, vessel_type string, habitat string, gear_type string, "
                                 f"mesh_size double, weight double, {cols}").withColumn("landing_date", F.to_date("landing_date"))


def _rdi(spark):
    return spark.createDataFrame([(n, 2.0) for n in L.NUTRIENTS], "nutrient string, conv_factor double")


def test_zero_weight_has_no_score(spark):
    got = DN.density_by(_trips(spark), "habitat", _rdi(spark)).collect()
    want = statistics.median([0.5 / 2 * 1000 / 2, 0.5 / 4 * 1000 / 2]) / 10 * 100
    assert {round(r["inds_kg"], 6) for r in got} == {round(want, 6)}
    assert sorted(r["landing_id"] for r in PR.profile_features(_trips(spark), _rdi(spark)).collect()) == ["0", "1"]


def test_median_of_ties_nan_and_empty_groups(spark):
    g = random.Random(1)
    nan = float("nan")
    rows = [(g.choice(["a", "b", None]), g.choice([float(g.randint(0, 5)), g.random(), None, nan]), 1.0) for _ in range(2001)]
    rows += [("c", v, 0.0) for v in (1.0, 2.0, nan)] + [("z", None, 7.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for accuracy in (10000, 50):
        got = {r["k"]: (r["x"], r["y"]) for r in exact_median_by(df, ["k"], ["x", "y"], accuracy).collect()}
        assert got["c"][0] == 1.5 and got["z"] == (None, 7.0)
        for k in ("a", "b", None):
            x = [v for n, v, _ in rows if n == k and v is not None and v == v]
            assert got[k] == (statistics.median(x), 1.0)


def test_median_of_a_constant_moves_few_rows(spark):
    df = spark.range(50_000).select(F.lit("a").alias("k"), F.lit(4.0).alias("x"))
    plan = exact_median_by(df, ["k"], ["x"])
    assert plan.first()["x"] == 4.0
    assert "collect_list" not in plan._jdf.queryExecution().executedPlan().toString()


def test_sample_is_the_first_rows_in_hash_order(spark):
    g = random.Random(2)
    df = spark.createDataFrame([(i, g.choice(["x", "x", "y", None])) for i in range(3000)], "id int, s string").repartition(7)
    for strata in ([], ["s"]):
        got = {r["id"] for r in sample_fraction(df, ["id"], 0.37, 9, strata).collect()}
        rows = df.withColumn("h", hash_key(9, "id")).collect()
        for s in {r["s"] if strata else 0 for r in rows}:
            mine = sorted(((r["h"], r["id"]) for r in rows if not strata or r["s"] == s))
            want = {i for _, i in mine[: int(0.37 * len(mine))]}
            assert got & {i for _, i in mine} == want


def test_auc_without_a_class_and_roc_buckets(spark):
    g = random.Random(3)
    rows = []
    for i in range(400):
        t = g.choice("12")
        p = round(min(1.0, max(0.0, g.gauss(0.6 if t == "1" else 0.4, 0.2))), 2)
        rows.append((t, p, 1 - p, 0.0))
    df = spark.createDataFrame(rows, "truth string, pred_1 double, pred_2 double, pred_3 double")
    two = M.roc_auc_hand_till(df, "truth", ["1", "2"]).first()["estimate"]
    assert abs(M.roc_auc_hand_till(df, "truth", ["1", "2", "3"]).first()["estimate"] - two) < 1e-12
    pairs = [(a > b) + 0.5 * (a == b) for t, a, *_ in rows if t == "1" for u, b, *_ in rows if u == "2"]
    assert abs(two - sum(pairs) / len(pairs)) < 1e-12
    for buckets in (3, 65536):
        for r in M.roc_curves(df, "truth", ["1"], buckets).collect():
            pos = [a >= r["threshold"] for t, a, *_ in rows if t == "1"]
            neg = [a >= r["threshold"] for t, a, *_ in rows if t != "1"]
            assert abs(r["sensitivity"] - sum(pos) / len(pos)) < 1e-12
            assert abs(r["specificity"] - (1 - sum(neg) / len(neg))) < 1e-12
