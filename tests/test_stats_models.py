"""Planted fixtures for PERMANOVA, regression, AUC, SHAP and splits."""

import math

from pyspark.sql import functions as F

from nutriyield.operators import economics as EC
from nutriyield.operators import explain as EX
from nutriyield.operators import models as M
from nutriyield.operators import stats as ST
from nutriyield.functions.distributions import t_quantile_np


def test_permanova_hand_computed(spark):
    # two groups on a line: g1 at 0,1,2 ; g2 at 10,11,12 (one feature)
    rows = [(str(i), "a" if i < 3 else "b", float(v)) for i, v in enumerate([0, 1, 2, 10, 11, 12])]
    df = spark.createDataFrame(rows, "id string, g string, x double")
    out = {r.term: r for r in ST.permanova(df, "g", ["x"], ["id"], permutations=99, seed=1).collect()}
    ss_t = sum((v - 6.0) ** 2 for v in [0, 1, 2, 10, 11, 12])
    ss_w = 4.0
    f = ((ss_t - ss_w) / 1) / (ss_w / 4)
    assert abs(out["Total"].SumOfSqs - ss_t) < 1e-9
    assert abs(out["Residual"].SumOfSqs - ss_w) < 1e-9
    assert abs(out["g"].statistic - f) < 1e-9
    assert abs(out["g"].R2 + out["Residual"].R2 - 1.0) < 1e-12
    assert 1 / 100 <= out["g"].p_value <= 1.0


def test_permanova_identical_groups_p_near_one(spark):
    rows = [(str(i), "a" if i % 2 else "b", float(i // 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, g string, x double")
    p = [r.p_value for r in ST.permanova(df, "g", ["x"], ["id"], permutations=99).collect() if r.term == "g"][0]
    assert p > 0.5


def test_price_model_exact_line(spark):
    # log(value) = 1 + 2 log(weight): prediction at log(log(1000))
    rows = [("T", str(i), math.exp(1 + 2 * math.log(w)), w) for i, w in enumerate([1.0, 2.0, 5.0, 9.0])]
    df = spark.createDataFrame(rows, "catch_taxon string, landing_id string, landing_value double, weight double")
    price = EC.price_model(df, at=1000.0).first().price
    want = round(math.exp(1 + 2 * math.log(math.log(1000))) * 10, 2)
    assert abs(price - want) < 1e-6


def _scored(spark, rows):
    return spark.createDataFrame(rows, "truth string, pred_1 double, pred_2 double")


def test_auc_perfect_reversed_tied(spark):
    perfect = _scored(spark, [("1", 0.9, 0.1), ("1", 0.8, 0.2), ("2", 0.3, 0.7), ("2", 0.2, 0.8)])
    rev = _scored(spark, [("1", 0.1, 0.9), ("1", 0.2, 0.8), ("2", 0.7, 0.3), ("2", 0.8, 0.2)])
    tied = _scored(spark, [("1", 0.5, 0.5), ("1", 0.5, 0.5), ("2", 0.5, 0.5), ("2", 0.5, 0.5)])
    assert M.roc_auc_hand_till(perfect, "truth", ["1", "2"]).first().estimate == 1.0
    assert M.roc_auc_hand_till(rev, "truth", ["1", "2"]).first().estimate == 0.0
    assert M.roc_auc_hand_till(tied, "truth", ["1", "2"]).first().estimate == 0.5


class AdditiveModel:
    """p_1 = 0.1 + 0.2*[a == 'x'] + 0.3*[b == 'y'], p_2 = 1 - p_1."""
    classes = ["1", "2"]

    def transform(self, df):
        p1 = F.lit(0.1) + F.when(F.col("a") == "x", 0.2).otherwise(0.0) + F.when(F.col("b") == "y", 0.3).otherwise(0.0)
        return df.withColumn("pred_1", p1).withColumn("pred_2", F.lit(1.0) - p1)


def test_shap_closed_form_and_additivity(spark):
    rows = [(str(i), "x" if i % 2 else "u", "y" if i % 3 else "v") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    shap = EX.kernel_shap(AdditiveModel(), df, ["a", "b"], ["id"], n_bg=30, seed=1)
    share_x = sum(1 for i in range(30) if i % 2) / 30
    share_y = sum(1 for i in range(30) if i % 3) / 30
    for r in shap.where((F.col("class") == "1")).collect():
        want = 0.2 * ((r.a == "x") - share_x) if r.feature == "a" else 0.3 * ((r.b == "y") - share_y)
        assert abs(r.shap - want) < 1e-9
    tot = shap.groupBy("id", "class").agg(F.sum("shap").alias("s"), F.first("baseline").alias("b0"),
                                          F.first("prediction").alias("p"))
    assert tot.where(F.abs(F.col("b0") + F.col("s") - F.col("p")) > 1e-9).count() == 0


def test_split_floor_rule_and_strata(spark):
    rows = [(str(i), "s1") for i in range(1)] + [(str(i), "s5") for i in range(10, 15)] + \
           [(str(i), "s100") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "id string, cluster string")
    out = M.stratified_split(df, "cluster", ["id"], 0.8, 234)
    got = {(r.cluster, r.split): r.n for r in out.groupBy("cluster", "split").agg(F.count("*").alias("n")).collect()}
    assert got.get(("s1", "train"), 0) == 0 and got[("s1", "test")] == 1
    assert got[("s5", "train")] == 4 and got[("s100", "train")] == 80


def test_t_quantile_known_values():
    import numpy as np
    q = t_quantile_np(0.99, np.array([1, 2, 5, 10, 30, 2000]))
    want = [31.820516, 6.964557, 3.364930, 2.763769, 2.457262, 2.328214]
    for a, b in zip(q, want):
        assert abs(a - b) < 1e-4


def test_multi_start_kmeans_planted_blobs(spark):
    # three separated blobs in 2-d; every restart that seeds one row per blob finds them
    centres = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = []
    for b, (cx, cy) in enumerate(centres):
        for i in range(12):
            rows.append((f"{b}-{i}", cx + (i % 4) * 0.1, cy + (i // 4) * 0.1))
    df = spark.createDataFrame(rows, "id string, x double, y double")
    out, model = ST.cluster_profiles(df, ["x", "y"], ["id"], k=3, restarts=20, seed=7)
    got = {r.id: r.clusters for r in out.collect()}
    for b in range(3):
        assert len({got[f"{b}-{i}"] for i in range(12)}) == 1
    assert len(set(got.values())) == 3
    # centres sorted lexicographically, so cluster "1" is the blob at the origin
    assert got["0-0"] == "1" and got["2-0"] == "2" and got["1-0"] == "3"
    spread = sum(((i % 4) * 0.1 - 0.15) ** 2 + ((i // 4) * 0.1 - 0.1) ** 2 for i in range(12))
    assert abs(model["tot_withinss"] - 3 * spread) < 1e-9
