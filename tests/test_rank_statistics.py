"""Rank correlations, t quantiles and silhouettes against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nutriyield.functions.distributions import t_quantile, t_quantile_np
from nutriyield.operators import models as M
from nutriyield.operators import stats as ST


@pytest.mark.parametrize("ranges", [1000, 3])
def test_average_ranks_with_ties(spark, ranges):
    g = random.Random(1)
    rows = [("a", float(g.randrange(40)) / 8) for _ in range(900)] + [("a", 0.0)] * 500 + [("b", g.random()) for _ in range(200)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit(1))
    got = {(r["k"], r["v"]): r["rank"] for r in M.average_ranks(df, ["k"], "v", ranges).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    pdf["rank"] = pdf.groupby("k")["v"].rank(method="average")
    assert got == {(k, v): r for k, v, r in pdf.itertuples(index=False)}


def test_spearman_with_planted_ties(spark):
    g = random.Random(2)
    rows = [(float(g.randrange(5)), g.random(), 7.0) for _ in range(300)] + [(2.0, 0.5, 7.0)] * 200
    rows = [(a, b, c, a * 2 + (g.random() < 0.1)) for a, b, c in rows]
    odd = [(None, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["rho"] for r in M.spearman_matrix(df, ["a", "b", "c", "d"]).collect()}
    want = pd.DataFrame(rows, columns=list("abcd")).rank().corr()
    for (a, b), rho in got.items():
        assert rho is None if "c" in (a, b) else rho == pytest.approx(want.loc[a, b], abs=1e-12)
    assert len(got) == 6
    left = M.drop_correlated(df, ["a", "b", "c", "d"]).columns
    assert "b" in left and "c" in left and ("a" in left) != ("d" in left)


def test_t_quantile_column(spark):
    nu = [1, 2, 3, 4, 7, 29, 30, 300, 10_000, 3_000_000]
    df = spark.createDataFrame([(v,) for v in [*nu, 0, None]], "nu long").repartition(1)
    for p in (0.99, 0.6, 0.975):
        got = {r["nu"]: r["q"] for r in df.select("nu", t_quantile(p, "nu").alias("q")).collect()}
        assert got[0] is None and got[None] is None
        assert np.allclose([got[v] for v in nu], t_quantile_np(p, np.array(nu)), rtol=1e-10)


def test_silhouette_brute_force(spark):
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(c, 1, (n, 2)) for c, n in ((0, 30), (5, 20), (9, 1))]).round(2) + 1e4
    c = ["1"] * 30 + ["2"] * 20 + ["3"]
    df = spark.createDataFrame([(float(a), float(b), k) for (a, b), k in zip(x, c)], "a double, b double, clusters string")
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i, k in enumerate(c):
        mean = {m: far[i, [j for j in range(len(c)) if c[j] == m and j != i]].mean() for m in "123" if m != k or c.count(m) > 1}
        s.append(0.0 if k not in mean else (min(v for m, v in mean.items() if m != k) - mean[k]) / max(mean[k], min(v for m, v in mean.items() if m != k)))
    wss = sum(((x[[j for j in range(len(c)) if c[j] == k]] - x[[j for j in range(len(c)) if c[j] == k]].mean(0)) ** 2).sum() for k in "123")
    got = ST.silhouette(df, ["a", "b"]).collect()
    assert len(got) == 1 and got[0]["k"] == 3
    assert got[0]["silhouette"] == pytest.approx(np.mean(s), abs=1e-9) and got[0]["wss"] == pytest.approx(wss, rel=1e-9)
    one = ST.silhouette(df.withColumn("clusters", F.lit("1")), ["a", "b"]).first()
    assert one["k"] == 1 and one["silhouette"] == 0.0
