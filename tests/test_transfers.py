"""Hartigan-Wong transfers, top-n with ties, NULL keys of natural joins."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nutriyield.operators import stats as ST
from nutriyield.operators import verbs as V


def wss(x, labels):
    return sum(((x[labels == k] - x[labels == k].mean(0)) ** 2).sum() for k in set(labels))


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_no_single_transfer_improves(spark, batch):
    g = np.random.default_rng(batch)
    x = np.concatenate([g.normal(c, 1.5, (25, 2)) for c in ((0, 0), (3, 1), (1, 4))])
    start = [int(v) for v in g.integers(1, 4, len(x))]
    rows = [(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, start))] + [(900, None, 1.0, 2)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c int").repartition(3)
    out, centers, total = ST.transfer_rows(df, ["a", "b"], ["id"], "c", batch=batch)
    got = {r["id"]: r["c"] for r in out.collect()}
    labels = np.array([got[i] for i in range(len(x))])
    assert len(got) == len(rows) and total == pytest.approx(wss(x, labels)) and total < wss(x, np.array(start))
    assert centers == sorted(centers) and np.allclose(centers, [x[labels == k].mean(0) for k in (1, 2, 3)])
    for i, k in itertools.product(range(len(x)), (1, 2, 3)):
        other = labels.copy()
        other[i] = k
        assert wss(x, other) >= total - 1e-9


def test_transfers_leave_a_lloyd_optimum(spark):
    """One dimension, two clusters: Lloyd stops at {0, 4, 5.9} | {10}, a transfer finds {0, 4} | {5.9, 10}."""
    rows = [(i, v, c) for i, (v, c) in enumerate([(0.0, 1), (4.0, 1), (5.9, 1), (10.0, 2)])]
    x = np.array([v for _, v, _ in rows])[:, None]
    best = min(wss(x, np.array(c)) for c in itertools.product((1, 2), repeat=4) if len(set(c)) == 2)
    out, _, total = ST.transfer_rows(spark.createDataFrame(rows, "id int, v double, c int"), ["v"], ["id"], "c")
    assert total == pytest.approx(best) and {r["id"]: r["c"] for r in out.collect()} == {0: 1, 1: 1, 2: 2, 3: 2}


def test_profiles_never_above_lloyd(spark):
    g = np.random.default_rng(8)
    x = g.normal(0, 1, (90, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    plain = ST.cluster_profiles(df, ["a", "b"], ["id"], restarts=4, transfers=False)[1]
    out, model = ST.cluster_profiles(df, ["a", "b"], ["id"], restarts=4)
    labels = np.array([r["clusters"] for r in out.orderBy("id").collect()])
    assert model["tot_withinss"] <= plain["tot_withinss"] + 1e-12 and model["tot_withinss"] == pytest.approx(wss(x, labels))


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_top_n_with_ties(spark, n):
    g = random.Random(n)
    rows = [(g.choice(["a", "a", "b", None]), g.choice([1, 2, 3, 4, 5, None]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    want = []
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: -r[1])
        want += [r for r in mine if r[1] >= mine[min(n, len(mine)) - 1][1]]
    got = V.top_n_with_ties(df, ["k"], F.col("v"), n)
    assert got.columns == ["k", "v", "i"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_natural_join_matches_null_keys(spark):
    a = spark.createDataFrame([(1, "x", 10), (None, "x", 20), (None, None, 30), (2, "y", 40)], "k int, s string, u int")
    b = spark.createDataFrame([(1, "x", 1.0), (None, "x", 2.0), (None, None, 3.0), (3, "z", 4.0)], "k int, s string, w double")
    left = V.natural_join(a, b)
    assert left.columns == ["k", "s", "u", "w"]
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "x", 10, 1.0), (None, "x", 20, 2.0), (None, None, 30, 3.0), (2, "y", 40, None)], key=str)
    full = V.natural_join(a, b, "full").collect()
    assert (3, "z", None, 4.0) in [tuple(r) for r in full] and len(full) == 5


def test_projection_signs(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 3)) @ np.array([[2, 0.3, 0], [0, 1, 0.2], [0, 0, 0.5]])
    for flip in (1.0, -1.0):
        df = spark.createDataFrame([(i, *map(float, r * flip)) for i, r in enumerate(x)], "id int, a double, b double, c double")
        got = np.array([(r["pc1"], r["pc2"]) for r in ST.project_clusters(df, ["a", "b", "c"]).orderBy("id").collect()])
        z = (x * flip - (x * flip).mean(0)) / x.std(0, ddof=1)
        basis = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
        basis *= np.sign(basis[np.abs(basis).argmax(0), [0, 1]])
        offset = got - z @ basis
        assert np.allclose(offset, offset[0], atol=1e-9)
