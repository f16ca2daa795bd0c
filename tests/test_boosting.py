"""Boosted trees on cells: equal to the rows they stand for, and better than chance where there is a rule."""

import random

import numpy as np
import pandas as pd

from nutriyield.operators import boosting as B

SET = {"trees": 40, "tree_depth": 3, "min_n": 1, "loss_reduction": 0.0, "sample_size": 1.0, "learn_rate": 0.3, "stop_iter": 5, "mtry": 2}


def _data(n=600, seed=1):
    g = random.Random(seed)
    rows = []
    for _ in range(n):
        a, m = g.choice("abc"), float(g.choice([10, 20, 30, 40]))
        rows.append((a, m, "1" if (a == "a") == (m > 20) else g.choice("23")))
    return pd.DataFrame(rows, columns=["a", "m", "y"])


def _cells(df):
    t = df.groupby(["a", "m"])["y"].value_counts().unstack(fill_value=0).reset_index()
    return t[["a", "m"]], t[["1", "2", "3"]].to_numpy(float)


def test_cells_equal_rows():
    df = _data()
    x, c = _cells(df)
    p, rounds = B.boost(*B.encode(x, ["a", "m"]), c, SET, 3)
    rows = np.array([[y == k for k in "123"] for y in df["y"]], float)
    q, again = B.boost(*B.encode(df, ["a", "m"]), rows, SET, 3)
    at = {(a, m): i for i, (a, m) in enumerate(x.itertuples(index=False))}
    assert rounds == again and np.allclose(q, p[[at[a, m] for a, m in zip(df["a"], df["m"])]])
    share = c / c.sum(1, keepdims=True)
    assert np.abs(p - share).max() < 0.1


def test_folds_add_no_entries(monkeypatch):
    df, seen, grow = _data(), [], B._grow
    df["fold"] = df.index % 10
    per = df.groupby(["a", "m", "fold"])["y"].value_counts().unstack(fill_value=0).reset_index()
    monkeypatch.setattr(B, "_grow", lambda *a: seen.append(len(a[3])) or grow(*a))
    p, rounds = B.boost(*B.encode(per, ["a", "m"]), per[["1", "2", "3"]].to_numpy(float), SET, 3)
    x, c = _cells(df)
    assert len(per) > 5 * len(x) and max(seen) == 3 * len(x)
    q, again = B.boost(*B.encode(x, ["a", "m"]), c, SET, 3)
    at = {(a, m): i for i, (a, m) in enumerate(x.itertuples(index=False))}
    assert rounds == again and np.allclose(p, q[[at[a, m] for a, m in zip(per["a"], per["m"])]])
    # sampled cell by cell, and the same whatever the order in which equal tuples come
    sampled, _ = B.boost(*B.encode(per, ["a", "m"]), per[["1", "2", "3"]].to_numpy(float), SET | {"sample_size": 0.5}, 3)
    assert np.allclose(sampled.sum(1), 1) and max(seen) == 3 * len(x)


def test_stops_without_progress():
    x, c = _cells(_data())
    assert B.boost(*B.encode(x, ["a", "m"]), c, SET | {"learn_rate": 0.0, "trees": 500}, 1)[1] == 6


def test_hand_till_by_pairs():
    g = np.random.default_rng(0)
    p, c = g.dirichlet([1, 1, 1], 12).round(1), g.integers(0, 4, (12, 3)).astype(float)
    total = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for a, b in ((i, j), (j, i)):
            w = sum(c[s, a] * c[t, b] * ((p[s, a] > p[t, a]) + 0.5 * (p[s, a] == p[t, a])) for s in range(12) for t in range(12))
            total.append(w / (c[:, a].sum() * c[:, b].sum()))
    assert abs(B.hand_till(p, c) - np.mean(total)) < 1e-12
    assert B.hand_till(p, c * [1, 0, 0]) is None


def test_tuning_and_final_fit(spark):
    df = spark.createDataFrame(_data().assign(cluster=lambda d: d["y"], fold=lambda d: d.index % 3, id=lambda d: d.index))
    grid = [SET, SET | {"trees": 1, "learn_rate": 1e-6}, SET | {"tree_depth": 1, "sample_size": 0.5}]
    tuned = B.tune_cells(df, "fold", ["a", "m"], grid)
    rows = {r["grid_point"]: r for r in tuned.collect()}
    assert len(rows) == 3 and all(r["folds"] == 3 for r in rows.values())
    best = B.best_point(tuned)
    assert best["trees"] == 40
    out = B.fit_predict_cells(df, df, ["a", "m"], best)
    assert out.count() == 600
    assert out.where("(pred_class = '1') = (cluster = '1')").count() > 590


def test_reports_use_the_tuned_point(spark, monkeypatch):
    from nutriyield.plans import catalog_models as C
    df = spark.createDataFrame(_data().assign(cluster=lambda d: d["y"], fold=lambda d: d.index % 3, id=lambda d: d.index))
    tuned = B.tune_cells(df, "fold", ["a", "m"], [SET | {"sample_size": 0.7}, SET | {"trees": 1, "learn_rate": 1e-6}])
    monkeypatch.setattr(C, "_tuned", lambda i, gn: (df.where("id >= 100"), df.where("id < 100"), ["a", "m"], tuned))
    model, tr, te = C._fit(None, True)
    assert model.params == B.best_point(tuned) and model.params["trees"] == 40
    final = {r["id"]: r for r in B.fit_predict_cells(tr, te, ["a", "m"], B.best_point(tuned)).collect()}
    alone = {(r["a"], r["m"]): r["pred_1"] for r in model.transform(spark.createDataFrame([("a", 30.0), ("new", 15.0)], "a string, m double")).collect()}
    for r in model.transform(te).collect():  # also without a label column and among unknown tuples
        assert r == final[r["id"]] and ((r["a"], r["m"]) != ("a", 30.0) or abs(r["pred_1"] - alone["a", 30.0]) < 1e-12)
    gain = dict(model.feature_importance())
    assert {*gain} == {"a", "m"} and abs(sum(gain.values()) - 1) < 1e-9 and min(gain.values()) > 0.1
