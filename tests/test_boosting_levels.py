"""Trees grown by Spark aggregates against the same trees grown in numpy."""

import numpy as np
import pandas as pd
import pytest

from nutriyield.operators import boosting as B
from nutriyield.operators import boosting_levels as L
from tests.test_boosting import SET, _data

FEATURES = ["a", "m"]


def _by_numpy(cells, params, held=None):
    pdf = cells.copy()
    counts = pdf[["n_1", "n_2", "n_3"]].to_numpy(float)
    if held is not None:
        counts[pdf["fold"] == held] = 0
    gains = np.zeros(2)
    p, rounds = B.boost(*B.encode(pdf, FEATURES), counts, params, 3, gains)
    return {(r.a, r.m): p[i] for i, r in enumerate(pdf.itertuples())}, gains


def test_levels_equal_the_cell_fit(spark):
    df = _data().assign(cluster=lambda d: d["y"], fold=lambda d: d.index % 3)
    cells = B.class_cells(spark.createDataFrame(df), FEATURES, "cluster", ["1", "2", "3"], ["fold"])
    local = cells.toPandas()
    fits = [SET | {"trees": 1, "tree_depth": 2, "fold": None}, SET | {"trees": 2, "tree_depth": 1, "min_n": 20, "loss_reduction": 0.5, "fold": 0}]
    gains = {}
    got = L.boost_levels(cells, FEATURES, ["1", "2", "3"], fits, fold="fold", gains=gains).collect()
    for i, f in enumerate(fits):
        want, total = _by_numpy(local, f, f["fold"])
        mine = [r for r in got if r["fit"] == i]
        assert len(mine) == len(want)
        for r in mine:
            assert np.allclose(r["p"], want[r["a"], r["m"]], atol=1e-9)
        assert sum(sum(r["n"]) + sum(r["held"]) for r in mine) == len(df)
        assert np.allclose([gains.get((i, c), 0) for c in FEATURES], total, atol=1e-6)


def test_bins_missing_values_and_sampling(spark):
    n = 400
    df = pd.DataFrame({"a": [None if i % 9 == 0 else "xyz"[i % 3] for i in range(n)], "m": [None if i % 11 == 0 else i * 0.37 for i in range(n)]})
    df["cluster"] = np.where(df["m"].fillna(1e9) > 70, "2", "1")
    rows = L.binned(spark.createDataFrame(df.astype(object).where(df.notna(), None), "a string, m double, cluster string"), FEATURES, 16)
    assert rows.select("m").distinct().count() <= 17 and rows.where("m is null").count() == df["m"].isna().sum()
    cells = B.class_cells(rows, FEATURES, "cluster", ["1", "2"])
    fits = [SET | {"trees": 1, "tree_depth": 2, "sample_size": 0.6}]
    runs = [{(r["a"], r["m"]): r["p"] for r in L.boost_levels(c, FEATURES, ["1", "2"], fits).collect()} for c in (cells, cells.repartition(5))]
    assert runs[0].keys() == runs[1].keys() and all(np.allclose(runs[0][k], runs[1][k], atol=1e-9) for k in runs[0])
    assert np.mean([p[1] > 0.5 for (_, m), p in runs[0].items() if m is None or m > 80]) > 0.9
    assert np.mean([p[1] < 0.5 for (_, m), p in runs[0].items() if m is not None and m < 60]) > 0.9


def test_no_rows(spark):
    empty = spark.createDataFrame([], "a string, m double, n_1 long, n_2 long")
    assert L.boost_levels(empty, FEATURES, ["1", "2"], [SET | {"trees": 2}]).count() == 0


@pytest.mark.parametrize("mtry", [1, 2, 5])
def test_chosen_predictors(mtry):
    got = L.chosen_predictors(["a", "b", "c"], mtry, 1, 0, 2, 3)
    assert len(got) == min(mtry, 3) and got == sorted(set(got))
