"""SMOTE against brute force, and exact rank selection."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from nutriyield.operators import oversample as OS
from nutriyield.operators import verbs as V


def unit(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def brute(rows, k=5, seed=1):
    by = {}
    for i, label, *x in rows:
        if label is not None and None not in x:
            by.setdefault(label, []).append((str(i), x))
    top, out = max(map(len, by.values())), []
    for label, mine in by.items():
        n, m = len(mine), top - len(mine)
        if n < 2:
            continue
        order = sorted(mine, key=lambda r: (hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest(), r[0]))
        for pos, (i, x) in enumerate(order):
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j, y) for j, y in mine if j != i)[:k]
            for number in range(1, m // n + (pos < m % n) + 1):
                _, j, y = near[int(unit(f"{seed}n", i, number) * len(near))]
                u = unit(f"{seed}u", i, number)
                out.append((i, number, j, label, *[round(a + u * (b - a), 9) for a, b in zip(x, y)]))
    return sorted(out)


def planted():
    """A large class, small ones with repeated points, one on a lattice full of ties, a pair and a lone row."""
    g = random.Random(2)
    rows = [(i, "big", g.random(), g.random()) for i in range(400)]
    rows += [(1000 + i, "small", *g.choice([(0.0, 0.0), (1.0, 1.0), (g.random(), g.random())])) for i in range(150)]
    rows += [(2000 + i, "lattice", float(g.randrange(6)), float(g.randrange(6))) for i in range(97)]
    rows += [(3000, "pair", 0.0, 0.0), (3001, "pair", 1.0, 3.0), (4000, "lone", 1.0, 1.0), (5000, None, 1.0, 1.0), (5001, "small", None, 1.0)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"part_cells": 7, "share": 10}, {"part_cells": 5, "max_ranges": 3, "share": 1000}, {"part_cells": 1}])
def test_smote_brute_force(spark, sizes):
    rows = planted()
    df = spark.createDataFrame(rows, "id int, y string, a double, b double").repartition(5)
    got = [tuple(r) for r in OS.smote(df, "y", ["a", "b"], "id", **sizes).collect()]
    assert sorted((*r[:4], round(r[4], 9), round(r[5], 9)) for r in got) == brute(rows)
    assert {c: sum(r[3] == c for r in got) for c in ("small", "lattice", "pair", "lone")} == {"small": 250, "lattice": 303, "pair": 398, "lone": 0}


def test_smote_with_nothing_to_fill(spark):
    schema = "id int, y string, a double"
    assert OS.smote(spark.createDataFrame([], schema), "y", ["a"], "id").collect() == []
    assert OS.smote(spark.createDataFrame([(1, "p", 1.0), (2, "q", 1.0)], schema), "y", ["a"], "id").columns == ["id", "number", "neighbour", "y", "a"]


def test_smote_of_dummies(spark):
    """Dummy-coded factors: many equal points, whose neighbours are each other by id."""
    g = random.Random(3)
    rows = [(i, "p" if i % 4 else "q", *[float(g.random() < 0.5) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, y string, a double, b double, c double")
    got = [tuple(r) for r in OS.smote(df, "y", ["a", "b", "c"], "id", part_cells=3).collect()]
    assert sorted((*r[:4], *[round(v, 9) for v in r[4:]]) for r in got) == brute(rows)


@pytest.mark.parametrize("limit", [1, 10, 10**6])
def test_rank_cuts(spark, limit):
    g = random.Random(5)
    rows = [(g.choice(["a", "a", "a", "b", None]), i) for i in range(500)] + [("a", 7)] * 3  # equal rows too
    df = spark.createDataFrame(rows, "s string, id int").withColumn("h", V.hash_key(9, "id"))
    by = {}
    for s, i in rows:
        by.setdefault(s, []).append((hashlib.md5(f"9|{i}".encode()).hexdigest(), i))
    want = [(s, r) for s, v in by.items() for r in (0, 1, 2, 50, len(v), len(v) + 1)]
    ranks = spark.createDataFrame(want, "s string, __rank long")
    got = {(r["s"], r["__rank"]): tuple(r["__cut"]) for r in V.rank_cuts(df, ["s"], ranks, "h", ["id"], digits=1, limit=limit).collect()}
    assert got == {(s, r): sorted(by[s])[r - 1] for s, r in want if 0 < r <= len(by[s])}
    one = V.hash_cuts(df, [], 0.5, "h", ["id"]).collect()
    assert tuple(one[0]["__cut"]) == sorted(sum(by.values(), []))[len(rows) // 2 - 1]
