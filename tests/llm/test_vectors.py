"""Whitening, exact top-k search and vector codes against brute force, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nutriyield.llm import part_codes, pivot_topk, vectors, whitening
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
CLASHES = ["id", "vector", "query", "cell", "code", "q", "g", "tile", "error", "n", "d", "i", "j", "s", "p", "e", "rank", "score", "component", "salt"]


def odd_rows(d=16, seed=3):
    """Usable rows with repeats and ties, and rows that take no part."""
    g = np.random.default_rng(seed)
    rows = [(int(i), g.normal(size=d).round(1).tolist(), int(i) % 3 or None) for i in range(120)]
    rows += [(7, rows[7][1], 1), (50, rows[50][1], None), (50, rows[3][1], 2), (1000, rows[0][1], 0), (None, rows[0][1], 0), (None, rows[5][1], None), (-50, rows[9][1], 1)]
    bad = [(200, None, 1), (250, [*rows[0][1][:-1], None], 1), (300, [*rows[0][1][:-1], math.nan], 1), (350, [*rows[0][1][:-1], math.inf], 1),
           (400, [*rows[0][1][:-1], -math.inf], 1), (450, [], 1), (500, [1.0] * (d - 1), 1), (None, None, None)]
    return rows, bad


def brute_topk(rows, k, every, scale=256):
    out = []
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows]
    for qi, q in whole:
        if qi is None or qi % every:
            continue
        found = sorted(((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for i, v in whole if i != qi))[:k]
        out += [(qi, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(found)]
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 28), st.integers(0, 2**32))
def test_limb_products_are_exact(d, bits, seed):
    g = np.random.default_rng(seed)
    a, b = g.integers(-2**bits, 2**bits, (7, d)), g.integers(-2**bits, 2**bits, (5, d))
    assert (vectors.exact_products(a, b) == a @ b.T).all()
    for m in (a, b):
        parts = vectors.limbs(m, vectors.limb_bits(d))
        assert (sum(p.astype(np.int64) << (vectors.limb_bits(d) * i) for i, p in enumerate(parts)) == m).all()
        assert all(np.abs(p).max() ** 2 * d < 2**53 for p in parts)


@pytest.mark.parametrize("sizes", [{}, {"group_queries": 1, "tile_rows": 9}, {"max_pivots": 1}, {"max_pivots": 3, "group_queries": 4, "tile_rows": 2}])
@pytest.mark.parametrize("scale", [256, 2**24])
def test_topk_brute_force(spark, sizes, scale):
    rows, bad = odd_rows()
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(4)
    got = pivot_topk.top_products(df, F.col("vec_id") % 10 == 0, scale=scale, **sizes).collect()
    assert sorted(map(tuple, got), key=str) == brute_topk(rows, 5, 10, scale)


def test_topk_on_tight_groups_passes_rows_over(spark):
    """Far apart groups: rows of one do not travel to the queries of another, and no answer changes."""
    g = np.random.default_rng(1)
    middle = np.eye(16)[:6] * 5
    rows = [(i, (middle[i % 6] + g.normal(size=16) * 0.02).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pivot_topk.top_products(df, F.col("vec_id") % 25 == 0).collect()
    assert sorted(map(tuple, got), key=str) == brute_topk(rows, 5, 25)
    x = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64)
    cells = pivot_topk.Cells(x[:6], 256, "<i2")
    products, cell, away, length = cells.place(x)
    for c in range(6):
        cells.radius[c] = cells.reach[c] = away[cell == c].max() * (1 + 1e-9)
    cells.bound = np.sort(cells.lowest(products, length), axis=0)[-6]
    assert cells.needed(products, cell, length, cells.meet()).mean() < 0.2


def test_topk_with_few_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (50, [-1.0, 0.0], 1)]
    got = pivot_topk.top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got), key=str) == brute_topk(rows, 5, 50)
    assert pivot_topk.top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 77).collect() == []


def brute_codes(rows, parts, entries, rounds, scale=256):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(scale * c) for c in v] for _, v, _ in rows], dtype=object)
    n, d = x.shape
    w = d // parts
    books = [x[:entries, p * w:(p + 1) * w].copy() for p in range(parts)]

    def assign(p):
        far = [[sum((a - b) ** 2 for a, b in zip(r, c)) for c in books[p]] for r in x[:, p * w:(p + 1) * w]]
        return [min(range(len(f)), key=lambda e: (f[e], e)) for f in far], [min(f) for f in far]
    for _ in range(rounds):
        for p in range(parts):
            at, _ = assign(p)
            for e in range(len(books[p])):
                mine = [x[i, p * w:(p + 1) * w] for i in range(n) if at[i] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    codes, errors = zip(*[assign(p) for p in range(parts)])
    total = [sum(e[i] for e in errors) for i in range(n)]
    label = {}
    for r, t in zip(rows, total):
        label[r[2]] = label.get(r[2], 0) + t
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{codes[p][i]:02x}" for p in range(parts)), total[i], label[r[2]], digest) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("parts,entries,scale,few", [(4, 9, 256, 100), (16, 64, 256, 0), (2, 200, 2**24, 100)])
def test_codes_brute_force(spark, parts, entries, scale, few):
    rows, bad = odd_rows()
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(3)
    got = part_codes.compress(df, parts=parts, entries=entries, scale=scale, few_labels=few).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows, parts, entries, 2, scale)


def test_codes_beyond_a_long_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        part_codes.compress(spark.createDataFrame([(1, [1e9, 0.0], 1)], SCHEMA), parts=1).collect()


def test_cholesky_and_jacobi():
    g = np.random.default_rng(4)
    for d, rank in ((1, 1), (5, 5), (12, 7), (33, 33)):
        a = g.normal(size=(d, rank)) * 10.0 ** -g.integers(0, 5, rank)
        v = a @ a.T
        low = whitening.pivoted_cholesky(v)
        assert low.shape == (d, rank) and np.allclose(low @ low.T, v, rtol=1e-12, atol=1e-14 * np.trace(v))
        cols = whitening.orthogonal_columns(low)
        gram = cols.T @ cols
        size = np.sqrt(np.diag(gram))
        assert np.abs(gram / np.outer(size, size) - np.eye(rank)).max() < 1e-13
        assert np.allclose(np.sort(np.diag(gram)), np.linalg.eigvalsh(v)[-rank:], rtol=1e-9, atol=1e-14 * np.trace(v))
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def check_whitening(got, rows, components):
    x = np.array([[math.floor(64 * c) + 10**6 for c in v] for _, v, _ in rows], dtype=object)
    n, total = len(x), x.sum(0)
    z = (n * x - total)
    v = ((z.T @ z) / n**3).astype(np.float64)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    want = (z / n).astype(np.float64) @ basis / np.sqrt(values)
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], set()).add(r["whitened"])
        assert r["n"] == n and r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len(got) == n * components
    sign = np.ones(components)
    for k, (row, zz) in enumerate(zip(rows, z)):
        mine = by_row[(row[0], int((zz * zz).sum()))]
        assert sorted(mine) == list(range(1, components + 1))
        if row[0] is not None and sum(r[0] == row[0] for r in rows) == 1:
            have = np.array([mine[c + 1].copy().pop() for c in range(components)])
            if k == 0:
                sign = np.sign(have * want[k])
            assert np.allclose(have, sign * want[k], rtol=1e-7, atol=1e-9)
    assert all(len(v) == 1 for (i, _), m in by_row.items() if i == 7 for v in m.values())  # repeated rows agree in every bit


def test_whitening_brute_force(spark):
    rows, bad = odd_rows()
    got = whitening.whiten_embeddings(spark.createDataFrame(rows + bad, SCHEMA).repartition(3), components=11).collect()
    check_whitening(got, rows, 11)


def test_whitening_of_the_table(spark):
    df = vectors.embeddings(spark, SF_SMALL)
    rows = [tuple(r) for r in df.select("vec_id", F.col("embedding").cast("array<double>"), "label").collect()]
    check_whitening(whitening.whiten_embeddings(df).collect(), rows, 32)


def test_whitening_without_full_rank(spark):
    line = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)]
    got = whitening.whiten_embeddings(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and got[0]["explained"] == pytest.approx(1)
    assert whitening.whiten_embeddings(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)).collect() == []


def test_whitening_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i) * 1e4, 1.0], 0) for i in range(300)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [math.floor(64 * v[0]) for _, v, _ in rows]
    for i, s in enumerate(x):
        true = (300 * s - sum(x)) ** 2
        assert got[i] == (true if true < 2**63 else None)
    assert None in got.values() and any(v is not None for v in got.values())


OPERATORS = {
    "whitening": lambda df: whitening.whiten_embeddings(df, components=5).select("vec_id", "component", "deviation"),
    "topk": lambda df: pivot_topk.top_products(df, F.col("vec_id") % 10 == 0),
    "codes": lambda df: part_codes.compress(df, parts=4, entries=5),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_no_rows(spark, name):
    rows, bad = odd_rows()
    df = spark.createDataFrame(rows + bad, SCHEMA)
    run = OPERATORS[name]
    plain = sorted(map(str, run(df).collect()))
    assert sorted(map(str, run(df.withColumns({c: F.lit("x") for c in CLASHES})).collect())) == plain
    empty = run(spark.createDataFrame([], SCHEMA))
    assert empty.columns == run(df).columns and empty.collect() == []
    assert run(spark.createDataFrame(bad, SCHEMA).where("vec_id < 450 or vec_id is null")).collect() == []
