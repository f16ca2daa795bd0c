"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nutriyield.llm import (bestfit_rows, byte_bpe, catalog, importance, interpolated_lm, language_bits, length_buckets, near_dups,
                            quality_lines, scaled_sketch, toxicity_gru)
from nutriyield.llm.common import word_codes
from nutriyield.plans.compare import compare, duck
from tests.conftest import SF_SMALL

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF_SMALL), name, catalog.QUERIES[name], catalog.ORACLE[name], SF_SMALL)
    assert r["cols_match"] and r["hash_match"], r


# words ---------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85 aAÉb", max_size=12)), max_size=8), st.integers(0, 3))
def test_word_codes(values, cut):
    codes, at, words = word_codes(pa.array(values, pa.string()).slice(min(cut, len(values))), lower=True)
    names = words.to_pylist()
    for i, v in enumerate(values[cut:]):
        assert [names[c] for c in codes[at[i]:at[i + 1]]] == WORD.findall((v or "").translate(LOWER))


# quality rules ---------------------------------------------------------------

def test_line_rules(spark):
    body = "This is a short text."
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(10)) + "." for i in range(8))
    cases = {
        "clean": (good, True, 8), "menu": (good + "\nHome | News | Sport | About | Contact", True, 8),
        "boilerplate": (good + "\nAll rights reserved.", True, 8), "open end": (good + "\nno end here", True, 8),
        "mostly menus": (good + "\n" + "\n".join("a | b | c | d | e | f" for _ in range(9)), False, 8), "short": (body, False, 1),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id string, text string")
    for r in quality_lines.clean_lines(df).collect():
        _, kept, lines = cases[r["doc_id"]]
        assert r["kept"] == kept and r["n_kept_lines"] == lines, r
        if kept:
            assert r["cleaned_text"] == good


def test_repeated_words_brute_force(spark):
    g = random.Random(5)
    cases = [" ".join(g.choice("abc") for _ in range(g.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    for r in quality_lines.clean_lines(df).collect():
        w = WORD.findall(cases[r["doc_id"]])
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for k in range(3)}
        assert r["n_repeat_words"] == len(covered)


# length buckets ---------------------------------------------------------------

def test_bounds_are_optimal():
    from itertools import combinations
    g = random.Random(1)
    for _ in range(60):
        x = np.array(sorted(g.sample(range(1, 40), g.randint(1, 8))))
        c = np.array([g.randint(1, 9) for _ in x])
        k = g.randint(1, 4)
        size = lambda b: sum(n * min(u for u in b if u >= v) for v, n in zip(x, c))  # noqa: E731,B023
        best = min(size([*s, x[-1]]) for m in range(min(k, len(x))) for s in combinations(x[:-1].tolist(), m))
        got = length_buckets.optimal_bounds(x, c, k)
        assert len(got) <= k and size(got) == best


def test_batches_fit_the_budget(docs):
    for ranges in (200_000, 20):  # the places don't depend on the number of ranges
        got = length_buckets.pack_buckets(docs, buckets=4, max_tokens=300, budget=1000, rows_per_range=ranges).toPandas()
        size = got.groupby(["bucket", "batch"])["padded_tokens"].sum()
        assert (size <= 1000).all()
        assert (got["n_tokens"] <= got["padded_tokens"]).all()
        if ranges == 20:
            assert first.equals(got.sort_values(["doc_id", "seg"], ignore_index=True))  # noqa: F821
        first = got.sort_values(["doc_id", "seg"], ignore_index=True)  # noqa: F841


# best-fit packing ---------------------------------------------------------------

def test_best_fit_decreasing_brute_force():
    g = random.Random(2)
    for _ in range(200):
        row = g.randint(1, 40)
        n = np.array([g.randint(1, row) for _ in range(g.randint(0, 60))], np.int64)
        room = []
        for i in np.argsort(-n, kind="stable").tolist():
            fit = [(r, k) for k, r in enumerate(room) if r >= n[i]]
            if fit:
                room[min(fit)[1]] -= int(n[i])
            else:
                room.append(row - int(n[i]))
        got = bestfit_rows.best_fit_decreasing(n, row)
        assert sorted(x for r in got for x in r) == list(range(len(n)))
        assert sorted(row - sum(int(n[i]) for i in r) for r in got) == sorted(room)


def test_packed_rows_give_the_texts_back(docs, texts, tmp_path):
    bestfit_rows.write_packed(docs, str(tmp_path / "packed"), row=256)
    packed = docs.sparkSession.read.parquet(str(tmp_path / "packed"))
    got = {r["doc_id"]: bytes(r["raw"]).decode() for r in bestfit_rows.unpack_documents(packed).collect()}
    assert got == texts
    for r in packed.limit(20).collect():
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 256 and len(r["ids"]) == 512
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        pos = bestfit_rows.position_ids(r["n_tokens"], r["position_resets"])
        assert [i for i, p in enumerate(pos) if p == 0] == r["position_resets"]
    assert packed.agg(F.avg("n_tokens")).first()[0] > 0.97 * 256


# byte-level BPE ---------------------------------------------------------------

CODEC = byte_bpe.Codec.load()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x85　'sab1.!")), st.characters(exclude_categories=["Cs"])), max_size=20), max_size=6))
def test_units_encode_as_whole_texts(values):
    ids, at = CODEC.encode_all(pa.array(values, pa.string()))
    for i, v in enumerate(values):
        assert ids[at[i]:at[i + 1]].tolist() == CODEC.encoding.encode_ordinary(v)


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    g = random.Random(4)
    text = "".join(g.choice([" ", "  ", "\n", "word", "it's", "12", "é!", "<|endoftext|>"]) for _ in range(3000))
    monkeypatch.setattr(byte_bpe, "PIECE", 50)
    assert CODEC.encode(text) == CODEC.encoding.encode_ordinary(text)


def test_encoding_round_trip(docs, texts):
    for r in byte_bpe.encode_documents(docs).collect():
        want = CODEC.encoding.encode_ordinary(texts[r["doc_id"]])
        raw = np.array(want, "<u4").tobytes()
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    assert {r["doc_id"]: bytes(r["raw"]).decode() for r in back} == texts


# language ID ---------------------------------------------------------------

def test_filters_hold_every_ngram():
    import pandas as pd
    g = np.random.default_rng(0)
    keys = g.integers(-2**62, 2**62, 5000)
    f = language_bits.build_filters(pd.DataFrame({"lang": ["a"] * 3000 + ["b"] * 2000, "key": keys}), "a", 4)
    m = f.masks(keys.view(np.uint64))[:, 0]
    assert (m[:3000] & 1).all() and (m[3000:] & 2).all()
    other = f.masks(g.integers(-2**62, 2**62, 20000).view(np.uint64))[:, 0]
    assert abs((other & 1).mean() - f.false_rate[0]) < 0.01


def test_scores_equal_plain_sets(spark):
    """Filters learned in Spark against sets of n-grams: none is lost, rare ones and those of all languages included."""
    rows = [(l, t) for l, ts in {"aa": ["the shared word", "alone once zzyzx"] + ["der hund " * 30], "bb": ["the shared word", "hund"] + ["le chien " * 30],
                                 "cc": ["the shared word"] + ["el perro " * 40]}.items() for t in ts]
    f = language_bits.learn(spark.createDataFrame(rows, "lang string, text string"))
    count = collections.defaultdict(collections.Counter)
    for l, t in rows:
        count[l].update(language_bits.ngram_keys([t], 4)[0].tolist())
    share = {l: {k: n / sum(c.values()) for k, n in c.items()} for l, c in count.items()}
    top = {k: max(s.get(k, 0) for s in share.values()) for s in share.values() for k in s}
    sets = {l: {k for k, v in s.items() if v >= 0.1 * top[k]} for l, s in share.items()}
    assert set().union(*sets.values()) == set(top)
    for k in language_bits.ngram_keys(["the shared word"], 4)[0].tolist():
        assert all(k in s for s in sets.values())
    assert f.languages == sorted(sets, key=lambda l: (-sum(count[l].values()), l))
    keys, offsets, _ = language_bits.ngram_keys(["the hund perro", "alone zzyzx", "chien", "qqqq wwww"], 4)
    got = f.scores(keys, offsets)
    for i in range(4):
        own = keys[offsets[i]:offsets[i + 1]].tolist()
        for l, name in enumerate(f.languages):
            want = sum(k in sets[name] for k in own) / len(own)
            rate = f.false_rate[l]
            assert abs(got[i, l] - max(0, (want - rate) / (1 - rate))) < 1e-9
    full = language_bits.learn(spark.createDataFrame(rows, "lang string, text string"), max_bytes=1)
    assert len(full.table) == 1 << 10 and (full.false_rate >= 0).all()
    # equal shares: the language with more learned n-grams
    named = language_bits.identify(spark.createDataFrame([(1, "the shared word")], "doc_id int, text string"), f).first()
    assert named["lang_pred"] == f.languages[0]


def test_windows_that_share_a_prefix(spark):
    from nutriyield.llm.quality_lines import repeated_words, split_words
    texts = ["a b c d a b c e a b c", " ".join(f"w{i % 7} x{i % 5} y{i % 3}" for i in range(60)), " ".join(f"w{i * i % 11}" for i in range(80)), "a b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain, clashing = (repeated_words(split_words(F.col("t")), b) for b in (0, 61))
    for r in df.select("t", plain.alias("p"), clashing.alias("c")).collect():
        w = r["t"].split()
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        want = len({i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)})
        assert r["p"] == r["c"] == want


def test_language_of_held_out_documents(spark):
    got = catalog.QUERIES["op7_language_bits"](spark, SF_SMALL).toPandas()
    want = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(want, on="doc_id")
    assert m[m.held_out].eval("lang == lang_pred").mean() > 0.97
    assert (m["held_out"] == m["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()


# near duplicates ---------------------------------------------------------------

def brute_components(texts, n=2):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, both in collections.Counter(e for x in s for e in where[x] if e > d).items():
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def check_components(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    comp, size = brute_components(texts)
    for r in near_dups.near_duplicates(df).collect():
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (comp[r["doc_id"]], size[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"]), r


def test_classes_match_brute_force(spark, texts):
    check_components(spark, texts)


def test_classes_of_chains_and_stars(spark):
    """Copies of one text that are near the original but often not near each other, and whose smallest id is a poor hub."""
    g = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = {100: " ".join(base)}
    for i in range(60):
        w = list(base)
        for _ in range(g.randint(2, 7)):
            w[g.randrange(len(w))] = f"x{g.randrange(9999)}"
        texts[i] = " ".join(w)
    for i in range(40):  # a chain: each is near the next only
        texts[200 + i] = " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))
    check_components(spark, texts)


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    test_classes_of_chains_and_stars(spark)


def test_split_join_of_a_heavy_key(spark):
    """A key with a third of the rows is split, none is lost or doubled, and the list of heavy keys is short."""
    rows = spark.range(3000).selectExpr("id AS doc", "if(id % 3 = 0, -1, id div 2) AS key")
    groups = rows.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("members")).where("members > 1")
    got = near_dups.split_join(rows, groups, "key", "doc", 3000)
    want = rows.join(groups, "key")
    assert got.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(*want.columns)).isEmpty()
    assert got.where("key = -1").select("part").distinct().count() > 200
    assert got.groupBy("key", "part").count().agg(F.max("count")).first()[0] < 20


# language model ---------------------------------------------------------------

def test_base_score_and_gain(spark, texts):
    got = catalog.QUERIES["op5_deleted_interpolation"](spark, SF_SMALL).toPandas()
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum()


def test_interpolation_brute_force(spark, texts, monkeypatch):
    """Scores from plain counts with the learned weights, and the same scores whatever the blocks."""
    monkeypatch.setattr(interpolated_lm, "BLOCK_BYTES", 20_000)
    kept = []
    real = interpolated_lm.mixture_weights
    monkeypatch.setattr(interpolated_lm, "mixture_weights", lambda h, order: kept.append(real(h, order)) or kept[-1])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = interpolated_lm.score_documents(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, order=3).collect()
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), "</s>"] for d, t in texts.items()}
    learned = [["<s>", "<s>", *ws] for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    grams = [collections.Counter(tuple(ws[i - k:i + 1]) for ws in learned for i in range(1 if k < 2 else 2, len(ws)) if i >= k) for k in range(3)]
    total = sum(c for g, c in grams[0].items() if g != ("<s>",))
    types = sum(g != ("<s>",) for g in grams[0])
    for r in got:
        ws, score = ["<s>", "<s>", *tokens[r["doc_id"]]], 0.0
        for i in range(2, len(ws)):
            g = tuple(ws[i - 2:i + 1])
            context = grams[1][g[:2]]
            p = [1 / (types + 1), grams[0][g[2:]] / total, grams[1][g[1:]] / max(grams[0][g[1:2]], 1), grams[2][g] / max(context, 1)]
            b = min(int(np.ceil(np.log2(context + 1))), interpolated_lm.BUCKETS - 1)
            score += np.log10(kept[0][b] @ p)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_query_counts_trigrams(spark, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "score_documents", lambda docs, held_out, order=2: order)
    assert catalog.QUERIES["op5_deleted_interpolation"](spark, SF_SMALL) == 3


def test_weights_maximise_the_likelihood():
    import pandas as pd
    h = pd.DataFrame({"bucket": [1, 1, 1], "q1": [8, 40, -9999], "q2": [80, -9999, 16], "n": [50, 30, 20]})
    w = interpolated_lm.mixture_weights(h, 2, steps=500)[1]
    r = np.array([[1, 2, 2**10], [1, 32, 0], [1, 0, 4]])
    like = lambda w: (h["n"] * np.log(r @ w)).sum()
    g = np.random.default_rng(0)
    assert w.sum() == pytest.approx(1) and all(like(w) >= like(x) - 1e-3 for x in g.dirichlet([1, 1, 1], 2000))
    assert np.allclose(interpolated_lm.mixture_weights(h, 2)[7], interpolated_lm.mixture_weights(h.assign(bucket=7), 2)[7])


# fingerprints ---------------------------------------------------------------

def test_edits_follow_falling_ids(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in scaled_sketch.edit_report(df).collect()}
    ids = sorted(texts, reverse=True)
    for d, e in zip(ids, ids[1:] + ids[:1]):
        t = texts[d]
        m = len(t) // 3
        want = t[:len(t) - m] + texts[e][:m]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        own, new, nxt = (scaled_sketch.sketches([x])[0] for x in (t, want, texts[e]))
        assert r["fingerprint"] == scaled_sketch.as_text(own) and r["edited_fingerprint"] == scaled_sketch.as_text(new)
        assert (r["near_edited"], r["near_next"]) == (scaled_sketch.compare(own, new)[0], scaled_sketch.compare(own, nxt)[0])
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.97


def test_sketch_estimates_and_merges():
    g = random.Random(6)
    word = lambda: "".join(g.choice(string.ascii_lowercase) for _ in range(6))
    big = " ".join(word() for _ in range(20_000))
    part = big[:30_000]
    a, b = scaled_sketch.sketches([big, part])
    assert scaled_sketch.compare(a, b)[1] > 0.99  # contained, though very unequal
    assert abs(scaled_sketch.compare(a, b)[0] - len(part) / len(big)) < 0.03
    rest = scaled_sketch.sketches([big[30_000 - 8:]])[0]
    assert (scaled_sketch.merge(b, rest) == a).all()
    assert (scaled_sketch.from_text(scaled_sketch.as_text(a)) == a).all()


def test_short_texts_in_long_ones():
    g = random.Random(12)
    big = "".join(g.choice(string.ascii_letters) for _ in range(60_000))
    long = scaled_sketch.sketches([big])[0]
    for n, error in ((50, 0.2), (92, 0.15), (200, 0.1), (500, 0.065)):
        starts = [g.randrange(len(big) - n) for _ in range(200)]
        inside = [scaled_sketch.compare(long, s)[1] for s in scaled_sketch.sketches([big[a:a + n] for a in starts])]
        assert {*inside} <= {1.0, None} and inside.count(None) <= 4  # contained, or unknown, never 0
        half = [big[a:a + n // 2] + "".join(g.choice(string.digits) for _ in range(n - n // 2)) for a in starts]
        true = (n // 2 - 8) / (n - 8)
        found = np.array([scaled_sketch.compare(long, s)[1] for s in scaled_sketch.sketches(half)], dtype=float)
        assert np.sqrt(np.nanmean((found - true) ** 2)) < 1.3 * error
    none = scaled_sketch.sketches([big[i:i + 12] for i in range(400)])
    assert None in [scaled_sketch.compare(long, s)[1] for s in none] and 0.0 not in [scaled_sketch.compare(long, s)[1] for s in none]


# importance ---------------------------------------------------------------

def test_kth_largest(spark):
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(size=3000), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 2, 1000, 1500, 3500):
        assert importance.kth_largest(df, "v", k, bins=8, exact_below=50) == np.sort(x)[::-1][k - 1]


def test_resampling_prefers_the_target(spark):
    got = catalog.QUERIES["op10_importance"](spark, SF_SMALL).toPandas()
    assert got["kept"].sum() == int(np.ceil(0.8 * len(got)))
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet").toPandas()
    m = got.merge(lab, on="doc_id")
    assert m[m.quality == 1]["kept"].mean() > m[m.quality == 0]["kept"].mean()


def test_gumbel_noise():
    x = importance.gumbel(np.arange(200_000), 7)
    assert abs(x.mean() - 0.5772) < 0.01 and abs(x.var() - np.pi**2 / 6) < 0.03


# toxicity ---------------------------------------------------------------

def test_gradients():
    import pandas as pd
    s = toxicity_gru.Settings(window=5, word_dim=3, char_dim=2, hidden=3, attention=2, char_buckets=64)
    net = toxicity_gru.Network(s, pd.Index(["ab", "cd"]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    known, grams, at = net.describe(["ab", "cd", "efg", "", "hij"])
    windows, d = np.array([[0, 1, 2, 3, 4], [2, 2, 1, 0, 0], [4, 3, 0, 1, 2]]), np.array([1.0, -2.0, 0.5])
    loss = lambda: float((net.forward(net.inputs(known, grams, at)[1], windows) * d).sum())
    e, table = net.inputs(known, grams, at)
    g, used, d_table = net.backward(table, windows, net.forward(table, windows, keep=True)[1], d)
    d_all = np.zeros(table.shape)
    d_all[used] = d_table
    g["x"], g["xb"] = e.T @ d_all, d_all.sum(0)
    for k, grad in g.items():
        flat, gf = net.p[k].reshape(-1), np.asarray(grad).reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-4 == pytest.approx(gf[i], abs=2e-4), k


def test_toxic_words_are_learned(spark):
    g = random.Random(8)
    word = lambda: "".join(g.choice(["th", "er", "in", "on", "at", "es"]) for _ in range(g.randint(1, 3)))
    data, lab = [], []
    for i in range(240):
        w = [word() for _ in range(g.randint(20, 150))]
        if i % 3 == 0:
            for _ in range(3):
                w[g.randrange(len(w))] = "grumpf" + g.choice(["", "er", "ung"])
        data.append((i, " ".join(w)))
        lab.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame(lab, "doc_id bigint, toxic int")
    net = toxicity_gru.fit(docs, labels.where("doc_id < 160"), toxicity_gru.Settings(steps=150))
    got = {r["doc_id"]: r["score"] for r in toxicity_gru.score_toxicity(docs, net).collect()}
    held = [i for i in range(160, 240)]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.9


def test_passages_between_spread_windows_are_learned(spark):
    g = random.Random(9)
    word = lambda: "".join(g.choice(["th", "er", "in", "on", "at", "es"]) for _ in range(g.randint(1, 3)))
    data = []
    for i in range(160):
        w = [word() for _ in range(32 + 24 * 39)]  # 40 windows; of 16 evenly spread ones none holds words 272 to 311
        if i % 2 == 0:
            for k in (280, 284, 299):
                w[k] = "grumpf" + g.choice(["", "er", "ung"])
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic")
    net = toxicity_gru.fit(docs, labels.where("doc_id < 100"), toxicity_gru.Settings(steps=100))
    got = {r["doc_id"]: r["score"] for r in toxicity_gru.score_toxicity(docs, net).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 2 == 0) for i in range(100, 160)]) > 0.9


def test_merged_sketches_are_those_of_the_joined_text(monkeypatch):
    g = random.Random(13)
    word = lambda n: "".join(g.choice(string.ascii_letters) for _ in range(n))
    for n, m in ((1, 40), (5, 30), (100, 120), (250, 300), (4000, 90), (2500, 3000)):
        joined = word(n + m + 8)
        a, b = scaled_sketch.sketches([joined[:n + 8], joined[n:]])
        assert (scaled_sketch.merge(a, b) == scaled_sketch.sketches([joined])[0]).all()
    # long texts are worked through in pieces
    texts = [word(n) for n in (0, 3, 700, 12, 5000, 1300)] + ["ab" * 4000, word(20_001)]
    whole = scaled_sketch.sketches(texts)
    monkeypatch.setattr(scaled_sketch, "PIECE", 600)
    assert all((a == b).all() for a, b in zip(whole, scaled_sketch.sketches(texts), strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=20))
def test_fingerprint_round_trip(values):
    s = np.array(sorted(values), np.uint64)
    assert (scaled_sketch.from_text(scaled_sketch.as_text(s)) == s).all()


def test_window_logits_do_not_depend_on_the_batch():
    s = toxicity_gru.Settings()
    net = toxicity_gru.Network(s, pd.Index([f"w{i}" for i in range(50)]))
    words = [f"w{i}x" if i % 3 else f"w{i}" for i in range(300)]
    table, g = net.gate_table(words), np.random.default_rng(2)
    windows = g.integers(0, 300, (2500, s.window))
    whole = net.logits(windows, table)
    for at in ([7], [2499, 3], range(11, 1400), range(1900, 2500)):
        assert (net.logits(windows[list(at)], table) == whole[list(at)]).all()
    some = [17, 250, 3, 299]
    assert (net.gate_table([words[i] for i in some]) == table[some]).all()
    assert np.allclose(whole, net.forward(table, windows), atol=1e-5)
