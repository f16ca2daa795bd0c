"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters the network as its own embedding (frequent training words) joined
with the mean embedding of its character n-grams (every word, known or not).
One recurrent pass runs over a window in each direction, attention pools the
states, and a logistic unit scores the window.  All overlapping windows of a
text are scored; the text's score is that of its worst window, calibrated on
documents set aside.

Labels belong to documents, not windows: in training the worst window of a
toxic document is taught as toxic, all windows of a clean one as clean.  The
training sample is bounded in labelled rows only: at most ``max_docs`` documents
a class (those with the smallest hash of their id), each with every window of
its text.  Scoring covers every window of every row, and so does calibration.
Everything is numpy, without randomness beyond a fixed seed.

Defined cases: a null, empty or blank text scores 0; a text shorter than a
window is repeated until it fills one; several labels of one id count as toxic
if one is; without labels of both classes every score is 0; repeated rows score
alike.  Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import U64, mix, share, shared, shared_table, slices, word_codes

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_…«»“”„’¡¿"


@dataclass(frozen=True)
class Settings:
    window: int = 32
    stride: int = 24
    word_dim: int = 12
    char_dim: int = 12
    hidden: int = 8
    attention: int = 8
    max_words: int = 8192
    char_buckets: int = 1 << 14
    max_docs: int = 3000
    steps: int = 300
    batch_docs: int = 16
    chunk: int = 1024  # windows in one backward pass
    rate: float = 0.01
    min_docs: int = 3  # a word needs so many training documents to have its own embedding
    word_dropout: float = 0.3
    decay: float = 0.002
    char_scale: float = 0.1
    set_aside: float = 0.2
    warm_up: float = 0.3  # share of the steps that pick worst windows by the words' log odds
    seed: int = 11


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def normal(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), PUNCTUATION)


def char_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of 3 and 4 code points of ``<word>``, sorted by word, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    owner = np.repeat(np.arange(len(words)), size)
    keys, who = [], []
    run = cp.copy()
    for n in (2, 3, 4):
        run = run[:-1] * U64(0x110001) + cp[n - 1:] if len(run) > 1 else run[:0]
        whole = owner[: len(run)] == owner[n - 1:n - 1 + len(run)]
        use = whole if n > 2 else whole & (size[owner[: len(run)]] == 2)  # a run of 2 only stands for the marked empty word
        keys.append(mix(run[use] + U64(n)) % U64(buckets))
        who.append(owner[: len(run)][use])
    key, w = np.concatenate(keys).astype(np.int64), np.concatenate(who)
    order = np.argsort(w, kind="stable")
    return key[order], np.searchsorted(w[order], np.arange(len(words) + 1))


def window_starts(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of the overlapping windows of ``n`` words; the last one ends with the text."""
    if n <= window:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - window, stride), n - window)


@dataclass
class Network:
    s: Settings
    vocabulary: pd.Index
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        s, g = self.s, np.random.default_rng(self.s.seed)
        if not self.p:
            init = lambda *shape, scale=0.1: g.normal(0, scale, shape).astype(np.float32)
            d, h = s.word_dim + s.char_dim, s.hidden
            self.p = {"word": init(len(self.vocabulary) + 1, s.word_dim), "char": init(s.char_buckets, s.char_dim, scale=s.char_scale),
                      "x": init(d, 6 * h, scale=0.4), "xb": np.zeros(6 * h, np.float32), "u": init(2, h, 3 * h, scale=0.3),
                      "a": init(2 * h, s.attention, scale=0.5), "ab": np.zeros(s.attention, np.float32),
                      "v": init(s.attention, scale=0.5), "o": init(2 * h, scale=0.5), "ob": np.full(1, -1, np.float32)}
            self.p["word"][0] = 0

    # words -> gate inputs
    def describe(self, words: list[str]):
        """(number of each word in the vocabulary or 0, character n-grams, where they begin)."""
        known = self.vocabulary.get_indexer(words) + 1
        grams, at = char_grams(words, self.s.char_buckets)
        return known, grams, at

    def inputs(self, known: np.ndarray, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros((0, self.s.word_dim + self.s.char_dim), np.float32), np.zeros((0, 6 * self.s.hidden), np.float32)
        e = self.embed(known, grams, at)
        return e, e @ self.p["x"] + self.p["xb"]

    def embed(self, known: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(self.p["char"][grams], at[:-1], axis=0) / np.diff(at)[:, None].astype(np.float32)
        return np.hstack([self.p["word"][known], mean])

    def gate_table(self, words: list[str], chunk: int = 9_600) -> np.ndarray:
        """Gate inputs of each word, summed in a fixed order: a word's row does not depend on the others."""
        parts = []
        for i in range(0, len(words), chunk):
            some = words[i:i + chunk]
            e = self.embed(*self.describe(some + some[:1] * (chunk - len(some))))
            parts.append((np.einsum("nk,kj->nj", e, self.p["x"]) + self.p["xb"])[: len(some)])
        return np.concatenate(parts) if parts else np.zeros((0, 6 * self.s.hidden), np.float32)

    # windows -> logits
    def forward(self, table: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logit of each window (``keep``: and what the way back needs); ``windows`` (n, T) are rows of ``table``."""
        h, (n, steps) = self.s.hidden, windows.shape
        gates = table.reshape(-1, 2, 3 * h)
        u = self.p["u"]
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((steps, 2, n, h), np.float32)
        cache = []
        for t in range(steps):
            x = np.stack([gates[windows[:, t], 0], gates[windows[:, steps - 1 - t], 1]])
            hu = state @ u
            zr = x[:, :, :2 * h] + hu[:, :, :2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(x[:, :, 2 * h:] + r * hu[:, :, 2 * h:])
            cache.append((state, z, r, c, hu[:, :, 2 * h:]))
            state = c + z * (state - c)
            states[t] = state
        # both directions of a place side by side
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        e = np.tanh(both @ self.p["a"] + self.p["ab"])
        score = e @ self.p["v"]
        score = np.exp(score - score.max(0))
        alpha = score / score.sum(0)
        pooled = np.einsum("tn,tnh->nh", alpha, both)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return (logit, (cache, both, e, alpha, pooled)) if keep else logit

    def steady(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The same logits with every sum in a fixed order (BLAS rounds by the place in a batch); windows run along the last axis."""
        h, (n, steps) = self.s.hidden, windows.shape
        gates = table.reshape(-1, 2, 3 * h)
        state, states = np.zeros((2, h, n), np.float32), np.empty((steps, 2, h, n), np.float32)
        for t in range(steps):
            x = np.stack([gates[windows[:, t], 0].T, gates[windows[:, steps - 1 - t], 1].T])
            hu = np.einsum("dkj,dkn->djn", self.p["u"], state)
            zr = x[:, :2 * h] + hu[:, :2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = np.tanh(x[:, 2 * h:] + zr[:, h:] * hu[:, 2 * h:])
            state = c + zr[:, :h] * (state - c)
            states[t] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
        e = np.tanh(np.einsum("ka,tkn->tan", self.p["a"], both) + self.p["ab"][:, None])
        score = (e * self.p["v"][:, None]).sum(1)
        score = np.exp(score - score.max(0))
        alpha = score / score.sum(0)
        pooled = (alpha[:, None, :] * both).sum(0)
        return (pooled * self.p["o"][:, None]).sum(0) + self.p["ob"][0]

    def backward(self, table: np.ndarray, windows: np.ndarray, kept, d_logit: np.ndarray):
        """Gradients of the parameters after the gate table, and of the table's rows as (rows, gradients)."""
        h, (n, steps) = self.s.hidden, windows.shape
        cache, both, e, alpha, pooled = kept
        g = {"o": pooled.T @ d_logit, "ob": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["o"]
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, both)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["v"] = np.einsum("tn,tna->a", d_score, e)
        d_e = d_score[:, :, None] * self.p["v"] * (1 - e * e)
        g["a"] = np.einsum("tnh,tna->ha", both, d_e)
        g["ab"] = d_e.sum((0, 1))
        d_both = alpha[:, :, None] * d_pooled + d_e @ self.p["a"].T
        g["u"] = np.zeros_like(self.p["u"])
        d_gates = np.empty((steps, 2, n, 3 * h), np.float32)
        back = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, c, hc = cache[t]
            d = back + np.stack([d_both[t, :, :h], d_both[steps - 1 - t, :, h:]])
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (state - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            d_hu = np.concatenate([dz, dr, dc * r], axis=2)
            g["u"] += state.transpose(0, 2, 1) @ d_hu
            back = d * z + d_hu @ self.p["u"].transpose(0, 2, 1)
            d_gates[t] = np.concatenate([dz, dr, dc], axis=2)
        place = np.concatenate([windows.T.ravel(), windows.T[::-1].ravel()])
        rows = np.concatenate([np.pad(d_gates[:, 0].reshape(-1, 3 * h), ((0, 0), (0, 3 * h))), np.pad(d_gates[:, 1].reshape(-1, 3 * h), ((0, 0), (3 * h, 0)))])
        order = np.argsort(place, kind="stable")
        used, first = np.unique(place[order], return_index=True)
        return g, used, np.add.reduceat(rows[order], first, axis=0)

    def logits(self, windows: np.ndarray, table: np.ndarray, batch: int = 1920) -> np.ndarray:
        """Logits of windows in batches of one shape (the last is filled up), so that a window's does not depend on the others."""
        out = [np.zeros(0)]
        for i in range(0, len(windows), batch):
            some = windows[i:i + batch]
            full = some if len(some) == batch else some[np.arange(batch) % len(some)]
            out.append(self.steady(table, full)[: len(some)])
        return np.concatenate(out)

    def document_logits(self, windows: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Largest logit of each document's windows; -inf without windows."""
        logit = self.logits(windows, table)
        out = np.full(len(counts), -np.inf)
        at = np.concatenate([[0], np.cumsum(counts)])[:-1]
        full = counts > 0
        if full.any():
            out[full] = np.maximum.reduceat(logit, at[full])
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return np.where(np.isneginf(logit), 0.0, sigmoid(self.slope * np.where(np.isneginf(logit), 0, logit) + self.shift))


def windows_of(codes: np.ndarray, at: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of each text as places in ``codes``' words, and how many each text has."""
    starts = [window_starts(n, s.window, s.stride) for n in np.diff(at)]
    counts = np.array([len(x) for x in starts], np.int64)
    if not counts.sum():
        return np.zeros((0, s.window), np.int64), counts
    n = np.repeat(np.diff(at), counts)
    place = np.concatenate(starts)[:, None] + np.arange(s.window)
    return codes[np.repeat(at[:-1], counts)[:, None] + place % n[:, None]], counts


def windows_at(codes: np.ndarray, at: np.ndarray, docs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts with the numbers ``docs``, and how many each has."""
    parts = [windows_of(codes, at[d:d + 2], s) for d in docs]
    return np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts])


def train(codes: np.ndarray, at: np.ndarray, words: list[str], toxic: np.ndarray, s: Settings, prior: float) -> Network | None:
    """Fit on documents given by all their words; ``prior`` is the share of toxic documents before sampling."""
    toxic = toxic.astype(bool)
    text_at, has = at, np.diff(at) > 0
    if not (toxic & has).any() or not (~toxic & has).any():
        return None
    g = np.random.default_rng(s.seed)
    aside = (g.random(len(has)) < s.set_aside) & has
    for side in (toxic, ~toxic):  # a class with few documents is set aside and learned from
        if (side & has & ~aside).sum() < 4 or (side & aside).sum() < 2:
            aside[side] = False
    # what is set aside for calibration shapes neither the vocabulary nor the first embeddings
    seen = np.unique(np.repeat(np.arange(len(has)), np.diff(text_at)) * len(words) + codes)
    seen = seen[~aside[seen // len(words)]]
    freq = np.bincount(seen % len(words), minlength=len(words))  # documents of each word
    frequent = np.argsort(-freq, kind="stable")[: s.max_words]
    net = Network(s, pd.Index([words[i] for i in frequent if freq[i] >= s.min_docs], dtype=object))
    pos, neg = (np.nonzero(side & has & ~aside)[0] for side in (toxic, ~toxic))
    known, grams, at = net.describe(words)
    start_from_odds(net, seen, freq, toxic, aside, known, grams, at)
    # until the network knows anything, the worst window is the one with the most telling words
    evidence = np.concatenate([np.exp(2 * net.embed(known[i:i + 40_000], grams[at[i]:at[min(i + 40_000, len(known))]], at[i:i + 40_001] - at[i])[:, [0, s.word_dim]].sum(1))
                               for i in range(0, len(known), 40_000)])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, s.steps + 1):
        docs = np.concatenate([g.choice(pos, s.batch_docs, replace=len(pos) < s.batch_docs), g.choice(neg, s.batch_docs, replace=len(neg) < s.batch_docs)])
        windows, size = windows_at(codes, text_at, docs, s)
        owner = np.repeat(np.arange(len(docs)), size)
        rows, local = np.unique(windows, return_inverse=True)
        local = local.reshape(-1, s.window)
        gram_n = at[rows + 1] - at[rows]
        own = grams[np.repeat(at[rows] - (np.cumsum(gram_n) - gram_n), gram_n) + np.arange(gram_n.sum())]
        own_at = np.concatenate([[0], np.cumsum(gram_n)])
        seen_as = np.where(g.random(len(rows)) < s.word_dropout, 0, known[rows])
        e, table = net.inputs(seen_as, own, own_at)
        logit = net.logits(local, table)
        # the worst window of a toxic document, every window of a clean one (half its weight is on the worst, which scores the text)
        begin = np.cumsum(size) - size
        bad = evidence[windows].sum(1) if step <= s.steps * s.warm_up else logit
        worst = np.array([a + int(np.argmax(bad[a:a + n])) for a, n in zip(begin, size)])
        weight = np.where(owner < s.batch_docs, 0.0, 0.5 / size[owner])
        weight[worst] += np.where(owner[worst] < s.batch_docs, 1.0, 0.5)
        taught = weight > 0
        weight = weight[taught] / (2 * s.batch_docs)
        target = (owner < s.batch_docs)[taught].astype(np.float64)
        d_all, grad, local = np.zeros_like(table), {}, local[taught]
        for i in range(0, len(local), s.chunk):
            part = slice(i, i + s.chunk)
            logit, kept = net.forward(table, local[part], keep=True)
            d_logit = ((sigmoid(logit) - target[part]) * weight[part]).astype(np.float32)
            more, used, d_table = net.backward(table, local[part], kept, d_logit)
            d_all[used] += d_table
            grad = {k: grad[k] + v if grad else v for k, v in more.items()}
        grad["x"], grad["xb"] = e.T @ d_all, d_all.sum(0)
        d_e = d_all @ net.p["x"].T
        grad["word"] = np.zeros_like(net.p["word"])
        np.add.at(grad["word"], seen_as, d_e[:, : s.word_dim])
        grad["word"][0] = 0
        spread = np.repeat(d_e[:, s.word_dim:] / gram_n[:, None], gram_n, axis=0)
        order = np.argsort(own, kind="stable")
        ids, start = np.unique(own[order], return_index=True)
        grad["char"] = np.zeros_like(net.p["char"])
        grad["char"][ids] = np.add.reduceat(spread[order], start, axis=0)
        rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1)))
        for k, v in net.p.items():
            m, q = moments[k]
            m += 0.1 * (grad[k] - m)
            q += 0.01 * (grad[k] ** 2 - q)
            if k in ("word", "char", "x"):
                v *= 1 - s.decay
            v -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    table = net.gate_table(words)
    check = aside if (aside & toxic).any() and (aside & ~toxic).any() else has
    chosen = np.nonzero(check)[0]
    score = np.concatenate([net.document_logits(*windows_at(codes, text_at, chosen[i:i + 64], s), table) for i in range(0, len(chosen), 64)])
    calibrate(net, score, toxic[chosen], prior)
    return net


def start_from_odds(net: Network, seen: np.ndarray, freq: np.ndarray, toxic: np.ndarray, aside: np.ndarray, known: np.ndarray, grams: np.ndarray, at: np.ndarray) -> None:
    """First dimension of each embedding: log odds of the training documents (none set ``aside``) that hold the word or n-gram.

    A start that the training steps go on from; with few labels it spares the search for the telling words.
    """
    n = len(freq)
    hot = np.bincount(seen[toxic[seen // n]] % n, minlength=n)
    cold = freq - hot
    docs = np.array([(toxic & ~aside).sum(), (~toxic & ~aside).sum()])
    odds = lambda a, b, x, y: np.clip(np.log((a + 0.5) / (x + 1)) - np.log((b + 0.5) / (y + 1)), -3, 3)
    net.p["word"][known, 0] = odds(hot, cold, *docs) / 2
    net.p["word"][0] = 0
    per = np.diff(at)
    a, b = (np.bincount(grams, np.repeat(x, per), len(net.p["char"])) for x in (hot, cold))
    net.p["char"][:, 0] = np.where(a + b > 0, odds(a, b, a.sum(), b.sum()) / 2, 0)


def calibrate(net: Network, logit: np.ndarray, toxic: np.ndarray, prior: float, steps: int = 200) -> None:
    """Logistic fit of the label on the document's logit, classes weighted as before sampling."""
    x = np.clip(logit, -15, 15)
    w = np.where(toxic, prior / max(toxic.sum(), 1), (1 - prior) / max((~toxic).sum(), 1))
    y = np.where(toxic, 1 - 1 / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    b = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(steps):
        p = sigmoid(design @ b)
        grad = design.T @ (w * (p - y)) + np.array([1e-3 * (b[0] - 1), 0])
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        b -= np.clip(np.linalg.solve(hess, grad), -1, 1)
    net.slope, net.shift = max(float(b[0]), 0.05), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Network | None:
    """Train on ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text)."""
    s = s or Settings()
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"] > 0: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    side = lambda c: known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_docs)
    chosen = shared_table(side("toxic > 0").unionByName(side("toxic <= 0")), "chosen")  # 2 * max_docs rows

    def packed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, at, words = word_codes(part.column("text"))
                plain = normal(words).dictionary_encode()
                codes = plain.indices.to_numpy(zero_copy_only=False).astype(np.int32)[codes] if len(codes) else codes
                texts = [np.unique(codes[a:b], return_inverse=True) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([
                    part.column("place"), part.column("toxic").cast(pa.int32()),
                    pa.array([zstandard.compress(ids.astype("<u4").tobytes()) for _, ids in texts], pa.binary()),
                    pa.array([plain.dictionary.take(pa.array(own, pa.int32())).to_pylist() for own, _ in texts], pa.list_(pa.string()))],
                    ["place", "toxic", "ids", "words"])

    rows = docs.join(F.broadcast(chosen), "doc_id")
    # places by hash: the same order in any partitioning
    got = rows.select(F.xxhash64("doc_id", "text").alias("place"), "text", (F.col("toxic") > 0).cast("int").alias("toxic")) \
        .mapInArrow(packed, "place bigint, toxic int, ids binary, words array<string>")
    table = got.toArrow()  # the texts of 2 * max_docs labelled documents as word ids
    order = np.argsort(table["place"].to_numpy(), kind="stable")
    lists, ids, toxic = table["words"].combine_chunks().take(pa.array(order)), table["ids"].combine_chunks(), table["toxic"].to_numpy()[order]
    if not len(lists.flatten()):
        return None
    plain = lists.flatten().dictionary_encode()
    number, first = plain.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.diff(lists.offsets.to_numpy()).cumsum()
    first = np.concatenate([[0], first])
    texts = [number[first[i] + np.frombuffer(zstandard.decompress(ids[int(o)].as_buffer()), "<u4")] for i, o in enumerate(order)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    return train(np.concatenate(texts), at, plain.dictionary.to_pylist(), toxic, s, size[True] / (size[True] + size[False]))


def score_toxicity(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_windows) for every row."""
    model = share(docs.sparkSession, net)  # fixed size: see Settings

    def run(batches):
        m: Network | None = shared(model)
        for batch in batches:
            for part in slices(batch, "text", 12_000_000):
                n = part.num_rows
                if m is None:
                    score, counts = np.zeros(n), np.zeros(n, np.int64)
                else:
                    codes, at, words = word_codes(part.column("text"))
                    plain = normal(words).dictionary_encode()
                    table = m.gate_table(plain.dictionary.to_pylist())
                    codes = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else codes
                    windows, counts = windows_of(codes, at, m.s)
                    score = m.probability(m.document_logits(windows, counts, table))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(counts)], ["doc_id", "score", "n_windows"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_windows bigint")
