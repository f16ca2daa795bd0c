"""Deleted-interpolation language model over word n-grams.

A token's probability mixes the uniform distribution and the maximum-likelihood
estimates of all orders up to ``order``; the mixture depends on how often the
longest context was seen (a bucket for each power of two).  The weights are
learned by expectation-maximisation on held-out counts: an eighth of the
training documents is set aside, estimates come from the others, and the
set-aside tokens decide the weights.  Scores then use the counts of all training documents.

Counts are gathered by blocks.  A block of documents asks for each of its
distinct n-grams once, with its own counts, in one message per hash range; the
ranges add the counts of all blocks and answer every block in the order of its
question with what the other blocks counted (for most n-grams nothing, which packs well).  So a hot n-gram is one entry per block wherever it occurs, messages
follow the size of the corpus, and no task holds more than a block or a range.
The held-out histogram (bucket and estimates relative to uniform, to an eighth of
a power of two) stays a table; the driver gets N, V and its sums of each step.

Defined cases: a null or empty text is the end token alone; a row whose id is
null is held out; rows that repeat an id are learned from and scored each;
without training rows every token has probability 1 / (V + 1) = 1.  Other
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import U64, mix, pair_hash, runs, shared_table, slices, sums, word_codes, word_hashes

START, END = U64(0x5354415254000001), U64(0x454E440000000001)
BLOCK_BYTES = 6_000_000
BUCKETS = 20
TOKENS = 200_000  # tokens whose estimates are held at a time
CELLS = 8  # histogram cells per power of two


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: sorted hashes and small counts shrink well."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1) if len(a) else b""


def unpack(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _blocks(batches):
    """Documents as blocks of word numbers; role 0 isn't learned from, 1 is, 2 is set aside for the weights."""
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            codes, at, words = word_codes(part.column("text"), lower=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([pack(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))], pa.binary()),
                pa.array([pack(part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int8))], pa.binary()),
                pa.array([pack(part.column("role").to_numpy(zero_copy_only=False).astype(np.int8))], pa.binary()),
                pa.array([pack(np.diff(at))], pa.binary()), pa.array([pack(codes.astype(np.uint32))], pa.binary()),
                pa.array([pack(mix(word_hashes(words)))], pa.binary())], BLOCK_NAMES)
            number += 1


BLOCK_NAMES = ["block", "ids", "no_id", "roles", "lengths", "codes", "words"]
BLOCK_SCHEMA = "block bigint, ids binary, no_id binary, roles binary, lengths binary, codes binary, words binary"


class Block:
    """The n-grams of a block: one place per START, word and END of each document."""

    def __init__(self, roles: bytes, lengths: bytes, codes: bytes, words: bytes, order: int):
        self.order, self.keys, self.inverse = order, [], []
        for keys, inverse in self.grams(roles, lengths, codes, words, order):
            self.keys.append(len(keys))
            self.inverse.append(inverse)

    def grams(self, roles: bytes, lengths: bytes, codes: bytes, words: bytes, order: int, least: int = 1):
        """(distinct keys in order, number of each place's key) of each order from ``least``, one at a time."""
        n = unpack(lengths, np.int64)
        self.roles, self.n_tokens = unpack(roles, np.int8), n + 1
        width = n + 2
        first = np.cumsum(width) - width
        t = np.empty(int(width.sum()), U64)
        t[first], t[first + n + 1] = START, END
        t[np.repeat(first + 1, n) + runs(n)] = unpack(words, U64)[unpack(codes, np.uint32)] if n.sum() else np.zeros(0, U64)
        is_start = np.zeros(len(t), bool)
        is_start[first] = True
        self.targets = np.nonzero(~is_start)[0]
        self.role = np.repeat(self.roles, width)
        gram, chain = t, START
        for k in range(1, order + 1):
            if k > 1:
                before = np.empty_like(gram)
                before[0], before[1:] = START, gram[:-1]
                gram = pair_hash(before, t)
                chain = pair_hash(np.array([chain], U64), np.array([START], U64))[0]
                gram[is_start] = chain
            if k >= least:
                keys, inverse = np.unique(gram, return_inverse=True)
                yield keys, inverse.astype(np.int32)

    def own_counts(self, k: int, role: int) -> np.ndarray:
        return np.bincount(self.inverse[k][self.role == role], minlength=self.keys[k])


def _questions(k: int, bits: int):
    """One message per hash range: the block's n-grams of order k + 1 in order, with its learned and set-aside counts."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block.__new__(Block)
                keys, inverse = next(b.grams(row["roles"], row["lengths"], row["codes"], row["words"], k + 1, k + 1))
                learned, aside = (np.bincount(inverse[b.role == r], minlength=len(keys)) for r in (1, 2))
                part = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                cut = np.searchsorted(part, np.arange((1 << bits) + 1))
                full = [p for p in range(1 << bits) if cut[p] < cut[p + 1]]
                s = [slice(cut[p], cut[p + 1]) for p in full]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int64()), pa.array([row["block"]] * len(full), pa.int64()), pa.array([k] * len(full), pa.int32()),
                    pa.array([pack(np.diff(keys[x], prepend=U64(0))) for x in s], pa.binary()),
                    pa.array([pack(learned[x].astype(np.uint32)) for x in s], pa.binary()),
                    pa.array([pack(aside[x].astype(np.uint32)) for x in s], pa.binary())], ["part", "block", "k", "keys", "learned", "aside"])
    return run


QUESTION_SCHEMA = "part bigint, block bigint, k int, keys binary, learned binary, aside binary"
ANSWER_SCHEMA = "part bigint, block bigint, k int, learned binary, aside binary, tokens bigint, types bigint, learned_tokens bigint"


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of the other blocks for one range of one order, to each block in the order of its keys."""
    k = int(pdf["k"].iloc[0])
    asked = [np.cumsum(unpack(b, U64), dtype=U64) for b in pdf["keys"]]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    cut = np.cumsum([0, *map(len, asked)])
    del asked
    out = pd.DataFrame({"part": pdf["part"], "block": pdf["block"], "k": k, "tokens": 0, "types": 0, "learned_tokens": 0})
    total = {}
    for name in ("learned", "aside"):
        own = np.concatenate([unpack(b, np.uint32) for b in pdf[name]])
        total[name] = np.bincount(inverse, own.astype(np.float64), len(keys)).astype(np.int64)
        out[name] = [pack(total[name][inverse[a:b]] - own[a:b]) for a, b in zip(cut, cut[1:])]
    learned, aside = total["learned"], total["aside"]
    if k == 0:
        word = keys != START
        out.iloc[0, out.columns.get_indexer(["tokens", "types", "learned_tokens"])] = [
            int((learned + aside)[word].sum()), int(((learned + aside)[word] > 0).sum()), int(learned[word].sum())]
    return out[["part", "block", "k", "learned", "aside", "tokens", "types", "learned_tokens"]]


def _counts_of(b: Block, answers: pd.DataFrame, full: bool) -> list[np.ndarray]:
    """Counts over all blocks of each order's keys: the block's own and what the others answered."""
    out = []
    for k in range(b.order):
        rows = answers[answers["k"] == k].sort_values("part")
        total = np.zeros(b.keys[k], np.int64)
        for name, role in (("learned", 1), ("aside", 2))[: 2 if full else 1]:
            total += b.own_counts(k, role)
            total += np.concatenate([unpack(x, np.int64) for x in rows[name]] or [np.zeros(0, np.int64)])
        out.append(total)
    return out


def _estimates(b: Block, counts: list[np.ndarray], at: np.ndarray, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimates of each order at places ``at``, bucket of the longest context, unigram counts)."""
    p = np.zeros((len(at), b.order + 1))
    p[:, 0] = 1 / (types + 1)
    context = np.zeros(len(at))
    unigram = counts[0][b.inverse[0][at]]
    p[:, 1] = unigram / max(tokens, 1)
    for k in range(1, b.order):
        context = counts[k - 1][b.inverse[k - 1][at - 1]]
        p[:, k + 1] = counts[k][b.inverse[k][at]] / np.maximum(context, 1)
    bucket = np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)
    return p, bucket, unigram


def _blocks_of(pdf: pd.DataFrame, order: int):
    for r in pdf.itertuples():
        yield r, Block(r.roles, r.lengths, r.codes, r.words, order)


def _histogram(order: int, tokens: int, types: int):
    """Set-aside tokens counted by bucket and by each estimate relative to uniform."""
    cells = [f"q{k}" for k in range(1, order + 1)]

    def run(key, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, b in _blocks_of(blocks, order):
            at = b.targets[b.role[b.targets] == 2]
            p, bucket, _ = _estimates(b, _counts_of(b, answers, False), at, tokens, types)
            with np.errstate(divide="ignore"):
                q = np.where(p[:, 1:] > 0, np.round(CELLS * np.log2(p[:, 1:] * (types + 1))), -9999)
            out.append(pd.DataFrame(q.astype(np.int32), columns=cells).assign(bucket=bucket.astype(np.int32)))
        rows = pd.concat(out) if out else pd.DataFrame(columns=[*cells, "bucket"], dtype="int32")
        return rows.groupby(["bucket", *cells], as_index=False).size().rename(columns={"size": "n"})
    return run, f"bucket int, {', '.join(c + ' int' for c in cells)}, n bigint"


def _shares(hist: pd.DataFrame, w: np.ndarray) -> np.ndarray:
    """Tokens that each component accounts for under weights ``w``, by bucket; the last row is all buckets as one."""
    q = hist[[f"q{k}" for k in range(1, w.shape[1])]].to_numpy(np.float64)
    ratio = np.hstack([np.ones((len(q), 1)), np.where(q > -9999, np.exp2(q / CELLS), 0.0)])
    n, out = hist["n"].to_numpy(np.float64), np.zeros(w.shape)
    for at in (hist["bucket"].to_numpy(np.int64), np.full(len(n), BUCKETS)):
        share = ratio * w[at]
        share *= (n / share.sum(1))[:, None]
        out += np.array([np.bincount(at, s, BUCKETS + 1) for s in share.T]).T
    return out


def mixture_weights(hist: pd.DataFrame | DataFrame, order: int, steps: int = 50) -> np.ndarray:
    """Weights (bucket, component) by expectation-maximisation; a bucket without tokens takes the weights of all.

    The cells of a Spark frame stay there: a step brings one row per bucket and partition.
    """
    names = [f"s{k}" for k in range(order + 1)]

    def partial(w: np.ndarray):
        def run(parts):
            total = np.zeros(w.shape)
            for pdf in parts:
                total += _shares(pdf, w)
            yield pd.DataFrame(total, columns=names).assign(bucket=np.arange(BUCKETS + 1, dtype=np.int32))
        return run

    def step(w: np.ndarray) -> np.ndarray:
        if isinstance(hist, pd.DataFrame):
            return _shares(hist, w)
        total = np.zeros(w.shape)
        for r in hist.mapInPandas(partial(w), ", ".join(f"{s} double" for s in names) + ", bucket int").collect():
            total[r["bucket"]] += [r[s] for s in names]
        return total

    w = np.full((BUCKETS + 1, order + 1), 1 / (order + 1))
    for _ in range(steps):
        share = step(w)
        seen = share.sum(1) > 0
        w[seen] = share[seen] / share[seen].sum(1, keepdims=True)
    w = np.where(seen[:, None], w, w[BUCKETS])
    w = np.maximum(w, 1e-9)
    return (w / w.sum(1, keepdims=True))[:BUCKETS]


def _scores(order: int, tokens: int, types: int, weights: np.ndarray):
    def run(key, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, b in _blocks_of(blocks, order):
            counts = _counts_of(b, answers, True)
            score, base, known = np.zeros(len(b.targets)), np.zeros(len(b.targets)), np.zeros(len(b.targets), np.int64)
            for i in range(0, len(b.targets), TOKENS):
                x = slice(i, i + TOKENS)
                p, bucket, unigram = _estimates(b, counts, b.targets[x], tokens, types)
                score[x] = np.log10((p * weights[bucket]).sum(1))
                base[x], known[x] = np.log10((unigram + 1) / (tokens + types + 1)), unigram > 0
            at = np.concatenate([[0], np.cumsum(b.n_tokens)])
            ids = pd.arrays.IntegerArray(unpack(r.ids, np.int64), unpack(r.no_id, np.int8).astype(bool))
            out.append(pd.DataFrame({"doc_id": ids, "held_out": b.roles == 0, "n_tokens": b.n_tokens,
                                     "n_known": sums(known, at), "train_tokens": tokens,
                                     "base_score": np.add.reduceat(base, at[:-1]), "score": np.add.reduceat(score, at[:-1])}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


SCORE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, held_out: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    aside = F.crc32(F.concat(F.col(id_col).cast("string"), F.lit(":aside"))) % 8 == 0
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       F.when(held_out, 0).when(aside, 2).otherwise(1).alias("role"))
    blocks = shared_table(rows.mapInArrow(_blocks, BLOCK_SCHEMA), "blocks")
    bits = max(0, blocks.count() - 1).bit_length()  # about as many ranges as blocks
    answers = None
    for k in range(order):  # one order after the other: the questions of one are gone before the next
        asked = blocks.mapInArrow(_questions(k, bits), QUESTION_SCHEMA)
        told = shared_table(asked.groupBy("part").applyInPandas(_answers, ANSWER_SCHEMA), f"answers-{k + 1}")
        answers = told if answers is None else answers.unionByName(told)
    size = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "learned_tokens"))).first()

    def joined(run, schema: str) -> DataFrame:
        told = answers.select("part", "block", "k", "learned", "aside")
        return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, schema)

    run, schema = _histogram(order, size["learned_tokens"], size["types"])
    cells = [c.split()[0] for c in schema.split(", ")][:-1]
    weights = mixture_weights(shared_table(joined(run, schema).groupBy(*cells).agg(F.sum("n").alias("n")), "histogram"), order)
    return joined(_scores(order, size["tokens"], size["types"], weights), SCORE_SCHEMA)
