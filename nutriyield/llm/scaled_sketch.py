"""Threshold-scaled document fingerprints.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so
sketches of any two texts, however unequal in length, can be merged and
compared: the hashes below the smaller bound of the two are complete in both.
A text with fewer than ``floor`` hashes below the bound keeps its ``floor``
smallest ones, which only raises its own bound.  Two texts of fewer than
``floor`` shingles each compare exactly.  Else a likeness or containment p
estimated from m hashes below the common bound has a standard error of
sqrt(p (1 - p) / m): at most 0.03 for m = 256.  Against a text long enough for
the fixed fraction, a short one of n shingles is judged by about n / 8 hashes
(0.2 for n = 50, 0.06 for n = 500), and has none left with probability
(7/8)^n (0.1 % for n = 50); its containment is then unknown (null), and so is
the likeness if neither text has one.  Shingles are runs of ``k`` code points.

Defined cases: a null text is empty; an empty text has an empty fingerprint,
like another empty text (1) and no other (0); a text shorter than a shingle is
one shingle; equal texts have equal fingerprints.  Rows that repeat an id
follow each other in the order of their texts; rows without an id come last.
Other columns are never read.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import U64, mix, slices

K = 9
FRACTION = 8
FLOOR = 256
BASE = 0x9E3779B97F4A7C15
TOP = 1 << 64
PIECE = 500_000  # code points held as vectors at a time
SLICE_BYTES = 1_000_000


def sketches(texts: list[str], k: int = K, fraction: int = FRACTION, floor: int = FLOOR) -> list[np.ndarray]:
    """Sorted retained hashes of each text; a long text is the merger of its overlapping pieces."""
    out, at = [], 0
    while at < len(texts):
        t = texts[at]
        if len(t) > PIECE:
            pieces = (t[i:i + PIECE + k - 1] for i in range(0, len(t) - k + 1, PIECE))
            out.append(functools.reduce(lambda a, b: merge(a, b, fraction, floor), (_sketches([x], k, fraction, floor)[0] for x in pieces)))
            at += 1
            continue
        size, end = 0, at
        while end < len(texts) and len(texts[end]) <= PIECE and (size + len(texts[end]) <= PIECE or end == at):
            size += len(texts[end])
            end += 1
        out += _sketches(texts[at:end], k, fraction, floor)
        at = end
    return out


def _sketches(texts: list[str], k: int, fraction: int, floor: int) -> list[np.ndarray]:
    """All texts in one pass of vectors."""
    size = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    ends = np.cumsum(size)
    out = [np.zeros(0, U64)] * len(texts)
    if len(cp) >= k:
        # hashes of runs of 1, 2, 4, .. code points give that of any length
        run, width, have, got = cp, 1, None, 0
        with np.errstate(over="ignore"):
            while width <= k:
                if k & width:
                    have = run if have is None else run[: len(cp) - got - width + 1] * U64(pow(BASE, got, TOP)) + have[width:]
                    got += width
                run = run[: max(len(run) - width, 0)] * U64(pow(BASE, width, TOP)) + run[width:]
                width *= 2
        h = mix(have)
        owner = np.repeat(np.arange(len(texts)), np.maximum(size - k + 1, 0))
        at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(size - k + 1, 0)) - np.maximum(size - k + 1, 0), np.maximum(size - k + 1, 0))
        h = h[(ends - size)[owner] + at]
        low = h < U64(TOP // fraction)
        kept, who = h[low], owner[low]
        first = np.searchsorted(who, np.arange(len(texts) + 1))
        begin = np.concatenate([[0], np.cumsum(np.maximum(size - k + 1, 0))])
        for i in range(len(texts)):
            s = np.unique(kept[first[i]:first[i + 1]])
            if len(s) < floor and size[i] >= k:
                s = np.unique(h[begin[i]:begin[i + 1]])[:floor]
            out[i] = s
    for i, t in enumerate(texts):
        if 0 < len(t) < k:
            out[i] = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))], U64)
    return out


def bound(s: np.ndarray, fraction: int = FRACTION, floor: int = FLOOR) -> int:
    """Every shingle hash of the text below this is in the sketch."""
    if len(s) < floor:
        return TOP
    return TOP // fraction if len(s) > floor else max(TOP // fraction, int(s[-1]) + 1)


def compare(a: np.ndarray, b: np.ndarray) -> tuple[float | None, float | None]:
    """Estimated (resemblance, containment of the smaller) of two texts; None where no hash is left to tell."""
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    t = min(bound(a), bound(b))
    if t < TOP:
        a, b = a[: np.searchsorted(a, U64(t))], b[: np.searchsorted(b, U64(t))]
    if not len(a) or not len(b):
        return (0.0 if len(a) or len(b) else None), None
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / min(len(a), len(b))


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """Sketch of the shingles of two texts together, as if made from them at once.

    Both sides are complete below the smaller bound, and hold ``floor`` hashes
    there unless they are complete everywhere, so what a sketch retains is known.
    """
    s, t = np.union1d(a, b), min(bound(a, fraction, floor), bound(b, fraction, floor))
    s = s if t == TOP else s[: np.searchsorted(s, U64(t))]
    return s[: max(int(np.searchsorted(s, U64(TOP // fraction))), floor)]


def as_text(s: np.ndarray) -> str:
    """Differences of the sorted hashes, seven bits a byte (the last byte of each has its top bit clear), in base 64."""
    d = np.diff(s, prepend=U64(0))
    size = np.ones(len(d), np.int64)
    for b in range(1, 10):
        size += d >= U64(1 << 7 * b)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(d) else 0, np.uint8)
    for b in range(10):
        has = size > b
        out[(end - size)[has] + b] = (d[has] >> U64(7 * b) & U64(127)).astype(np.uint8) | np.where(size[has] > b + 1, 128, 0).astype(np.uint8)
    return base64.b64encode(out.tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8)
    last = raw < 128
    number = np.cumsum(last) - last  # which difference a byte belongs to
    first = np.concatenate([[0], np.nonzero(last)[0] + 1])[: int(last.sum())]
    d = np.zeros(len(first), U64)
    np.add.at(d, number, (raw & 127).astype(U64) << ((np.arange(len(raw)) - first[number]) * 7).astype(U64))
    return np.cumsum(d, dtype=U64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(s) for s in sketches(texts)])],
                                                 ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the first code points of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _edits(batches):
    """Rows in runs of one range, each row's next one right behind it; copies only serve as next."""
    held = None
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            ids, texts, copies = (part.column(c).to_pylist() for c in ("doc_id", "text", "copy"))
            if held is not None:
                ids, texts, copies = [held[0], *ids], [held[1], *texts], [False, *copies]
            held = None if copies[-1] else (ids[-1], texts[-1])
            rows = [i for i in range(len(ids) - 1) if not copies[i]]
            other = [edited(texts[i], texts[i + 1]) for i in rows]
            own, new = sketches(texts), sketches(other)
            near = [compare(own[i], s) for i, s in zip(rows, new)]
            nxt = [compare(own[i], own[i + 1]) for i in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in other], pa.string()),
                pa.array([as_text(own[i]) for i in rows], pa.string()), pa.array([as_text(s) for s in new], pa.string()),
                *(pa.array([x[j] for x in pairs], pa.float64()) for j in (0, 1) for pairs in (near, nxt))], EDIT_NAMES)


EDIT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
EDIT_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next text, in the order of falling ids.

    Rows are dealt into as many ranges of ids as there are shuffle partitions
    (bounds from approximate quantiles: any bounds give the same result).  The
    first rows of a range also go, as copies, to the end of the range before
    it, so every row meets its next one inside its range; the driver holds one
    id per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = F.lit(-(1 << 63)).cast("bigint")
    rows = rows.withColumn("rank", F.coalesce("doc_id", least))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})

    @F.pandas_udf("int")
    def part_of(rank: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(np.array(cuts, np.int64), rank.to_numpy(np.int64), "right"), dtype="int32")

    placed = rows.withColumn("part", part_of("rank"))
    heads = {r["part"]: r["head"] for r in placed.groupBy("part").agg(F.max("rank").alias("head")).collect()}  # one row per range
    parts = sorted(heads)
    target = [(parts[i - 1], heads[p]) for i, p in enumerate(parts)]  # the first range's head closes the last range
    to = spark.createDataFrame(target, "part int, rank bigint")
    copies = rows.join(F.broadcast(to), "rank").withColumn("copy", F.lit(True))  # at most one row per range
    all_rows = placed.withColumn("copy", F.lit(False)).unionByName(copies).withColumn("tie", F.xxhash64("text"))
    dealt = all_rows.repartition(ranges, "part").sortWithinPartitions("part", "copy", F.desc("rank"), "tie", "text")
    return dealt.select("doc_id", "text", "copy").mapInArrow(_edits, EDIT_SCHEMA)
