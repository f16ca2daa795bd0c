"""Language identification with bit-sliced Bloom filters over character n-grams.

One table holds the filters of all languages at once: a slot is a bit mask, bit
l belonging to language l.  The masks in the slots of an n-gram, and-ed, give
every language that contains the n-gram.  A text's n-grams are looked up in
vectors; the set bits are counted for each language, corrected for the false
positives that the filter's fill predicts, and the largest share decides.

Learning counts the n-grams of all training rows (aggregated in the task, then
by shuffle).  No n-gram is too rare to be learned; one belongs to every language
in which its share is at least ``min_ratio`` of its largest share, so that the
foreign passages of a growing corpus don't put every n-gram into every filter.
The bits are set in the tasks and or-ed slot by slot in Spark; the driver gets
the finished table, of at most ``max_bytes``.  Beyond the n-grams for which
that leaves room the filters fill up, and the false positives are corrected.

Defined cases: a null or letterless text is ``und`` with score 0; a text none of
whose n-grams is known gets the most frequent learned language and score 0;
equal shares go to the language with more learned n-grams (by count of
occurrences, then by name); without any learned row everything is ``und``.
Repeated rows are judged alone and alike.  Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import U64, mix, process_cache, share, shared, shared_table, slices, sums


def letters() -> np.ndarray:
    """Which code points are letters; built once per process."""
    cache = process_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def ngram_keys(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first key of each text plus the total, letters per text).

    Lower case; a run of anything but letters is one space; every text is
    padded with spaces so that one letter makes one n-gram at least.
    """
    pad = " " * (n - 1)
    low = [pad + (t or "").lower() + " " for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    # surrogates can't be in a table's text; "surrogatepass" keeps a stray one from ending the task
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = letters()[cp]
    owner = np.repeat(np.arange(len(low)), size)
    found = np.bincount(owner[is_letter], minlength=len(low))
    cp = np.where(is_letter, cp, 32)
    first = np.zeros(len(cp), bool)
    first[np.cumsum(size) - size] = True
    place = np.arange(len(cp)) - np.repeat(np.cumsum(size) - size, size)
    keep = is_letter | (place < n - 1)
    keep[1:] |= is_letter[:-1]
    cp, owner = cp[keep], owner[keep]
    if len(cp) < n:
        return np.zeros(0, U64), np.zeros(len(low) + 1, np.int64), found
    x = cp.astype(U64)
    key = x[: len(x) - n + 1].copy()
    for k in range(1, n):
        key = key * U64(0x110001) + x[k:len(x) - n + 1 + k]
    whole = owner[: len(key)] == owner[n - 1:]
    whole &= cp[n - 1:] != 32  # padding aside, an n-gram ends with a letter or is the last of its word
    whole |= (owner[: len(key)] == owner[n - 1:]) & (cp[n - 2:len(cp) - 1] != 32)
    key, owner = mix(key[whole]), owner[: len(key)][whole]
    return key, np.searchsorted(owner, np.arange(len(low) + 1)), found


def probe_slots(keys: np.ndarray, slots: int, probes: int):
    """The slots of each (mixed) key, one array per probe; the top bits of two independent hashes' sums."""
    shift = U64(64 - (slots.bit_length() - 1))
    step = mix(keys + U64(1)) | U64(1)
    for k in range(probes):
        yield ((keys + step * U64(k)) >> shift).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilters:
    """Bit-sliced Bloom filters of several languages and their false-positive rates."""

    languages: list[str]
    prior: str | None
    table: np.ndarray  # slots x mask words
    probes: int
    n: int
    false_rate: np.ndarray

    def slots(self, keys: np.ndarray):
        return probe_slots(keys, len(self.table), self.probes)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for at in self.slots(mix(keys)):
            got = self.table[at]
            out = got if out is None else out & got
        return out

    def scores(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of each text's n-grams in each language, corrected for false positives."""
        total = np.maximum(np.diff(offsets), 1)
        masks = self.masks(keys)
        out = np.empty((len(offsets) - 1, len(self.languages)))
        width = self.table.dtype.itemsize * 8
        for l in range(len(self.languages)):
            bit = (masks[:, l // width] >> self.table.dtype.type(l % width)) & self.table.dtype.type(1)
            share = sums(bit.astype(np.int64), offsets) / total
            out[:, l] = np.clip((share - self.false_rate[l]) / max(1 - self.false_rate[l], 1e-9), 0, 1)
        return out


def empty_filters(names: list[str], prior: str | None, n: int, distinct: int, probes: int = 3, slots_per_key: int = 12,
                  max_bytes: int = 1 << 25) -> LanguageFilters:
    """Filters of ``names`` without a bit set, sized for ``distinct`` n-grams and at most ``max_bytes``."""
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(names) <= np.dtype(t).itemsize * 8), np.uint64)
    words = -(-max(len(names), 1) // (np.dtype(kind).itemsize * 8))
    most = max(1 << 10, 1 << (max_bytes // (words * np.dtype(kind).itemsize)).bit_length() - 1)
    slots = min(most, 1 << max(10, int(slots_per_key * max(distinct, 1) - 1).bit_length()))
    return LanguageFilters(names, prior, np.zeros((slots, words), kind), probes, n, np.zeros(len(names)))


def measure_fill(f: LanguageFilters) -> LanguageFilters:
    """The false-positive rate of each language, from the filled share of its bits."""
    kind, width = f.table.dtype.type, f.table.dtype.itemsize * 8
    for l in range(len(f.languages)):
        f.false_rate[l] = ((f.table[:, l // width] >> kind(l % width)) & kind(1)).mean() ** f.probes
    return f


def build_filters(grams: pd.DataFrame, prior: str | None, n: int, probes: int = 3, slots_per_key: int = 12) -> LanguageFilters:
    """Filters of n-grams at hand, ``grams`` (lang, key)."""
    keys = np.ascontiguousarray(grams["key"].to_numpy(np.int64)).view(U64)
    out = empty_filters(sorted(grams["lang"].unique()), prior, n, grams["key"].nunique(), probes, slots_per_key)
    kind, width = out.table.dtype.type, out.table.dtype.itemsize * 8
    for l, name in enumerate(out.languages):
        for at in out.slots(mix(keys[grams["lang"].to_numpy() == name])):
            out.table[at, l // width] |= kind(1 << (l % width))
    return measure_fill(out)


CHUNK = 1 << 16


def _set_bits(blank: LanguageFilters):
    """(chunk, slot, word, mask) for every probe of an n-gram and every word of its mask that has a bit."""
    width, (slots, words), probes = blank.table.dtype.itemsize * 8, blank.table.shape, blank.probes

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 18):
                part = batch.slice(start, 1 << 18)
                keys = part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                lists = part.column("langs")
                owner = np.repeat(np.arange(len(keys)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                lang = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                mask = np.zeros((len(keys), words), U64)
                np.bitwise_or.at(mask, (owner, lang // width), U64(1) << (lang % width).astype(U64))
                row, word = np.nonzero(mask)
                for at in probe_slots(mix(keys), slots, probes):
                    yield pa.RecordBatch.from_arrays([
                        pa.array((at[row] // CHUNK).astype(np.int32)), pa.array((at[row] % CHUNK).astype(np.int32)),
                        pa.array(word.astype(np.int32)), pa.array(mask[row, word].view(np.int64))], ["chunk", "slot", "word", "mask"])
    return run


def _chunk_bytes(words: int, kind: str):
    """The slots of a chunk as bytes; at most CHUNK x words rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((CHUNK, words), kind)
        out[pdf["slot"].to_numpy(), pdf["word"].to_numpy()] = pdf["mask"].to_numpy(np.int64).view(U64).astype(kind)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [out.tobytes()]})
    return run


def fill_filters(blank: LanguageFilters, grams: DataFrame) -> LanguageFilters:
    """``blank`` with the bits of ``grams`` (key, langs: numbers of the languages), or-ed in Spark."""
    words, kind = blank.table.shape[1], blank.table.dtype.name
    bits = grams.mapInArrow(_set_bits(blank), "chunk int, slot int, word int, mask bigint") \
        .groupBy("chunk", "slot", "word").agg(F.bit_or("mask").alias("mask"))
    for r in bits.groupBy("chunk").applyInPandas(_chunk_bytes(words, kind), "chunk int, bits binary").collect():  # the table itself
        part = np.frombuffer(r["bits"], kind).reshape(CHUNK, words)
        blank.table[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = part[:len(blank.table)]
    return measure_fill(blank)


#: characters whose n-grams are taken at a time: some 60 MB of arrays
SLICE = 500_000


def _count(n: int, hold: int = 400_000):
    """(lang, key, n): counts of a task, merged as they come and handed on when ``hold`` are held."""
    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def size() -> int:
            return sum(len(k) for parts in held.values() for k, _ in parts)

        def merge():
            for lang, parts in held.items():
                if len(parts) > 1:
                    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    held[lang] = [(keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64))]

        def out():
            for lang, ((k, c),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                texts = np.array(part.column("text").to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    k, c = np.unique(ngram_keys(list(texts[langs == lang]), n)[0], return_counts=True)
                    held.setdefault(lang, []).append((k, c.astype(np.int64)))
                if size() > 2 * hold:
                    merge()
                    if size() > hold:
                        yield from out()
        merge()
        yield from out()
    return run


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 4, min_ratio: float = 0.1,
          probes: int = 3, max_bytes: int = 1 << 25) -> LanguageFilters:
    """Filters from all rows with a text and a language.

    Every n-gram joins the filter of each language in which its share is not
    under ``min_ratio`` of its largest share, so it is in one filter at least.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()) \
        .select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = shared_table(rows.mapInArrow(_count(n), "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")), "ngrams")
    per = counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()  # one row a language
    per = sorted(((r["lang"], r["total"]) for r in per), key=lambda x: (-x[1], x[0]))
    distinct = counts.agg(F.approx_count_distinct("key")).first()[0]
    blank = empty_filters([x for x, _ in per], per[0][0] if per else None, n, distinct, probes, max_bytes=max_bytes)
    if not per:
        return blank
    table = counts.sparkSession.createDataFrame([(l, i, float(t)) for i, (l, t) in enumerate(per)], "lang string, l int, total double")
    share = counts.join(F.broadcast(table), "lang").select("key", "l", (F.col("n") / F.col("total")).alias("share"))
    # one list for each n-gram, at most as long as there are languages
    of = share.groupBy("key").agg(F.max("share").alias("top"), F.collect_list(F.struct("l", "share")).alias("of"))
    near = F.filter("of", lambda x: x["share"] >= min_ratio * F.col("top"))
    return fill_filters(blank, of.select("key", F.transform(near, lambda x: x["l"]).alias("langs")))


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin) for every row; score is the corrected share of the winning language."""
    model = share(docs.sparkSession, filters)  # at most max_bytes: see learn()

    def run(batches):
        m: LanguageFilters = shared(model)
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                keys, offsets, found = ngram_keys(part.column("text").to_pylist(), m.n)
                if m.languages:
                    sc = m.scores(keys, offsets)
                    best = sc.argmax(1)
                    top = sc.max(1)
                    rest = np.sort(sc, 1)[:, -2] if sc.shape[1] > 1 else np.zeros(len(sc))
                    best[top <= 0] = m.languages.index(m.prior)
                else:
                    best, top, rest = np.zeros(len(found), np.int64), np.zeros(len(found)), np.zeros(len(found))
                best = np.where((found == 0) | (not m.languages), len(m.languages), best)
                top, rest = np.where(best == len(m.languages), 0.0, top), np.where(best == len(m.languages), 0.0, rest)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(top), pa.array(top - rest)],
                                                 ["doc_id", "lang_pred", "score", "margin"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double")


def identify_held_out(docs: DataFrame, held: Column, **options) -> DataFrame:
    """Learn from the rows that aren't ``held``, predict all."""
    filters = learn(docs.where(~held).select("text", "lang"), **options)
    return identify(docs, filters).withColumn("held_out", held)
