"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard checks.

Two permutations make every signature coordinate: the first scrambles a
shingle's hash, the second is shifted by one more step for each coordinate and
applied to the scrambled value; the coordinate is the minimum over the set.
Documents that share a band are candidates, and every link is confirmed on the
full shingle sets, rebuilt from the whole texts.

Shape of the job, chosen for large groups of copies:

1. One pass over the texts writes a small row per document: set size, 128-bit
   hash of the set, band keys and a one-byte-per-coordinate sketch.
2. Equal sets collapse to one representative (aggregated before the shuffle).
3. In each band bucket every representative is paired with the smallest one: as
   many pairs as members, never all pairs.  Pairs are confirmed by streaming
   the members past the hub's set, hubs with many members being dealt to many
   tasks.  A key with over a thousandth of the rows of its join is split by a
   hash of the document; at most 2 x SHARES keys can be that large, so their
   list may be broadcast.
4. Confirmed links are contracted to components.  Buckets that still hold more
   than one component are looked at again by sketch, which joins components
   that may be linked to clusters (as a forest, never as pairs).  Inside a
   cluster the documents outside its largest component meet all its documents,
   block against block of bounded size, each block holding whole sets; a block
   gives the links that join components, no others.  Nothing is capped: a
   bucket or cluster of any size is cut into more blocks.

With 32 bands of 5 rows a pair at similarity 0.8 shares a band with probability
1 - 3e-6, and the sketch bound lies more than 5 standard deviations below 0.8.

Defined cases: null or empty texts have an empty set and are linked with
nothing; a one-word text is its own single shingle; a row whose id is null is
returned with a null component and kept.  Rows that repeat an id are one node
and are all returned.  Other columns are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import U64, mix, pair_hash, shared_table, slices, word_codes, word_hashes

ROW_SCHEMA = "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sketch binary"
TILE = 1 << 16
BLOCK = 512
#: a join's key is split when it has over one part in so many of the join's rows; at most twice as many keys can
SHARES = 1000


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text."""
    codes, offsets, words = word_codes(texts, lower=True)
    w = mix(word_hashes(words))[codes] if len(words) else np.zeros(0, U64)
    lengths = np.diff(offsets)
    full = w.copy()
    for k in range(1, n):
        full[: max(len(w) - k, 0)] = pair_hash(full[: max(len(w) - k, 0)], w[k:])
    out = []
    for a, m in zip(offsets[:-1], lengths):
        if m >= n:
            out.append(np.unique(full[a:a + m - n + 1]))
        elif m:  # too short: the whole sequence is one shingle
            h = w[a:a + 1]
            for k in range(1, m):
                h = pair_hash(h, w[a + k:a + k + 1])
            out.append(pair_hash(h, np.full(1, m, U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the minimum of second(first(x) + k) over a set."""
    out = np.full((len(sets), coords), 0xFFFFFFFF, np.uint32)
    start = 0
    filled = [i for i, s in enumerate(sets) if len(s)]
    while start < len(filled):
        end, size = start, 0
        while end < len(filled) and (end == start or size + len(sets[filled[end]]) <= TILE):
            size += len(sets[filled[end]])
            end += 1
        rows = filled[start:end]
        flat = mix(np.concatenate([sets[i] for i in rows]))
        first = (flat >> U64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])[:-1]])
        x, t = np.empty_like(first), np.empty_like(first)
        for k in range(coords):
            np.add(first, np.uint32(k), out=x)
            for shift, mul in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(x, np.uint32(shift), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, np.uint32(mul), out=x)
            np.right_shift(x, np.uint32(16), out=t)
            np.bitwise_xor(x, t, out=x)
            out[rows, k] = np.minimum.reduceat(x, at)
        start = end
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    keys = np.empty((len(sig), bands), U64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, U64)
        for k in range(b * rows, (b + 1) * rows):
            h = pair_hash(h, sig[:, k].astype(U64))
        keys[:, b] = h
    return keys.view(np.int64)


def _document_rows(shingle: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                sig = signatures(sets, bands * rows)
                keys = band_keys(sig, rows)
                size = np.array([len(s) for s in sets], np.int64)
                width = np.where(size > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(keys[size > 0].ravel()))
                sketch = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array(size),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), lists,
                    pa.array([r.tobytes() for r in sketch], pa.binary())], ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])
    return run


def _confirm(shingle: int, percent: int):
    """Rows come in runs (hub, salt), the hub's own text first; one set is held at a time."""
    def run(batches):
        key, hub_set = None, None
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                hubs, salts, docs = (part.column(c).to_pylist() for c in ("hub", "salt", "doc"))
                a, b = [], []
                for h, s, d, own in zip(hubs, salts, docs, sets):
                    if d == h:
                        key, hub_set = (h, s), own
                    elif (h, s) == key and len(own):
                        both = len(np.intersect1d(hub_set, own, assume_unique=True))
                        if 100 * both >= percent * (len(hub_set) + len(own) - both):
                            a.append(h)
                            b.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, run: int = 512) -> DataFrame:
    """The pairs (hub, doc) whose full sets reach the threshold, as (a, b).

    ``members`` is the size of the bucket that made the pair: a hub's pairs are
    dealt to as many runs as its buckets fill, known from the row alone.
    """
    parts = F.ceil(F.col("members") / run).cast("bigint")
    members = pairs.select("hub", (F.shiftleft(parts, 32) + F.pmod(F.xxhash64("doc"), parts)).alias("salt"), "doc")
    # a hub goes with each of its runs that has members
    tasks = members.unionByName(members.groupBy("hub", "salt").agg(F.first("hub").alias("doc")))
    # pairs grow with the corpus, so neither side is ever broadcast
    rows = texts.withColumnRenamed("doc_id", "doc").hint("merge").join(tasks, "doc").select("hub", "salt", "doc", "text")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", (F.col("doc") != F.col("hub")), "doc")
    return dealt.mapInArrow(_confirm(shingle, percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) for every linked document: comp is the smallest id reachable.

    Each round every node takes the smallest id among itself and its
    neighbours, chains of parents are shortened, and the links are contracted;
    the number of nodes at least halves, so the rounds are logarithmic.  State
    is a written table after each round, never the driver.
    """
    edges = shared_table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("doc")).agg(F.least(F.col("a"), F.min("b")).alias("comp"))
        parent = shared_table(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("doc").alias("comp"), F.col("comp").alias("up"))
            parent = parent.join(up, "comp").select("doc", F.col("up").alias("comp"))
        parent = shared_table(parent, "parents")
        up = parent.select(F.col("doc").alias("comp"), F.col("comp").alias("up"))
        label = parent if label is None else shared_table(
            label.join(up, "comp", "left").select("doc", F.coalesce("up", "comp").alias("comp")), "labels")
        to = lambda c: parent.select(F.col("doc").alias(c), F.col("comp").alias(f"to_{c}"))
        edges = shared_table(edges.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
                             .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    return label if label is not None else edges.select(F.col("a").alias("doc"), F.col("a").alias("comp"))


class Groups:
    """Union-find over the numbers 0 .. n-1, as an array of roots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.root[a], self.root[b]
        if x != y:
            self.root[self.root == max(x, y)] = min(x, y)
        return x != y


def _bucket_forest(coords: int, percent: int):
    """Components in one block (or two blocks) of a bucket that may be linked, as a forest."""
    reach = percent / 100 - 5.4 * np.sqrt(percent / 100 * (1 - percent / 100) / coords)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.sort_values("doc", ignore_index=True)
        sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        size, block = pdf["n_shingles"].to_numpy(), pdf["block"].to_numpy()
        comps, own, cnt = np.unique(pdf["comp"].to_numpy(), return_inverse=True, return_counts=True)
        groups, out = Groups(len(comps)), []
        for a in np.nonzero(own != cnt.argmax())[0]:  # two members of the largest component are never a pair
            to = (groups.root[own] != groups.root[own[a]]) & (100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a]))
            if i != j:
                to &= block != block[a]
            to = np.nonzero(to)[0]
            if len(to):
                est = ((sk[to] == sk[a]).mean(1) - 1 / 256) / (1 - 1 / 256)
                out += [(comps[own[a]], comps[c]) for c in np.unique(own[to[est >= reach]]) if groups.join(own[a], c)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return run


def _block_links(shingle: int, percent: int):
    """Links that join components, from the documents of role 0 to those of role 1, by their full sets."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "doc"], ignore_index=True)
        sets = shingle_sets(pa.array(pdf["text"], pa.string()), shingle)
        doc = pdf["doc"].to_numpy()
        _, own = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        groups, out = Groups(own.max() + 1), []
        n = int((pdf["role"] == 0).sum())
        to, size = np.arange(n, len(pdf)), np.array([len(x) for x in sets[n:]])
        if len(to):
            universe, at = np.unique(np.concatenate(sets[n:]), return_inverse=True)
            begin, mark = np.cumsum(size) - size, np.zeros(len(universe), np.int32)
            for a in range(n):
                if (groups.root[own[to]] == groups.root[own[a]]).all():
                    continue
                place = np.searchsorted(universe, sets[a])
                place = place[place < len(universe)]
                place = place[np.isin(universe[place], sets[a])]
                mark[place] = 1
                both = np.add.reduceat(mark[at], begin)
                mark[place] = 0
                for b in to[100 * both >= percent * (len(sets[a]) + size - both)]:
                    if groups.join(own[a], own[b]):
                        out.append((doc[a], doc[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return run


def crossing_links(clusters: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between the components of each cluster, given as (doc, comp, cluster)."""
    per = clusters.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    size = per.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("m")) \
        .select("cluster", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int").alias("rest"))
    rows = clusters.join(size, "cluster")
    block = lambda seed, n: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rows.where("comp <> main").select("cluster", block(0, "rest").alias("i"), every("blocks").alias("j"), F.lit(0).alias("role"), "doc", "comp")
    inside = rows.select("cluster", every("rest").alias("i"), block(1, "blocks").alias("j"), F.lit(1).alias("role"), "doc", "comp")
    tasks = outside.unionByName(inside)
    named = texts.withColumnRenamed("doc_id", "doc").hint("merge").join(tasks, "doc")
    return named.groupBy("cluster", "i", "j").applyInPandas(_block_links(shingle, percent), "a bigint, b bigint")


def _parts(limit: int) -> Column:
    """Into how many parts a key with ``members`` rows is split."""
    return F.greatest(F.ceil(F.col("members") / limit), F.lit(1)).cast("int")


def _part_of(row: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(row), parts).cast("int")


def _every_part(limit: int) -> Column:
    return F.explode(F.sequence(F.lit(0), _parts(limit) - 1)).alias("part")


def split_join(rows: DataFrame, groups: DataFrame, key: str, row: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups`` (a row a key; members: the key's rows), heavy keys split by a hash of ``row``.

    ``total`` is the number of ``rows``; the columns of ``groups`` and part come on top.
    """
    limit = max(1, total // SHARES)
    heavy = groups.where(F.col("members") > limit).select(key, _parts(limit).alias("parts"))  # fewer than 2 x SHARES keys
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("part", _part_of(row, F.coalesce("parts", F.lit(1)))).drop("parts")
    return dealt.join(groups.select("*", _every_part(limit)), [key, "part"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80,
                    bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    base = shared_table(texts.mapInArrow(_document_rows(shingle, bands, rows), ROW_SCHEMA), "minhash")
    filled = base.where("n_shingles > 0 and doc_id is not null")
    classes = shared_table(filled.groupBy("set_hash").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"), F.count("*").alias("members")), "classes")

    keyed = classes.select("doc", F.explode("bands").alias("key"))
    hubs = shared_table(keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("members")).where("members > 1"), "hubs")
    n_keyed = classes.count() * bands
    buckets = shared_table(split_join(keyed, hubs, "key", "doc", n_keyed).drop("part"), "buckets")
    star = shared_table(buckets.where("doc <> hub").groupBy("hub", "doc").agg(F.max("members").alias("members")), "pairs")
    links = shared_table(confirmed(star, texts, shingle, percent), "confirmed")
    # equal sets: link each id to its class; covers ids that stand in several rows
    ids = filled.select("doc_id", "set_hash").distinct()
    own = split_join(ids, classes.where("members > 1").select("set_hash", "doc", "members"), "set_hash", "doc_id", filled.count()) \
        .where("doc_id <> doc").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    first = components(links)

    limit = max(1, n_keyed // SHARES)
    named = buckets.where("members > 2").join(first, "doc", "left") \
        .select("key", _part_of("doc", _parts(limit)).alias("part"), "doc", F.coalesce("comp", "doc").alias("comp"), "members")
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("members").alias("members")) \
        .where("low <> high").select("key", _every_part(limit), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    open_rows = named.drop("members").join(mixed, ["key", "part"]).join(classes.select("doc", "n_shingles", "sketch"), "doc") \
        .withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    forest = placed.groupBy("key", "i", "j").applyInPandas(_bucket_forest(bands * rows, percent), "a bigint, b bigint")
    cluster = components(forest).select(F.col("doc").alias("comp"), F.col("comp").alias("cluster"))
    if not cluster.isEmpty():
        every = classes.join(first, "doc", "left").select("doc", F.coalesce("comp", "doc").alias("comp"))
        links = links.unionByName(crossing_links(shared_table(every.join(cluster, "comp"), "clusters"), texts, shingle, percent))
    label = components(reduce(DataFrame.unionByName, [links, own]))
    out = base.join(label.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
