"""Best-fit-decreasing packing of token ids into rows of fixed length.

Texts are encoded by a local byte-level BPE vocabulary and closed by an end id.
A document longer than a row is split: full rows first, the rest like any other
segment; nothing is dropped and the pieces carry their offsets, so every
document can be put together again.  Segments go, longest first, into the open
row with the least room that still holds them; a segment tree over the
capacities finds it in a logarithmic number of steps.

Packing works on shards, bounded blocks of an input partition (a few thousand
documents), so it needs no shuffle and no task holds more than a block; within a
shard rows are filled to about 99 %.  A shard's rows depend on how the input is split,
what they hold together doesn't.

A packed row has the matrix row ``ids`` (little-endian unsigned 16-bit integers,
or 32-bit if the vocabulary needs them, padded with the end id), the cumulative
segment lengths ``cu_seqlens`` and the positions resets ``position_resets``
(where positions start again from 0).

Defined cases: a null or empty text is its end id alone; rows that repeat an id
are all packed; a null id stays null; an empty table gives no rows.  Other
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.byte_bpe import Codec
from nutriyield.llm.common import runs, slices

SHARD_BYTES = 12_000_000


class CapacityTree:
    """How many open rows have each remaining capacity; finds the least one that is large enough."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += n
            k >>= 1

    def at_least(self, need: int) -> int:
        """The smallest capacity >= ``need`` of an open row, or -1."""
        k, count = self.leaves + need, self.count
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:  # the right neighbour holds the next capacities
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Segments of each row; every length is between 1 and ``row``. Ties keep the given order."""
    tree, open_rows, rows = CapacityTree(row), {}, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.at_least(n)
        if room < 0:
            r, room = len(rows), row
            rows.append([i])
        else:
            tree.add(room, -1)
            r = open_rows[room].pop()
            rows[r].append(i)
        if room > n:
            open_rows.setdefault(room - n, []).append(r)
            tree.add(room - n, 1)
    return rows


def split_lengths(n: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, offset, length) of every segment; a document of more than ``row`` ids has several."""
    parts = np.maximum(-(-n // row), 1)
    doc = np.repeat(np.arange(len(n)), parts)
    offset = runs(parts) * row
    return doc, offset, np.minimum(row, n[doc] - offset)


def pack_shard(ids: np.ndarray, at: np.ndarray, row: int, pad: int, kind) -> dict[str, list]:
    """Packed rows of one shard: ``ids`` of document d are at[d]:at[d + 1]."""
    doc, offset, length = split_lengths(np.diff(at), row)
    start = at[doc] + offset
    out: dict[str, list] = {k: [] for k in ("ids", "n_tokens", "cu_seqlens", "position_resets", "docs", "offsets")}
    for segs in best_fit_decreasing(length, row):
        n = length[segs]
        ends = np.cumsum(n)
        line = np.full(row, pad, kind)
        line[: ends[-1]] = ids[np.repeat(start[segs] - (ends - n), n) + np.arange(ends[-1])]
        out["ids"].append(line.tobytes())
        out["n_tokens"].append(int(ends[-1]))
        out["cu_seqlens"].append(np.concatenate([[0], ends]).astype(np.int32))
        out["position_resets"].append((ends - n).astype(np.int32))
        out["docs"].append(doc[segs])
        out["offsets"].append(offset[segs])
    return out


ROW_SCHEMA = ("shard bigint, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
              "doc_ids array<bigint>, doc_offsets array<bigint>")


def pack_rows(docs: DataFrame, row: int = 2048, codec: Codec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row (see the module): ``ROW_SCHEMA``."""
    codec = codec or Codec.load()
    end = codec.size  # the first id after the vocabulary
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")

    def run(batches):
        shard = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                ids, at = codec.encode_all(part.column("text"))
                n = np.diff(at)
                closed = np.full(len(ids) + len(n), end, kind)
                closed[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                got = pack_shard(closed, at + np.arange(len(at)), row, end, kind)
                names = part.column("doc_id").cast(pa.int64())
                rows = len(got["ids"])
                width = np.array([len(d) for d in got["docs"]], np.int64)
                lists = lambda x, t, w=width: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(w)]), pa.int32()), pa.array(x, t))
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * rows, pa.int64()), pa.array(np.arange(rows), pa.int32()), pa.array(got["n_tokens"], pa.int32()),
                    pa.array(got["ids"], pa.binary()), lists(np.concatenate(got["cu_seqlens"]), pa.int32(), width + 1),
                    lists(np.concatenate(got["position_resets"]), pa.int32()),
                    lists(names.take(pa.array(np.concatenate(got["docs"]))), pa.int64()), lists(np.concatenate(got["offsets"]), pa.int64())],
                    ["shard", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"])
                shard += 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ROW_SCHEMA)


def position_ids(n_tokens: int, resets) -> np.ndarray:
    """Positions of a packed row: from 0 at each reset."""
    resets = np.asarray(resets, np.int64)
    return runs(np.diff(np.append(resets, n_tokens)))


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet at ``path`` (any file system that Spark writes)."""
    pack_rows(docs, **options).write.mode("overwrite").parquet(path)


def unpack_documents(packed: DataFrame, codec: Codec | None = None) -> DataFrame:
    """(doc_id, ids, raw): each document's ids without the end id, put together from its segments, and its bytes.

    For tables whose ids are unique and not null.
    """
    codec = codec or Codec.load()
    kind = np.dtype("<u2" if codec.size < 1 << 16 else "<u4")

    def cut(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                line = np.frombuffer(r["ids"], kind)
                for k, (d, o) in enumerate(zip(r["doc_ids"], r["doc_offsets"])):
                    out.append((d, o, line[r["cu_seqlens"][k]:r["cu_seqlens"][k + 1]].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                                             ["doc_id", "offset", "piece"])

    def whole(batches):
        for batch in batches:
            ids = [b"".join(p["piece"] for p in sorted(x, key=lambda p: p["offset"]))[:-4] for x in batch.column("pieces").to_pylist()]
            raw = [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])

    pieces = packed.select("ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(cut, "doc_id bigint, offset bigint, piece binary")
    joined = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("offset", "piece")).alias("pieces"))  # one document's own pieces
    return joined.mapInArrow(whole, "doc_id bigint, ids binary, raw binary")
