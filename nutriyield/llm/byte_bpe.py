"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded by the tiktoken library from the ranks in a file that the
driver reads once and sends to the tasks (a vocabulary: bounded, about 1 MB).
Long texts are first cut at safe boundaries, a single space between two
characters that aren't blanks: no match of the split pattern crosses such a
place, so the ids are those of the whole text.  Decoding joins the raw bytes
of the ids, so a text is restored byte by byte whatever it holds.

Defined cases: a null or empty text has no ids; strings that look like special
tokens are ordinary text; a text without a safe boundary is encoded in one
piece; repeated rows are encoded alike.  Other columns are never read.
"""

from __future__ import annotations

import array
import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.common import process_cache, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE = 16_384
HELD_UNITS = 300_000
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Codec:
    """Encoder and decoder of one rank file; built once per process."""

    def __init__(self, ranks: bytes, pattern: str):
        self.key = ("bpe", hashlib.sha256(ranks + pattern.encode()).hexdigest())
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> Codec:
        import public_tokenizers
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            return cls(f.read(), pattern or public_tokenizers.PATTERN)

    @property
    def encoding(self):
        cache = process_cache()
        if self.key not in cache:
            import tiktoken
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            cache[self.key] = tiktoken.Encoding("local", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
        return cache[self.key]

    @property
    def size(self) -> int:
        return self.encoding.n_vocab

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; long texts in pieces between safe boundaries."""
        encode = self.encoding.encode_ordinary
        if len(text) <= PIECE:
            return encode(text)
        ids, start = [], 0
        while start < len(text):
            cut = SAFE.search(text, start + PIECE) if start + PIECE < len(text) else None
            end = cut.start() if cut else len(text)
            ids += encode(text[start:end])
            start = end
        return ids

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after another, and where each begins (total last).

        A text whose blanks are single spaces or line ends is a row of units (a
        blank and what follows); each distinct unit is encoded once and the ids
        are put together in vectors.  Other texts are encoded whole.
        """
        held = process_cache().setdefault((*self.key, "units"), {})
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # a line end before the first word makes it a unit like the others; its id is taken off again
        units = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type)), "\n", " \n"), " ")
        at = units.offsets.to_numpy().astype(np.int64)
        flat = units.flatten().dictionary_encode()
        names, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = at - at[0]
        core, encoded, bad = self.encoding.encode_ordinary, [], np.zeros(len(names), bool)
        for k, u in enumerate(names):
            got = held.get(u)
            if got is None:
                body = u[1:] if u[:1] == "\n" else u
                bad[k] = not body or body != body.strip()
                got = b"" if bad[k] else array.array("I", core(u if u[:1] == "\n" else " " + u)).tobytes()
                if not bad[k] and len(held) < HELD_UNITS:
                    held[u] = got
            encoded.append(got)
        # the empty unit before the added line end has no ids
        if "" in names:
            bad[names.index("")] = False
        size = np.array([len(e) // 4 for e in encoded], np.int64)
        pool = np.frombuffer(b"".join(encoded), np.uint32)
        begin = np.cumsum(size) - size
        wrong = bad[codes] | ((codes == names.index("") if "" in names else False) & ~np.isin(np.arange(len(codes)), at[:-1]))
        whole = np.add.reduceat(wrong.astype(np.int64), at[:-1]) > 0 if len(at) > 1 else np.zeros(0, bool)
        n = size[codes]
        skip = np.zeros(len(codes), np.int64)
        skip[at[:-1] + 1] = 1  # the added line end
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        use = ~whole[owner] if len(owner) else np.zeros(0, bool)
        n = np.where(use, n - skip, 0)
        start = begin[codes] + skip
        total = np.bincount(owner, n, len(at) - 1).astype(np.int64) if len(at) > 1 else np.zeros(0, np.int64)
        own = {int(i): np.array(self.encode(texts[int(i)].as_py()), np.uint32) for i in np.nonzero(whole)[0]}
        for i, ids in own.items():
            total[i] = len(ids)
        offsets = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(int(offsets[-1]), np.uint32)
        step = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        got = pool[np.repeat(start, n) + step]
        if own:
            filled = np.ones(len(out), bool)
            for i, ids in own.items():
                out[offsets[i]:offsets[i + 1]] = ids
                filled[offsets[i]:offsets[i + 1]] = False
            out[filled] = got
        else:
            out[:] = got
        return out, offsets


def encode_documents(docs: DataFrame, codec: Codec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers, n_tokens, ids_sha256, decoded_sha256)."""
    codec = codec or Codec.load()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, hashes, back, n = [], [], [], []
                for text in part.column("text").to_pylist():
                    got = codec.encode(text or "")
                    raw = np.array(got, "<u4").tobytes()
                    n.append(len(got))
                    ids.append(raw)
                    hashes.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(codec.decode(got)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(hashes), pa.array(back)],
                                                 ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, codec: Codec | None = None, ids_col: str = "ids") -> DataFrame:
    """(doc_id, raw): the bytes of each row's ids."""
    codec = codec or Codec.load()

    def run(batches):
        for batch in batches:
            raw = [codec.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    rows = encoded.select("doc_id", F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, raw binary")
