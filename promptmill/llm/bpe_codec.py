"""Byte-level BPE encoding and decoding of whole texts.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. A scan from any true pre-token boundary
repeats the whole text's scan from there on, so two neighbouring chunks agree for good after the first boundary they share;
the text is cut there into pieces, the pieces are encoded in parallel and their ids put together. Decoding concatenates
the bytes of the ids.

Cases: a null text is empty and has no ids; a text shorter than a chunk is one piece; identical rows give a row each; a null
``doc_id`` is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import KEY, KEYS, copies_of, cut, is_long, splice
from .sequences import ragged, release_memory, slices

CHUNK = 1 << 15
OVERLAP = 512
#: Units of text whose ids a worker remembers.
REMEMBERED = 100_000
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")
_UNEVEN = re.compile(r"\s | \s")


class Codec:
    """Ranks and pattern of a vocabulary, with the ids of common units remembered.

    A blank between two characters that are not white space always starts a pre-token, and what stands left of it never
    looks past it. So a text may be encoded unit by unit, each a blank and what follows up to the next such blank."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        parts = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            parts[rank] = token
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    @functools.cached_property
    def encoding(self) -> tiktoken.Encoding:
        """Built at the first use: workers that only decode do without."""
        return tiktoken.Encoding("ranks", pat_str=self.pattern.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype=np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        if _UNEVEN.search(text):
            units = _BETWEEN.split(text)
            return b"".join([self._ids(u) for u in units])
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = [self._ids(first)]
        for part in rest:
            ids = known.get(part)
            if ids is None:
                ids = self._ids(" " + part)
                if len(part) <= 64:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.length[ids])]

    def boundaries(self, text: str, begin: int = 0) -> list[int]:
        """Starts of pre-tokens, for a scan from ``begin``; without those that what follows the text might change, and
        without those after white space (a run of white space is cut differently when nothing follows it)."""
        starts = (m.start() for m in self.pattern.finditer(text, begin))
        return [b for b in starts if 0 < b <= len(text) - 2 and not text[b - 1].isspace()]


@functools.lru_cache(maxsize=2)
def _codec(digest: str, pattern: str, holder) -> Codec:
    return Codec(holder.value, pattern)


class _Held:
    """A broadcast rank file; equal by digest, so a worker builds its codec once."""

    def __init__(self, holder, digest: str):
        self.holder, self.digest = holder, digest

    @property
    def value(self) -> bytes:
        return self.holder.value

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return self.digest == other.digest


class BytePairCoder:
    """``ranks_path``: a file of ranks on the driver (its size, a few MB, bounds what is sent to the executors)."""

    def __init__(self, spark, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        with open(ranks_path, "rb") as f:
            ranks = f.read()
        digest = hashlib.sha256(ranks).hexdigest()
        self.held, self.digest = _Held(spark.sparkContext.broadcast(ranks), digest), digest
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap

    def codec(self) -> Codec:
        return _codec(self.digest, self.pattern, self.held)

    def __getstate__(self):
        return self.__dict__

    def encode(self, docs: DataFrame) -> DataFrame:
        """doc_id and ids (array<int>) of each row."""
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        whole = rows.filter(~is_long(self.chunk)).mapInArrow(self._encode_whole, "doc_id bigint, ids array<int>")
        pieces = (cut(rows.filter(is_long(self.chunk)), self.chunk, self.overlap)
                  .mapInArrow(self._scan, f"{KEY}, no bigint, chunk string, last boolean, head array<int>, tail array<int>")
                  .groupBy(*KEYS).applyInArrow(lambda table: self._stitch(table), f"{KEY}, no bigint, copies int, piece string")
                  .repartition(F.xxhash64("text_key", "no"))
                  .mapInArrow(self._encode_pieces, f"{KEY}, no bigint, copies int, ids binary"))
        return whole.unionByName(pieces.groupBy(*KEYS).applyInArrow(_gather, "doc_id bigint, ids array<int>"))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Adds ``decoded`` (binary) to rows with ``ids``; null ids decode to no bytes."""
        from pyspark.sql.types import BinaryType, StructField, StructType
        schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
        return encoded.mapInArrow(self._decode, schema)

    def _encode_whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec()
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                ids = [codec.encode(t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])
        codec.known.clear()
        release_memory()

    def _scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec()
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("chunk").to_pylist():
                found = codec.boundaries(text)
                heads.append([b for b in found if b <= self.overlap])
                tails.append([b for b in found if b >= self.chunk])
            yield pa.record_batch([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                                  names=[*batch.schema.names, "head", "tail"])

    def _stitch(self, table: pa.Table) -> pa.Table:
        chunks, copies = copies_of(table.select(["no", "chunk", "last", "head", "tail"]).to_pylist())
        pieces = [(no, text[begin:end]) for no, begin, end, text in splice(chunks, self.chunk, self.codec().boundaries)]
        again = pa.array([0] * len(pieces), pa.int64())
        return pa.table([*[table[k].take(again) for k in KEYS], pa.array([p[0] for p in pieces], pa.int64()),
                         pa.array([copies] * len(pieces), pa.int32()), pa.array([p[1] for p in pieces], pa.string())],
                        names=[*KEYS, "no", "copies", "piece"])

    def _encode_pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec()
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column("piece").to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*batch.schema.names[:-1], "ids"])

    def _decode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = self.codec()
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                values = ids.values
                texts.append(b"" if values is None else codec.decode(np.asarray(values)).tobytes())
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])
        release_memory()


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def _gather(table: pa.Table) -> pa.Table:
    """The ids of one long text in order, as often as the row occurred."""
    table = table.sort_by("no")
    ids = b"".join(table["ids"].to_pylist())
    copies = table["copies"][0].as_py()
    return pa.table([table["doc_id"].take(pa.array([0] * copies, pa.int64())), _lists([ids] * copies)], names=["doc_id", "ids"])


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 (of the decimal ids, one blank between) and decoded_sha256 of decoded rows."""
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
