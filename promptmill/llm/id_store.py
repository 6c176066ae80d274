"""Token ids of documents in raw files, with an index by document key that is a minimal perfect hash.

``write`` lays the documents out in ascending order of their ids and writes their token ids, each document closed by an end id, into
shard files of raw little-endian integers (16 bits where the vocabulary allows, else 32): ``ids/shard=<number>/<one file>``. Shards never
hold more than ``shard_rows`` documents, nor more than ``shard_bytes`` but for one longer document. ``read`` finds documents by key: a hash
of the key names the index bucket, the bucket's perfect hash the slot, and the slot holds fingerprint, shard, offset, length, and the
number of ids of all documents before. A key without document fails by its fingerprint (but once in 2**32).

The perfect hash has levels of bits. Each key sets one bit of the first level; a bit that one key alone has set is the
key's, and the other keys go on to the next level. The slot is the number of bits before the key's own, from counts kept every 64 bytes.
Buckets have about ``BUCKET_KEYS`` keys each and are built apart from each other.

How it scales: documents are dealt into ranges by id, and equal ids by the hash of their text and a random number, so an id that a third
of all rows hold fills many ranges. Tokens are made inside the ranges, once. What precedes a shard comes from a running total over a
table with one row per shard. The files go through Spark's own text writer, whose line separator is the end id, and are committed like any
other output; nothing passes the driver.

A document's key is its id and its number among the rows of that id (0, 1, ...). Cases: a null text is empty and has the end id only; rows
of one id stand in order of their text's hash, and identical rows one after the other; rows without id come last and have keys of
their own; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running_total
from ..session import discard, materialize, scratch_root
from .blocks import text_bytes
from .bpe_codec import _Held
from .sequences import mix, release_memory, slices

RANGE_BYTES, SHARD_BYTES, SHARD_ROWS, BUCKET_KEYS = 32 << 20, 4 << 20, 1 << 16, 1 << 16
#: Words, and parts of words, that a worker remembers.
REMEMBERED = 160_000
PIECE = 1 << 20

# --- tokens -----------------------------------------------------------------------------------------------------------------------

#: Texts of ASCII but for controls, and of letters of the two Latin blocks whose lower case and composition all versions of Unicode share.
_PLAIN = re.compile("[ \t\n\r!-~À-ÖØ-öø-įı-ňŊ-ſ]*")
#: The pre-tokens of such a text in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t\n\ra-z0-9ß-öø-ſ]+")
#: The steps before the merges that the short way below repeats for plain texts; any other model goes through the library.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}


class _Known(dict):
    """Ids by text; what is missing is encoded, and remembered if it is short. When ``REMEMBERED`` are held, all but those met since the
    last time are given up."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= 32:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Words:
    """Ids of texts by a tokenizer that cuts at white space. A plain text is cut into its pre-tokens here, and the library's merges turn each
    into ids; any other goes through the whole library, word by word. ``short``: whether the model's steps allow the former."""

    def __init__(self, model: bytes, short: bool, special: list[str]):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(model.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges, self.short, self.special = self.tokenizer.model, short, special
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.bytes_of = [array(self.code, [i]).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.forget()

    def forget(self) -> None:
        self.parts, self.words = _Known(self._part), _Known(self._word)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.translate(self.letters)
        data = self.bytes_of
        return b"".join([data[t.id] for t in self.merges.tokenize(part)])

    def _word(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:  # a text is cut at white space only
                end = text.rfind(" ", at, at + PIECE)
                end = end if end > at else text.find(" ", at + PIECE)
                end = end if end > at else len(text)
            piece = text[at:end]
            if self.short and _PLAIN.fullmatch(piece) and not any(s in piece for s in self.special):
                known, units = self.parts, _PARTS.findall(piece.lower())
            else:
                known, units = self.words, piece.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out += [known[u] for u in units]
            at = end
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def _words(digest: str, holder, short: bool, special: tuple[str, ...]) -> Words:
    return Words(holder.value, short, list(special))


class WordEncoder:
    """``model_path``: a tokenizers JSON file on the driver (a few MB, which bounds what is sent to the executors) whose
    pre-tokenizer cuts at white space."""

    def __init__(self, spark: SparkSession, model_path: str):
        with open(model_path, "rb") as f:
            model = f.read()
        self.digest = hashlib.sha256(model).hexdigest()
        self.held = _Held(spark.sparkContext.broadcast(model), self.digest)
        steps = json.loads(model)
        self.short = all(steps[name] == value for name, value in _STEPS.items())
        self.special = tuple(t["content"] for t in steps["added_tokens"])
        self.code = Words(model, self.short, list(self.special)).code

    def words(self) -> Words:
        return _words(self.digest, self.held, self.short, self.special)


# --- the perfect hash -------------------------------------------------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
LEVELS, BITS_PER_KEY, RANK_BYTES = 24, 1.5, 64


def key_hashes(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A hash of each key (id, number); keys of number 0 never share one."""
    return mix(mix(ids.astype(np.uint64) + _STEP) + numbers.astype(np.uint64) * _STEP)


def _places(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((level + 1) * int(_STEP) % 2**64)
    return (mix(hashes + salt) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Slots 0 .. n - 1 of n keys given as hashes. Keys that the levels cannot tell apart (equal hashes) are kept as they are."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest  # rest: rows (id, number), in order of their slots
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        padded = np.concatenate([bits, np.zeros(-len(bits) % RANK_BYTES, np.uint8)])
        ones = _ONES[padded].reshape(-1, RANK_BYTES).sum(axis=1, dtype=np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.inside = (np.cumsum(_ONES[padded].reshape(-1, RANK_BYTES), axis=1, dtype=np.uint16)
                       - _ONES[padded].reshape(-1, RANK_BYTES)).ravel()
        self.set = int(ones.sum())

    @classmethod
    def build(cls, ids: np.ndarray, numbers: np.ndarray) -> PerfectHash:
        hashes = key_hashes(ids, numbers)
        left, sizes, levels = np.arange(len(hashes)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            bits = max(64, int(BITS_PER_KEY * len(left)) + 63 & ~63)
            place = _places(hashes[left], level, bits)
            alone = np.bincount(place, minlength=bits) == 1
            sizes.append(bits)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, np.uint8), np.stack([ids[left], numbers[left]], axis=1))

    def slots(self, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, any slot or -1."""
        hashes = key_hashes(ids, numbers)
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        for level, bits in enumerate(self.sizes):
            place = self.first[level] + _places(hashes[left], level, bits)
            byte, bit = place >> 3, (place & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            below = _ONES[self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1))]
            out[left[hit]] = (self.ranks[byte // RANK_BYTES] + self.inside[byte] + below)[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            rest = {(int(a), int(b)): self.set + k for k, (a, b) in enumerate(self.rest)}
            out[left] = [rest.get((int(ids[i]), int(numbers[i])), -1) for i in left]
        return out


ENTRY = np.dtype([("print", "<u4"), ("shard", "<i8"), ("at", "<i8"), ("n", "<i8"), ("start", "<i8")])
INDEX = "bucket int, n bigint, sizes array<bigint>, bits binary, rest binary, entries binary"
_KEY = "bucket int, id bigint, number bigint"


def fingerprints(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (mix(key_hashes(ids, numbers) ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def _build(table: pa.Table) -> pa.Table:
    column = {n: np.asarray(table[n]) for n in ("id", "number", "shard", "at", "n", "start")}
    perfect = PerfectHash.build(column["id"], column["number"])
    slot = perfect.slots(column["id"], column["number"])
    entries = np.zeros(len(slot), dtype=ENTRY)
    entries["print"][slot] = fingerprints(column["id"], column["number"])
    for name in ("shard", "at", "n", "start"):
        entries[name][slot] = column[name]
    return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([len(slot)], pa.int64()),
                     pa.array([perfect.sizes], pa.list_(pa.int64())), pa.array([perfect.bits.tobytes()], pa.binary()),
                     pa.array([perfect.rest.astype(np.int64).tobytes()], pa.binary()), pa.array([entries.tobytes()], pa.binary())],
                    names=["bucket", "n", "sizes", "bits", "rest", "entries"])


FOUND = "id bigint, number bigint, shard bigint, at bigint, n bigint, start bigint"


def _look_up(index: pa.Table, keys: pa.Table) -> pa.Table:
    names = ["id", "number", "shard", "at", "n", "start"]
    if not (index.num_rows and keys.num_rows):
        return pa.table([pa.array([], pa.int64())] * 6, names=names)
    row = index.to_pylist()[0]
    perfect = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["rest"], np.int64).reshape(-1, 2))
    entries = np.frombuffer(row["entries"], dtype=ENTRY)
    ids, numbers = np.asarray(keys["id"]), np.asarray(keys["number"])
    slot = perfect.slots(ids, numbers)
    known = (slot >= 0) & (entries["print"][slot] == fingerprints(ids, numbers))
    entry = entries[slot[known]]
    return pa.table([pa.array(x) for x in (ids[known], numbers[known], *[np.ascontiguousarray(entry[n]) for n in names[2:]])], names=names)


# --- the store --------------------------------------------------------------------------------------------------------------------

_SHARD = pa.schema([("shard", pa.int64()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64())),
                    ("n", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
                    ("tail", pa.int64())])
_SHARD_SQL = ("shard bigint, payload binary, ids array<bigint>, numbers array<bigint>, n array<bigint>, n_ids bigint, first_id bigint, "
              "last_id bigint, tail bigint")


def _shards(batches: Iterator[pa.RecordBatch], words: Words, end: bytes, shard_bytes: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """The documents of a range, in order, as shards; ``numbers`` count the rows of an id inside the shard."""
    part, no, size = TaskContext.get().partitionId(), 0, 0
    width = len(end)
    ids: list[int | None] = []
    coded: list[bytes] = []

    def flush() -> pa.RecordBatch:
        numbers, last = [], 0
        for k, i in enumerate(ids):
            last = last + 1 if k and i == ids[k - 1] else 0
            numbers.append(last)
        n = [len(c) // width for c in coded]
        row = [part << 32 | no, b"".join(coded)[:-width], list(ids), numbers, n, sum(n), ids[0], ids[-1], last + 1]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _SHARD)], schema=_SHARD)
    for batch in batches:
        for piece in slices(batch):
            for i, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                one = words.encode(text or "") + end
                if coded and (size + len(one) > shard_bytes or len(coded) == shard_rows):
                    yield flush()
                    no, size = no + 1, 0
                    ids.clear()
                    coded.clear()
                ids.append(i)
                coded.append(one)
                size += len(one)
    if coded:
        yield flush()
    # what comes next on this machine needs the room
    words.forget()
    release_memory()


def _keyed(keys: DataFrame, buckets: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (doc_id, number) with bucket, id and number; a null id counts its numbers down from -1 under id 0."""
    types = "".join(f", {c} bigint" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.asarray(batch.column("doc_id").is_null())
            ids = np.asarray(batch.column("doc_id").fill_null(0))
            numbers = np.asarray(batch.column("number"))
            numbers = np.where(null, -1 - numbers, numbers)
            bucket = (mix(key_hashes(ids, numbers) + np.uint64(7)) % np.uint64(buckets)).astype(np.int32)
            yield pa.record_batch([pa.array(bucket), pa.array(ids), pa.array(numbers), *[batch.column(c) for c in more]],
                                  names=["bucket", "id", "number", *more])
    return keys.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("number").cast("bigint").alias("number"), *more).mapInArrow(
        run, _KEY + types)


def keys_of(docs: DataFrame) -> DataFrame:
    """doc_id and number of every row: rows are counted per id first, so a frequent id is one row of the shuffle per task."""
    return docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).count().select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("number"))


@dataclass
class IdStore:
    """Shard files and index of a written store."""

    spark: SparkSession
    path: str
    buckets: int
    code: str
    end: int

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def find(self, keys: DataFrame) -> DataFrame:
        """id, number, shard, offset ``at`` and length ``n`` in ids, and ``start`` of the keys (doc_id, number) that the store holds."""
        asked = _keyed(keys.distinct(), self.buckets)
        return self.index().groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_look_up, FOUND)

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, number, start, n_tokens and ids (as little-endian unsigned 32-bit integers, end id included) of the keys (doc_id,
        number) that the store holds, each once. Only the shards that hold one are read."""
        schema = "doc_id bigint, number bigint, start bigint, n_tokens bigint, ids binary"
        code = np.dtype(np.uint16 if self.code == "H" else np.uint32)
        if not self.index().head(1):
            return self.spark.createDataFrame([], schema)
        found = materialize(self.find(keys))
        files = (self.spark.read.format("binaryFile").load(f"{self.path}/ids").select(F.col("shard").cast("bigint").alias("shard"), "content")
                 .join(found.select("shard").distinct(), "shard", "left_semi"))

        def take(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["doc_id", "number", "start", "n_tokens", "ids"]
            columns = {n: np.asarray(right[n]) for n in ("id", "number", "start", "at", "n")}
            payload = np.frombuffer(left["content"][0].as_buffer(), dtype=code) if left.num_rows else np.empty(0, code)
            ids = [payload[a:a + n].astype("<u4").tobytes() for a, n in zip(columns["at"].tolist(), columns["n"].tolist())]
            null = columns["number"] < 0
            return pa.table([pa.array(columns["id"], mask=null), pa.array(np.where(null, -1 - columns["number"], columns["number"])),
                             pa.array(columns["start"]), pa.array(columns["n"]), pa.array(ids, pa.binary())], names=names)
        return files.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(take, schema)


def write(docs: DataFrame, encoder: WordEncoder, end: int, path: str | None = None, range_bytes: int = RANGE_BYTES,
          shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS, bucket_keys: int = BUCKET_KEYS) -> IdStore:
    """Encode ``docs`` (doc_id, text), close each document with the id ``end``, and write files and index under ``path`` (a folder that all
    executors reach; by default one in the session's folder for intermediate tables)."""
    spark = docs.sparkSession
    path = path or f"{scratch_root(spark).rstrip('/')}/promptmill/ids-{uuid.uuid4().hex}"
    closing = array(encoder.code, [end]).tobytes()
    ranges = max(1, -(-text_bytes(docs) // range_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # equal ids by their text, identical rows in any order: the last number only spreads them over the ranges
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.rand(1)]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    shards = materialize(dealt.mapInArrow(lambda batches: _shards(batches, encoder.words(), closing, shard_bytes, shard_rows), _SHARD_SQL),
                         **{"parquet.block.size": 16 << 20})
    (shards.select(F.col("payload").cast("string").alias("value"), "shard").write.partitionBy("shard")
     .option("lineSep", closing.decode("utf-8")).text(f"{path}/ids"))
    located = _located(shards)
    count = docs.count()
    buckets = max(1, -(-count // bucket_keys))
    keyed = _keyed(located, buckets, ("shard", "at", "n", "start"))
    keyed.groupBy("bucket").applyInArrow(_build, INDEX).write.parquet(f"{path}/index")
    discard(shards)
    return IdStore(spark, path, buckets, encoder.code, end)


def _located(shards: DataFrame) -> DataFrame:
    """doc_id, number among the rows of the id, shard, at, n and start of each document, from tables of one row per shard."""
    small = materialize(shards.select("shard", "n_ids", "first_id", "last_id", "tail"))
    starts = running_total(small.select("shard", "n_ids"), ["n_ids"], ["shard"]).select("shard", F.col("n_ids_before").alias("base"))
    # rows of an id in earlier shards: what their ends hold of it, met by the shards that begin with it
    events = small.select(F.col("last_id").alias("id"), "shard", F.lit(1).alias("kind"), "tail").unionByName(
        small.select(F.col("first_id").alias("id"), "shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tail")))
    before = Window.partitionBy("id").orderBy("shard", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.withColumn("carry", F.coalesce(F.sum("tail").over(before), F.lit(0))).filter("kind = 0").select("shard", "carry")
    placed = shards.select("shard", "ids", "numbers", "n", "first_id").join(starts, "shard").join(carried, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in ("shard", "first_id", "base", "carry")}
                ids, n = batch.column("ids")[row].values, np.asarray(batch.column("n")[row].values)
                numbers = np.asarray(batch.column("numbers")[row].values)
                # only the first rows of a shard can go on with an id of the shard before
                more = np.flatnonzero(numbers == 0)
                lead = int(more[1]) if len(more) > 1 else len(numbers)
                numbers = numbers + np.where(np.arange(len(numbers)) < lead, one["carry"].as_py(), 0)
                at = np.cumsum(n) - n
                yield pa.record_batch([ids, pa.array(numbers), pa.array(np.full(len(n), one["shard"].as_py(), np.int64)), pa.array(at),
                                       pa.array(n), pa.array(one["base"].as_py() + at)],
                                      names=["doc_id", "number", "shard", "at", "n", "start"])
    return placed.mapInArrow(run, "doc_id bigint, number bigint, shard bigint, at bigint, n bigint, start bigint")
