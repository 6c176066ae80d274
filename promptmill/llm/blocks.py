"""Documents in blocks, and answers about keys that travel from blocks to buckets and back.

A block is a group of documents of about ``BLOCK_BYTES`` bytes, dealt by the hash of the row. For questions such as "which of my
hashes does another document hold?" each block sends every different key once, packed by bucket, however often the block holds
it. So a key that a third of all rows hold costs its bucket one entry for each block, and the shuffle carries packed numbers in
place of rows. The answers go back to the blocks, which meet their documents there: the shuffled documents are the same
exchange in every step, and Spark reuses it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .sequences import first_of_groups, release_memory

BLOCK_BYTES = 2 << 20
#: One row of packed keys or answers: where it comes from or goes to, what it says, and up to four arrays.
ROW = "block int, bucket int, kind int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()),
                     ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def text_bytes(docs: DataFrame) -> int:
    return int(docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(documents with their block, number of blocks); columns doc_id, text and ``more``."""
    count = max(1, math.ceil(text_bytes(docs) / block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")
    return docs.select(block.alias("block"), "doc_id", "text", *more), count


def buckets_for(blocks: int, blocks_each: int = 4) -> int:
    """Buckets grow with the blocks; ``blocks_each`` is how many blocks' keys make about one block (1 where most of the text
    may travel). A block sends a packed row to each bucket it has keys for, so there are no more rows than keys."""
    return max(4, blocks // blocks_each)


def in_order(table: pa.Table) -> pa.Table:
    """The block's documents in an order that does not depend on how the shuffle delivered them."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def doc_ids(table: pa.Table) -> np.ndarray:
    """The ids as numbers; a null id counts as larger than every other."""
    ids = table["doc_id"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
    return np.asarray(ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).max))


def pack(block: int, bucket: int, kind: int = 0, *arrays: np.ndarray | bytes) -> tuple:
    data = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    return (block, bucket, kind, *data, *[None] * (4 - len(data)))


def rows_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(col, type=f.type) for col, f in zip(zip(*rows), _SCHEMA)] if rows else
                    [pa.array([], type=f.type) for f in _SCHEMA], schema=_SCHEMA)


def deal(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its keys), for the buckets that have any."""
    home = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    first = np.searchsorted(home[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(first)):
        yield int(k), order[first[k]:first[k + 1]]


def _freeing(run: Callable, *args) -> pa.Table:
    """The result, with what was needed on the way given back to the system: a worker serves other steps afterwards, next to others."""
    try:
        return run(*args)
    finally:
        release_memory()


def per_block(docs: DataFrame, run: Callable[[int, pa.Table], pa.Table], schema: str = ROW) -> DataFrame:
    """``run(block, documents in order)`` for each block."""
    def work(table: pa.Table) -> pa.Table:
        return _freeing(run, table["block"][0].as_py(), in_order(table))
    return docs.groupBy("block").applyInArrow(work, schema)


def per_bucket(rows: DataFrame, run: Callable[[int, list[tuple]], list[tuple]]) -> DataFrame:
    """``run(bucket, [(block, kind, a, b, c, d), ...])`` for each bucket; it returns packed rows."""
    def work(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        columns = [table[n].to_pylist() for n in ("block", "kind", "a", "b", "c", "d")]
        return rows_table(run(bucket, sorted(zip(*columns), key=lambda r: (r[0], r[1]))))
    return rows.groupBy("bucket").applyInArrow(work, ROW)


def back_to_blocks(docs: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, list[tuple]], pa.Table],
                   schema: str | StructType = ROW) -> DataFrame:
    """``run(block, documents in order, [(bucket, kind, a, b, c, d), ...])`` for each block of documents."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return empty_like(schema)
        columns = [right[n].to_pylist() for n in ("bucket", "kind", "a", "b", "c", "d")]
        return _freeing(run, left["block"][0].as_py(), in_order(left), sorted(zip(*columns), key=lambda r: (r[0], r[1])))
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)


def empty_like(schema: str | StructType) -> pa.Table:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()


def shared_keys(rows: list[tuple]) -> list[np.ndarray]:
    """Reduce step of a bucket. Each row's ``a`` holds ordered 32-bit keys of one block whose lowest bit says that the block
    itself holds the key more than once. Returns, for each row, those of its keys that occur more than once in all."""
    parts = [np.frombuffer(r[2], dtype=np.uint32) for r in rows]
    every = np.concatenate(parts)
    order = np.argsort(every >> np.uint32(1), kind="stable")
    key = every[order] >> np.uint32(1)
    first = first_of_groups(key)
    count = np.diff(np.append(first, len(key)))
    twice = np.bitwise_or.reduceat(every[order] & np.uint32(1), first) > 0 if len(first) else np.empty(0, bool)
    hit = np.empty(len(every), dtype=bool)
    hit[order] = np.repeat((count > 1) | twice, count)
    out, at = [], 0
    for p in parts:
        out.append((p >> np.uint32(1))[hit[at:at + len(p)]])
        at += len(p)
    return out
