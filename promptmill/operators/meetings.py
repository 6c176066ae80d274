"""Blocks of one table that meet blocks of another.

A block is one row that holds its rows in a list. Spark's Cartesian product hands a task some left blocks and some right ones, which it
reads from where they were written once: no copy of a block is shuffled for each block that it meets, so the disk that meetings
take grows with the blocks, not with their pairs. A task sees all right blocks of its share for one left block before those for the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of right blocks that a task holds, and how many tasks there are while each has several left blocks.
HELD_BYTES, TASKS = 32 << 20, 4096


def packed(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row a block: what names it, and ``rows``."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            found = {name: batch.column(name)[k] for name in batch.schema.names}
            yield {name: x.values if isinstance(x, pa.ListScalar) else x.as_py() for name, x in found.items()}


def meet(left: DataFrame, right: DataFrame, blocks: int, held: int, where: Column | None,
         run: Callable[[Iterator[dict]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """``run`` over the meetings of left and right blocks that ``where`` allows, as records of the columns of both (no name twice). The
    left table has ``blocks`` rows, the right one holds ``held`` bytes."""
    right_parts = max(1, -(-int(held) // HELD_BYTES))
    left_parts = max(1, min(int(blocks), -(-TASKS // right_parts)))
    both = right.repartition(right_parts).hint("shuffle_replicate_nl")
    pairs = left.repartition(left_parts).join(both, F.lit(True) if where is None else where)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in run(_met(batches)):
            yield from table.to_batches()
    return pairs.mapInArrow(go, schema)
