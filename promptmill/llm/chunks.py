"""Overlapping chunks of long texts, shared by the two tokenizer operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells one long row from another; identical rows share a key and are counted.
KEY = "doc_id bigint, text_key bigint, n_bytes bigint"
KEYS = ["doc_id", "text_key", "n_bytes"]


def is_long(chunk: int) -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) > chunk


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk: characters [no * chunk, (no + 1) * chunk + overlap) of the text. ``last`` marks the final one. Rows
    are dealt out anew, so that the chunks of one text go to many tasks."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                        F.octet_length("text").cast("bigint").alias("n_bytes"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                key = [batch.column(k).slice(row, 1) for k in KEYS]
                for at in range(0, len(starts), 256):
                    part = starts[at:at + 256]
                    again = pa.array([0] * len(part), pa.int64())
                    yield pa.record_batch(
                        [*[k.take(again) for k in key], pa.array([s // chunk for s in part], pa.int64()),
                         pa.array([text[s:s + chunk + overlap] for s in part], pa.string()),
                         pa.array([s == starts[-1] for s in part], pa.bool_())],
                        names=[*KEYS, "no", "chunk", "last"])
    cut_rows = keyed.mapInArrow(run, f"{KEY}, no bigint, chunk string, last boolean")
    return cut_rows.repartition(F.xxhash64("text_key", "no"))


def copies_of(rows: list[dict]) -> tuple[list[dict], int]:
    """The chunks of one text in order without repeats, and how many identical rows they stand for."""
    once = {}
    for r in rows:
        once.setdefault(r["no"], r)
    return [once[k] for k in sorted(once)], sum(r["no"] == 0 for r in rows)


def splice(chunks: list[dict], chunk: int, scan: Callable[[str, int], list[int]]) -> Iterator[tuple[int, int, int, str]]:
    """Walk over chunks with ``head`` and ``tail`` boundaries; ``scan(text, begin)`` gives the boundaries of a widened
    text after ``begin``. Yields (first chunk, begin, end, text) of each piece: ``text[begin:end]`` starts and ends at places
    where both neighbours have a boundary. Where two chunks share none, they are joined and scanned again, at twice the
    length before the next attempt, so a text without any boundary costs n log n."""
    first, text, tail, begin, step = 0, chunks[0]["chunk"], chunks[0]["tail"], 0, chunk
    due = 0
    for no, following in enumerate(chunks[1:], 1):
        heads = set(following["head"])
        meet = next((b for b in tail if b - step in heads and b > begin), None)
        if meet is not None:
            yield first, begin, meet, text
            first, text, tail, begin, step, due = no, following["chunk"], following["tail"], meet - step, chunk, 0
            continue
        text = text[:step] + following["chunk"]
        step += chunk
        tail = []
        if len(text) >= due or following["last"]:
            tail = [b for b in scan(text, begin) if b >= step]
            due = 2 * len(text)
    yield first, begin, len(text), text
