"""Token counts of whole texts by a public tokenizer.

A text is a row of words between blanks, tabs and line ends. Where the tokenizer cuts at white space before its merges, no token
reaches over it and no word changes the tokens of another; so the counts of words add up, and each worker asks the library once
for each word it has not met lately. A huge text is cut into overlapping chunks, whose word offsets come with the number of
tokens before them. Neighbouring chunks are spliced at a place where both start a token right after white space: what
stands left of it is complete in the left chunk, and what follows does not depend on what the right chunk cuts off. Where an
overlap has no such place, the chunks are joined (the overlap is widened) until there is one or the text ends.

Cases: a null or empty text has 0 tokens; identical rows give a row each; a null ``doc_id`` is kept; an empty table gives no
rows; other columns are ignored. The strings of special tokens inside a text are handled as the library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import _Held
from .chunks import KEY, KEYS, copies_of, cut, is_long, splice
from .sequences import slices

CHUNK = 1 << 15
OVERLAP = 1024
REMEMBERED = 300_000
#: White space that ends a word here: a part of what the tokenizer itself takes for white space.
_WORD = re.compile(r"[^ \t\n\r]+")
_BLANKS = str.maketrans("\t\n\r", "   ")


class Counter:
    """Tokens of words, remembered: twice the number, plus one where the first token starts at the word's first character."""

    def __init__(self, model: bytes):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {"": 0}

    def learn(self, words: set[str]) -> dict[str, int]:
        """Codes of all the words; words over 64 characters are not remembered."""
        if len(self.known) > REMEMBERED:
            self.known = {"": 0}
        new = [w for w in words if w not in self.known]
        extra = {}
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            for word, coded in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                n = len(coded)
                code = 2 * n + (n > 0 and coded.offsets[0][0] == 0)
                (self.known if len(word) <= 64 else extra)[word] = code
        return {**self.known, **extra} if extra else self.known

    def stable(self, text: str) -> tuple[list[int], list[int], int]:
        """Offsets where a token starts right after white space, the number of tokens before each, and the number of all."""
        found = [(m.start(), m.group()) for m in _WORD.finditer(text)]
        codes = self.learn({w for _, w in found})
        places, before, total = [], [], 0
        for start, word in found:
            code = codes[word]
            if code & 1 and start:
                places.append(start)
                before.append(total)
            total += code >> 1
        return places, before, total


@functools.lru_cache(maxsize=2)
def _counter(digest: str, holder) -> Counter:
    return Counter(holder.value)


class TokenCounter:
    """``model_path``: a tokenizers JSON file on the driver (a few MB, which bounds what is sent to the executors)."""

    def __init__(self, spark, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        with open(model_path, "rb") as f:
            model = f.read()
        self.digest = hashlib.sha256(model).hexdigest()
        self.held = _Held(spark.sparkContext.broadcast(model), self.digest)
        self.chunk, self.overlap = chunk, overlap

    def counter(self) -> Counter:
        return _counter(self.digest, self.held)

    def count(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_bytes and n_tokens of each row."""
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        schema = "doc_id bigint, n_bytes bigint, n_tokens bigint"
        whole = (rows.filter(~is_long(self.chunk))
                 .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
                 .mapInArrow(self._whole, schema))
        parts = (cut(rows.filter(is_long(self.chunk)), self.chunk, self.overlap)
                 .mapInArrow(self._chunks, f"{KEY}, no bigint, chunk string, last boolean, head array<int>, head_n array<int>, "
                                           "tail array<int>, tail_n array<int>, total int"))
        return whole.unionByName(parts.groupBy(*KEYS).applyInArrow(lambda table: self._splice(table), schema))

    def _whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = self.counter()
        for batch in batches:
            for part in slices(batch, budget=2 << 20):
                words = [(t or "").translate(_BLANKS).split(" ") for t in part.column("text").to_pylist()]
                codes = counter.learn(set().union(*words))
                n = [sum(code >> 1 for code in map(codes.__getitem__, w)) for w in words]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())],
                                      names=["doc_id", "n_bytes", "n_tokens"])

    def _chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, ints = self.counter(), pa.list_(pa.int32())
        for batch in batches:
            columns = [[], [], [], [], []]
            for text in batch.column("chunk").to_pylist():
                places, before, total = counter.stable(text)
                near = np.searchsorted(places, self.overlap, side="right")
                far = np.searchsorted(places, self.chunk)
                for column, value in zip(columns, (places[:near], before[:near], places[far:], before[far:], total)):
                    column.append(value)
            yield pa.record_batch([*batch.columns, *[pa.array(c, ints) for c in columns[:4]], pa.array(columns[4], pa.int32())],
                                  names=[*batch.schema.names, "head", "head_n", "tail", "tail_n", "total"])

    def _splice(self, table: pa.Table) -> pa.Table:
        rows, copies = copies_of(table.drop_columns(KEYS).to_pylist())
        counter, total = self.counter(), 0
        for first, begin, end, text in splice(rows, self.chunk, lambda t, at: counter.stable(t)[0]):
            row = rows[first]
            if text is row["chunk"]:
                before = dict(zip(row["head"], row["head_n"])) | dict(zip(row["tail"], row["tail_n"]))
                everything = row["total"]
            else:  # a widened text
                places, counts, everything = counter.stable(text)
                before = dict(zip(places, counts))
            total += (everything if end == len(text) else before[end]) - (before[begin] if begin else 0)
        again = pa.array([0] * copies, pa.int64())
        return pa.table([table["doc_id"].take(again), table["n_bytes"].take(again), pa.array([total] * copies, pa.int64())],
                        names=["doc_id", "n_bytes", "n_tokens"])
