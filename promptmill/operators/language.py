"""Language detection with character 3-gram profiles learned from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize

#: Entries of the profiles that one pass sends to the tasks; larger profiles take several passes.
PASS_ENTRIES = 4_000_000


def _padded(c) -> Column:
    """The normalised text with a blank at both ends."""
    return F.concat(F.lit(" "), tx.norm_text(c), F.lit(" "))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlapping 3-character runs of a batch's texts, counted by language."""
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.setdefault(name, []).append(_codes(text))
        for name, codes in found.items():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            letters = np.stack([code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            yield pa.record_batch([pa.array([name] * len(code), pa.string()), pa.array([letters[i:i + 3] for i in range(0, len(letters), 3)], pa.string()),
                                   pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def language_profiles(df: DataFrame, text: str, lang: str, size: int | None = None) -> DataFrame:
    """``lang, gram, weight``: the log-probability in millionths of every 3-gram of every language, and under the empty gram that
    of a 3-gram the language does not have. Add-one smoothing: (n + 1) / (N + V), with N the 3-grams of the language and V
    the different ones of all languages. ``size`` keeps only that many of the most frequent per language."""
    texts = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _padded(text).alias("text"))
    counts = texts.mapInArrow(_counted, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    different = counts.agg(F.countDistinct("gram").alias("v")).scalar()
    totals = materialize(counts.groupBy("lang").agg((F.sum("n") + different).alias("total")))

    def weight(n) -> Column:
        return F.round(F.ln(n / F.col("total")) * 1_000_000).cast("bigint").alias("weight")
    if size is not None:
        w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
        counts = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size)
    seen = counts.join(totals, "lang").select("lang", "gram", weight(F.col("n") + 1))
    return materialize(seen.unionByName(totals.select("lang", F.lit("").alias("gram"), weight(F.lit(1.0)))))


def _codes(text: str) -> np.ndarray:
    """One number per 3-character run."""
    c = tx.code_points(text).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _gains(profile: pd.DataFrame, languages: list[str], unseen: np.ndarray):
    """A function from texts to [gain over unseen of each language ..., 3-grams that any language has]."""
    code = np.array([_codes(g)[0] for g in profile["gram"]], dtype=np.int64)
    known, place = np.unique(code, return_inverse=True)
    gain = np.zeros((len(known) + 1, len(languages) + 1), dtype=np.int64)
    row = profile["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy()
    gain[place, row] = profile["weight"].to_numpy() - unseen[row]
    gain[:-1, -1] = 1

    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = _codes(t or "")
            at = np.searchsorted(known, codes)
            at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != codes)] = len(known)
            out.append(gain[at].sum(axis=0))
        return pd.Series(out)
    return score


def _gain_column(sent, languages: list[str], unseen: np.ndarray):
    @F.pandas_udf("array<bigint>")
    def gain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = _gains(sent.value, languages, unseen)
        for batch in batches:
            yield score(batch)
    return gain


def detect_language(df: DataFrame, text: str, profiles: DataFrame, out: str = "detected", pass_entries: int = PASS_ENTRIES) -> DataFrame:
    """Add ``detected``: the language under which the text's 3-grams are likeliest (ties by name), ``unknown`` for blank texts and
    texts without any known 3-gram.

    One expression per row: its 3-grams are looked up in the sorted profile inside the task, in batches; nothing is exploded,
    shuffled or joined back. Profiles are sent in parts of at most ``pass_entries``, whose gains add up."""
    unseen_rows = sorted((r["lang"], r["weight"]) for r in profiles.where("gram = ''").collect())
    if not unseen_rows:
        return df.withColumn(out, F.lit("unknown"))
    languages, unseen = [r[0] for r in unseen_rows], np.array([r[1] for r in unseen_rows])
    entries = profiles.where("gram <> ''")
    parts = max(1, -(-entries.count() // pass_entries))
    padded = _padded(text)
    gains = None
    for part in range(parts):
        own = entries.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part) if parts > 1 else entries
        found = _gain_column(df.sparkSession.sparkContext.broadcast(own.toPandas()), languages, unseen)(padded)
        gains = found if gains is None else F.zip_with(gains, found, lambda a, b: a + b)
    runs = F.greatest(F.length(padded) - 2, F.lit(0)).cast("bigint")
    scores = F.array(*[F.struct((-(F.col("_gains")[k] + F.col("_runs") * F.lit(int(u)).cast("bigint"))).alias("cost"), F.lit(name).alias("lang"))
                       for k, (name, u) in enumerate(zip(languages, unseen))])
    return (df.withColumn("_gains", gains).withColumn("_runs", runs)
            .withColumn(out, F.when(F.coalesce(F.col("_gains")[len(languages)], F.lit(0)) == 0, F.lit("unknown"))
                        .otherwise(F.array_min(scores).getField("lang"))).drop("_gains", "_runs"))


def language_distribution(df: DataFrame, fields: list[str], key: str, profiles: DataFrame) -> DataFrame:
    """Rows and share per text field and detected language, the main language of the field, and whether
    any field has more than one language."""
    cells = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])))
    counts = (detect_language(cells, "text", profiles)
              .groupBy("field", "detected").agg(F.count("*").alias("n")))
    # A handful of languages per field from here on.
    per_field = Window.partitionBy("field")
    first = per_field.orderBy(F.desc("n"), "detected")
    sized = counts.withColumn("_k", F.count("*").over(per_field))
    return sized.select(
        "field", "detected", "n", (100.0 * F.col("n") / F.sum("n").over(per_field)).alias("share_pct"),
        (F.row_number().over(first) == 1).alias("is_main"),
        (F.max("_k").over(Window.partitionBy(F.lit(0))) > 1).alias("multilingual"))
