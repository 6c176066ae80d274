"""Text expressions. All are native columns but ``char_shingles``, whose characters are cut by numpy inside the task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixedvalues as fv

# Unicode white space as Python's str.split and str.strip see it: as a regex (a plain Java \\s is ASCII only, and one made Unicode
# looks every character up) and as the characters to trim.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_CHARACTERS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(SPACE_CHARACTERS))


def collapse(c) -> Column:
    # A single blank stays as it is: only other white space and longer runs are matched.
    return F.regexp_replace(_col(c), f" {SPACE}+|(?! ){SPACE}{SPACE}*", " ")


def norm_text(c) -> Column:
    """Lowercase, white space collapsed to single blanks, no outer blanks."""
    return F.trim(collapse(F.lower(_col(c))))


def trim_key(c) -> Column:
    """Lowercase without outer white space; inner white space and nulls stay."""
    return F.lower(strip(c))


def norm_simple(c) -> Column:
    """Lowercase, ASCII punctuation deleted, outer white space removed."""
    return strip(F.translate(F.lower(_col(c)), fv.PUNCTUATION, ""))


def text_signature(c) -> Column:
    return F.md5(norm_text(c))


def clean_output(c) -> Column:
    """Tidy one generated line: quotes and backticks off, one list marker off, a leading
    ``prompt:`` off, white space collapsed."""
    edge = "[`\"' \n]+"
    t = strip(c)
    t = F.regexp_replace(t, f"^{edge}|{edge}$", "")
    t = F.regexp_replace(t, rf"^{SPACE}*(?U:[\-*\d.)]){SPACE}+", "")
    t = F.regexp_replace(t, rf"(?i)^prompt{SPACE}*:{SPACE}*", "")
    return F.trim(collapse(t))


def ws_tokens(c) -> Column:
    """White-space tokens, case kept."""
    return F.array_remove(F.split(_col(c), f"{SPACE}+"), "")


def word_tokens(c) -> Column:
    """Lowercased words of at least two word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(fv.WORD_PATTERN), F.lit(0))


def windows_of(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` neighbouring tokens, joined; empty when there are fewer than ``n``. The list is
    zipped with itself moved by one, two, ... places: linear, while a slice per run copies the list."""
    if n == 1:
        return tokens

    def runs(t: Column) -> Column:
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        out = F.slice(t, 1, count)
        for shift in range(1, n):
            out = F.zip_with(out, F.slice(t, shift + 1, count), lambda a, b: F.concat(a, F.lit(sep), b))
        return out
    return let(tokens, runs)


def ngrams(c, n: int) -> Column:
    return windows_of(ws_tokens(c), n)


def word_shingles(c, n: int = 3) -> Column:
    """Word n-grams of the normalised text; a shorter text is one shingle, an empty one has none."""
    return let(ws_tokens(F.lower(_col(c))), lambda t: (
        F.when(F.size(t) == 0, F.array().cast("array<string>"))
        .when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(windows_of(t, n))))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _distinct_runs(text: str, k: int) -> tuple[bytes, np.ndarray]:
    """The different runs of ``k`` characters in the order of their first places: their bytes, and how many each has."""
    x = code_points(text)
    if len(x) < k:
        raw = text.encode()
        return raw, np.array([len(raw)])
    runs = np.lib.stride_tricks.sliding_window_view(x, k)
    number, bits = x, int(x.max()).bit_length()
    if bits * k > 63:
        alphabet, number = np.unique(x, return_inverse=True)
        bits = (len(alphabet) - 1).bit_length()
    if bits * k > 63:
        first = [*{bytes(run): i for i, run in reversed([*enumerate(runs)])}.values()]
    else:
        code = np.zeros(len(runs), dtype=np.int64)
        for j in range(k):
            code = (code << bits) | number[j:j + len(runs)].astype(np.int64)
        first = np.unique(code, return_index=True)[1]
    kept = runs[np.sort(first)]
    sizes = (1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000)).sum(axis=1)
    return kept.tobytes().decode("utf-32-le").encode(), sizes


def _shingle_lists(texts: pa.Array, k: int) -> pa.Array:
    parts = [(b"", np.empty(0, np.int64)) if t is None else _distinct_runs(t, k) for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum(np.concatenate([sizes for _, sizes in parts]))]).astype(np.int32) if parts else np.zeros(1, np.int32)
    strings = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(raw for raw, _ in parts)))
    lists = np.cumsum([0, *[len(sizes) for _, sizes in parts]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), strings, mask=texts.is_null())


def char_shingles(c, k: int = 5) -> Column:
    """Distinct substrings of ``k`` characters; a shorter text is its own single shingle."""
    @F.arrow_udf("array<string>")
    def shingles(texts: pa.Array) -> pa.Array:
        return _shingle_lists(texts, k)
    return shingles(_col(c))


def script_language(c) -> Column:
    """``CN`` when a CJK character occurs, ``FR`` when an accented letter does, else ``EN``."""
    t = _col(c)
    return (F.when(t.isNull(), "unk").when(t.rlike(fv.CJK_PATTERN), "CN")
            .when(F.lower(t).rlike(fv.ACCENT_PATTERN), "FR").otherwise("EN"))


def contains_any(c, words: list[str]) -> Column:
    t = F.lower(_col(c))
    return reduce(lambda a, b: a | b, [t.contains(w) for w in words])


def is_factual(c) -> Column:
    return contains_any(c, fv.FACTUAL_WORDS)


def is_creative(c) -> Column:
    return contains_any(c, fv.CREATIVE_WORDS)


def is_instruction(c) -> Column:
    return contains_any(c, fv.INSTRUCTION_WORDS)


def is_question(c) -> Column:
    return _col(c).contains("?")


def is_triplet_friendly(c) -> Column:
    return contains_any(c, fv.TRIPLET_WORDS)


def entities(c) -> Column:
    """Capitalised words in order, with repeats."""
    return F.regexp_extract_all(_col(c), F.lit(fv.CAPITALISED_PATTERN), F.lit(0))


def n_entities(c) -> Column:
    return F.size(F.array_distinct(entities(c)))


def n_dates(c) -> Column:
    return F.regexp_count(_col(c), F.lit(fv.DATE_PATTERN))


def n_numbers(c) -> Column:
    return F.regexp_count(_col(c), F.lit(fv.NUMBER_PATTERN))


def n_words(c) -> Column:
    return F.size(ws_tokens(c))


def first_present(columns: list[str]) -> Column:
    """True when any of the columns is not null (false for an empty list)."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns], F.lit(False))


def prompt_score(c, factual_columns: list[str] = (), source_columns: list[str] = ()) -> Column:
    """How usable a prompt is as an example, 0 to 12."""
    t, size = _col(c), F.length(_col(c))
    named = F.size(entities(c))
    return (F.when(size.between(50, 300), 2).when(size > 300, 1).otherwise(0)
            + F.when(contains_any(t, fv.PROMPT_SCORE_WORDS), 2).otherwise(0)
            + F.least(named, F.lit(2))
            + F.when(is_question(t), 1).otherwise(0)
            + F.when(first_present(list(factual_columns)), 3).otherwise(0)
            + F.when(first_present(list(source_columns)), 2).otherwise(0))


def qa_score(question, answer, kind) -> Column:
    """How usable a question with its answer is as an example, 0 to 10."""
    q, a = _col(question), _col(answer)
    return (F.when(F.length(q).between(50, 150), 2).when(F.length(q) <= 200, 1).otherwise(0)
            + F.when(contains_any(q, fv.QA_SCORE_WORDS), 3).otherwise(0)
            + F.when(F.length(a) <= 50, 2).otherwise(0)
            + F.when(_col(kind).isin(fv.QA_VALID_TYPES), 2).otherwise(0)
            + F.when(contains_any(q, fv.QA_BONUS_WORDS), 1).otherwise(0))


def prompt_kind(c) -> Column:
    return (F.when(is_question(c), "Question")
            .when(contains_any(c, fv.KIND_INSTRUCTION_WORDS), "Instruction").otherwise("Affirmation"))


def factual_potential(c) -> Column:
    return F.when(contains_any(c, fv.FACTUAL_POTENTIAL_WORDS), "High").otherwise("Moderate")


def indicators_found(c, words: list[str] = fv.QA_INDICATOR_WORDS) -> Column:
    t = F.lower(_col(c))
    return F.array_compact(F.array(*[F.when(t.contains(w), F.lit(w)) for w in words]))


def verifiability(kind) -> Column:
    return F.when(_col(kind) == "name", "named entity").when(_col(kind) == "numeric", "numeric value")


def ellipsize(c, n: int) -> Column:
    t = _col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def is_numeric_text(c) -> Column:
    """Digits only, once commas and points are taken out."""
    return F.translate(_col(c), ",.", "").rlike(r"^\p{Nd}+$")


def denormalise(z, mean, std) -> Column:
    return _col(z) * std + mean
