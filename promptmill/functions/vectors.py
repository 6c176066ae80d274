"""Vector expressions over ``ARRAY`` columns, and the hash embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product in double precision; the cosine when both sides have unit length."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v) -> Column:
    return let(F.struct(_col(v).alias("v"), norm(v).alias("n")), lambda s: F.transform(
        s.getField("v"), lambda x: F.when(s.getField("n") > 0, x / s.getField("n")).otherwise(x.cast("double"))))


def hash_bytes(c) -> Column:
    """The 32 bytes of the SHA-256 digest of a text as doubles."""
    return let(F.sha2(_col(c), 256), lambda digest: F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double")))


def hash_unit(c) -> Column:
    """Unit vector over the 32 digest bytes. Tiling the bytes to a longer vector before scaling leaves
    every cosine the same, so similarities are computed on this short form."""
    return let(hash_bytes(c), unit)


def hash_embedding(c, dim: int = 384) -> Column:
    """Deterministic stand-in for a text model: digest bytes tiled to ``dim`` and scaled to length 1."""
    tiled = F.slice(F.flatten(F.array_repeat(hash_bytes(c), dim // 32 + 1)), 1, dim)
    return let(tiled, unit).cast("array<float>")
