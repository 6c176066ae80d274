"""Near-duplicates by MinHash bands.

Rows that share a band key collide. Pairs are never formed: within a band key every row collides with
every other one, so at most one of them can be accepted, and all that is needed about a key is its
earliest undecided row and whether an accepted row is in it. Both are aggregates with map-side
combination. A key shared by a third of the table therefore costs as much as the same number of rows
spread over many keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import minhash as mh
from ..functions import text as tx
from ..session import discard, lookup, materialize

WORDS, CHARS = "words", "chars"


def signature_column(text: str, kind: str, num_perm: int) -> Column:
    if kind == WORDS:
        return mh.word_minhash(text, num_perm)
    return mh.char_minhash(tx.norm_simple(text), num_perm)


def with_signature(df: DataFrame, text: str, kind: str = WORDS, num_perm: int = 128) -> DataFrame:
    return df.withColumn("signature", signature_column(text, kind, num_perm))


def _copy_key(text: str, kind: str) -> Column:
    """Digest under which two texts have equal shingles for certain."""
    return F.md5(tx.norm_text(text) if kind == WORDS else tx.norm_simple(text))


def banded(df: DataFrame, key: str, text: str, kind: str, threshold: float, num_perm: int) -> DataFrame:
    """``id, copy, keys``: row id, digest of the normalised text, band keys. Everything after this works
    on these narrow rows; the texts stay where they are."""
    bands, rows = mh.band_plan(threshold, num_perm)
    signed = df.select(
        F.col(key).alias("id"), _copy_key(text, kind).alias("copy"), signature_column(text, kind, num_perm).alias("sig"))
    return signed.select("id", "copy", mh.band_keys("sig", bands, rows).alias("keys"))


def representatives(rows: DataFrame) -> DataFrame:
    """The earliest row of every normalised text. Copies have the same keys, so any of them will do."""
    return rows.groupBy("copy").agg(F.min("id").alias("id"), F.any_value("keys").alias("keys"))


def _memberships(rows: DataFrame) -> DataFrame:
    """``id, key`` of the keys that at least two rows have."""
    spread = materialize(rows.select("id", F.explode("keys").alias("key")))
    shared = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return materialize(spread.join(shared, "key", "left_semi"))


#: Memberships of a component that one task walks through.
WALK_ROWS = 100_000


def _components(members: DataFrame) -> DataFrame:
    """``id, label``: the least id that a row reaches over shared keys. Labels travel over a key and then along their own labels,
    so the number of rounds grows with the logarithm of the longest chain."""
    labels = materialize(members.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        near = members.join(labels, "id").groupBy("key").agg(F.min("label").alias("label"))
        reached = members.join(near, "key").groupBy("id").agg(F.min("label").alias("m"))
        step = materialize(labels.join(reached, "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("old")))
        above = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = materialize(step.join(above, "label").select("id", F.col("up").alias("label"), "old"))
        done = jumped.where("label <> old").isEmpty()
        discard(step)
        discard(labels)
        labels = jumped.select("id", "label")
        if done:
            return labels


def _walk(table: pd.DataFrame) -> pd.DataFrame:
    """The ordered walk through one component."""
    taken, accepted = set(), []
    for i, keys in table.sort_values("id").groupby("id", sort=True)["key"]:
        if taken.isdisjoint(keys):
            taken.update(keys)
            accepted.append(i)
    return pd.DataFrame({"id": pd.Series(accepted, dtype="int64")})


def first_accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walk the rows in id order and accept each one that collides with no accepted row.

    Rows that share no key with each other, directly or through others, do not matter to one another: each component of at most
    ``WALK_ROWS`` memberships is walked through by one task. The few larger ones are decided as a fixed point, by rounds:

    - an undecided row that is the earliest undecided one under all of its keys is accepted;
    - every other row under a key of an accepted row is rejected.

    Returns the accepted ids among the rows that share a key, and all memberships of shared keys. Rows
    that share no key are accepted and appear in neither."""
    members = _memberships(rows)
    labelled = materialize(members.join(_components(members), "id"))
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    small = labelled.join(sizes.where(F.col("n") <= WALK_ROWS).select("label"), "label", "left_semi")
    accepted = [materialize(small.groupBy("label").applyInPandas(_walk, "id bigint"))]
    undecided = materialize(labelled.join(sizes.where(F.col("n") > WALK_ROWS).select("label"), "label", "left_semi").select("id", "key"))
    while not undecided.isEmpty():
        earliest = materialize(undecided.groupBy("key").agg(F.min("id").alias("first_id")))
        winners = materialize(
            undecided.join(earliest, "key").groupBy("id")
            .agg(F.bool_and(F.col("id") == F.col("first_id")).alias("wins")).where("wins").select("id"))
        accepted.append(winners)
        closed = earliest.join(winners.withColumnRenamed("id", "first_id"), "first_id", "left_semi").select("key")
        decided = undecided.join(closed, "key", "left_semi").select("id").distinct()
        left = materialize(lookup(undecided, decided, "id", "left_anti"))
        discard(undecided)
        discard(earliest)
        undecided = left
    empty = members.select("id").limit(0)
    return reduce(DataFrame.unionByName, accepted, empty), members


def dropped_near(df: DataFrame, key: str, text: str, threshold: float = 0.9, num_perm: int = 128) -> DataFrame:
    """Ids of the rows that repeat an accepted earlier row, exactly (after normalisation) or nearly."""
    rows = materialize(banded(df, key, text, WORDS, threshold, num_perm))
    kept_copies = materialize(representatives(rows))
    accepted, members = first_accepted(kept_copies)
    rejected = members.select("id").distinct().join(accepted, "id", "left_anti")
    copies = rows.select("id").join(kept_copies.select("id"), "id", "left_anti")
    return copies.unionByName(rejected)


def dedup_near(df: DataFrame, key: str, text: str, threshold: float = 0.9, num_perm: int = 128) -> DataFrame:
    """Rows in key order without near-duplicates of an accepted earlier row. One shared band is a match."""
    dropped = dropped_near(df, key, text, threshold, num_perm)
    return lookup(df, dropped.withColumnRenamed("id", key), key, "left_anti")


def near_duplicate_clusters(df: DataFrame, key: str, text: str, threshold: float = 0.8,
                            num_perm: int = 64) -> DataFrame:
    """``cluster, member``: rows are visited in key order; one not yet in a cluster opens a new one with
    every row it collides with, visited or not. Clusters of one row are left out; a row may be in
    several clusters. The centres are exactly the accepted rows of the walk above."""
    rows = materialize(banded(df, key, text, CHARS, threshold, num_perm))
    reps = materialize(representatives(rows))
    accepted, members = first_accepted(reps)
    accepted = materialize(accepted)
    centre_keys = members.join(accepted, "id", "left_semi").select("key", F.col("id").alias("cluster"))
    around = members.join(centre_keys, "key").select("cluster", "id").distinct()
    alone = reps.select("id").join(members.select("id").distinct(), "id", "left_anti")
    stars = around.unionByName(alone.select(F.col("id").alias("cluster"), "id"))
    # From representatives to all their copies.
    with_copy = stars.join(reps.select("id", "copy"), "id").select("cluster", "copy")
    full = materialize(rows.select(F.col("id").alias("member"), "copy").join(with_copy, "copy").select("cluster", "member"))
    sizes = full.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
    return full.join(sizes.select("cluster"), "cluster", "left_semi")


def first_match(left: DataFrame, right: DataFrame, key: str, text: str, kind: str = WORDS, threshold: float = 0.9,
                num_perm: int = 128) -> DataFrame:
    """For every left row that collides with a right row: the earliest such row and the number of bands
    that have one. A band key of the right side is reduced to its earliest row before the join."""
    known = (banded(right, key, text, kind, threshold, num_perm).select("id", F.explode("keys").alias("key"))
             .groupBy("key").agg(F.min("id").alias("match")))
    asked = banded(left, key, text, kind, threshold, num_perm).select("id", F.explode("keys").alias("key"))
    return asked.join(known, "key").groupBy("id").agg(F.min("match").alias("first_match"), F.count("*").alias("n_bands"))
