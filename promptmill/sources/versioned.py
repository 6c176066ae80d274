"""Tables that grow by appends, with a manifest per version, and what is kept in them: vectors of texts, and the keys that a stream has
seen.

A table is a folder of parts, each written by Spark as files dealt by the hash of the key, and of manifests. An append first writes its part
and then a manifest that names all parts; readers take the newest whole manifest, so an append that fails, or whose driver is
lost, leaves the version before it. A manifest also names the tags of its appends: an append under a known tag does nothing, so a
repeated batch changes nothing. ``compact`` writes all parts as one. One writer at a time: a second one that meets a manifest of its own
number fails and leaves the table as it is."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

from ..functions import text as tx
from ..functions import vectors as vec
from ..session import materialize

#: Rows and bytes of values in a file of a part, and manifests that are kept.
FILE_ROWS, FILE_BYTES, KEPT = 1 << 20, 64 << 20, 5


def files_for(rows: DataFrame) -> int:
    """How many files hold the rows, so that no task has to bring together more than a file's rows or bytes. (What is not text or a list counts as
    eight bytes.)"""
    width = F.lit(0).cast("bigint")
    for f in rows.schema.fields:
        size = F.octet_length(f.name) if isinstance(f.dataType, StringType) else F.size(f.name) * 8 if isinstance(f.dataType, ArrayType) else F.lit(8)
        width = width + F.coalesce(size, F.lit(0))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return max(1, -(-n // FILE_ROWS), -(-size // FILE_BYTES))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def manifest(self) -> dict:
        """The newest whole manifest: version, parts, tags."""
        fs, where = self._fs(f"{self.path}/manifests")
        newest = {"version": 0, "parts": [], "tags": []}
        if not fs.exists(where):
            return newest
        for row in self.spark.read.option("wholetext", True).text(f"{self.path}/manifests").collect():
            try:
                read = json.loads(row["value"])
            except ValueError:  # cut off while it was written
                continue
            newest = max(newest, read, key=lambda m: m["version"])
        return newest

    def read(self) -> DataFrame:
        parts = self.manifest()["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def _commit(self, manifest: dict) -> None:
        fs, where = self._fs(f"{self.path}/manifests/{manifest['version']:012d}.json")
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs, old = self._fs(f"{self.path}/manifests/{manifest['version'] - KEPT:012d}.json")
        if fs.exists(old):
            fs.delete(old, False)

    def _write(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows = rows.select(*self.schema.names)
        rows.repartition(files_for(rows), self.key).write.parquet(f"{self.path}/parts/{part}")
        return part

    def append(self, rows: DataFrame, tag: str | None = None) -> bool:
        """Adds the rows as a version of its own; False if the tag was added before."""
        now = self.manifest()
        if tag is not None and tag in now["tags"]:
            return False
        part = self._write(rows)
        self._commit({"version": now["version"] + 1, "parts": [*now["parts"], part], "tags": now["tags"] + ([tag] if tag else [])})
        return True

    def compact(self) -> None:
        """One part in place of all, and the others' files away (readers of older versions must have ended)."""
        now = self.manifest()
        if len(now["parts"]) < 2:
            return
        part = self._write(self.read())
        self._commit({**now, "version": now["version"] + 1, "parts": [part]})
        for old in now["parts"]:
            fs, where = self._fs(f"{self.path}/parts/{old}")
            fs.delete(where, True)


class VectorStore:
    """Vectors of texts by their digests. ``make``: a loader, run once per Python worker, of a function from a batch of texts to rows of
    ``dim`` numbers; without one, the hash embedding."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 384, make: Callable[[], Callable] | None = None, batch: int = 64):
        self.table = VersionedTable(spark, path, "sig string, embedding array<float>", "sig")
        self.dim, self.make, self.batch = dim, make, batch

    def _embedded(self, texts: DataFrame) -> DataFrame:
        if self.make is None:
            return texts.withColumn("embedding", vec.hash_embedding("_text", self.dim))
        from pyspark.ml.functions import predict_batch_udf
        make = self.make

        def loaded():
            predict = make()
            return lambda texts: predict(list(texts.reshape(-1)))
        encode = predict_batch_udf(loaded, return_type=ArrayType(FloatType()), batch_size=self.batch)
        return texts.withColumn("embedding", encode(F.coalesce("_text", F.lit(""))))

    def embed(self, df: DataFrame, text: str, out: str = "embedding") -> tuple[DataFrame, int]:
        """(``df`` with a vector per text, number of texts that were new and are now kept). A null text has no vector."""
        keyed = df.withColumn("_sig", F.sha2(text, 256))
        wanted = keyed.where(F.col("_sig").isNotNull()).groupBy(F.col("_sig").alias("sig")).agg(F.any_value(text).alias("_text"))
        missing = materialize(wanted.join(self.table.read().select("sig"), "sig", "left_anti"))
        new = missing.count()
        if new:
            self.table.append(self._embedded(missing).select("sig", "embedding"))
        vectors = self.table.read().select(F.col("sig").alias("_sig"), F.col("embedding").alias(out))
        return keyed.drop(out).join(vectors, "_sig", "left").drop("_sig"), new


class StreamDedup:
    """First rows of each normalised text over an unbounded input: rows arrive in batches; of the rows of a batch with one text the smallest
    key stays, if no earlier batch held the text (rows without text are one text). Kept rows and seen digests are versioned tables whose appends carry the batch's number,
    so a batch that is repeated after a failure, between the two appends or after both, changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, text: str):
        self.spark, self.key, self.text, self.path = spark, key, text, path.rstrip("/")
        self.kept = VersionedTable(spark, f"{self.path}/kept", schema, key)
        self.seen = VersionedTable(spark, f"{self.path}/seen", "digest string, batch bigint", "digest")

    def add(self, rows: DataFrame, batch: int) -> None:
        digest = F.coalesce(tx.text_signature(F.col(self.text)), F.lit(""))
        first = rows.withColumn("_digest", digest).groupBy("_digest").agg(F.min(F.struct(self.key, F.struct("*"))).alias("_row"))
        earlier = self.seen.read().where(F.col("batch") < batch).select(F.col("digest").alias("_digest"))
        new = materialize(first.join(earlier, "_digest", "left_anti"))
        names = [f.name for f in self.kept.schema.fields]
        self.kept.append(new.select(*[F.col(f"_row.col2.{n}").alias(n) for n in names]), f"batch-{batch}")
        self.seen.append(new.select(F.col("_digest").alias("digest"), F.lit(batch).cast("bigint").alias("batch")), f"batch-{batch}")

    def run(self, source: DataFrame) -> None:
        """Everything that the streaming ``source`` has now; a later call goes on after it."""
        query = (source.writeStream.foreachBatch(lambda rows, batch: self.add(rows, batch))
                 .option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start())
        query.awaitTermination()
