"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC; extra settings by keyword
    (write dots as double underscores)."""
    builder = (
        SparkSession.builder.appName("promptmill")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Bytes of a batch of rows on its way to a Python worker: Spark's own bound of 64 MB is held several times by each task, on both sides.
BATCH_BYTES, _BATCH_BYTES, _SPARKS_BOUND = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that functions sent to them can be read there
    without an installation. The archive is made in the driver's own temporary folder, from where Spark serves it. Batches that
    go to the workers are bounded by ``BATCH_BYTES`` unless the session sets a bound of its own."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES) == _SPARKS_BOUND:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    if getattr(context, "_promptmill_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="promptmill-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "promptmill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(path, name)
                    z.write(full, os.path.join("promptmill", os.path.relpath(full, package)))
    context.addPyFile(archive)
    context._promptmill_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster names it. Only a local
    master without that setting gets a folder of its own, removed when the process ends."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="promptmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_TABLES: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A session setting while something runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared scratch folder (with these options of the writer) and read it back.

    This cuts the lineage in a way that survives lost executors, evaluates a costly or
    non-deterministic plan once, and gives the optimizer the true size of the table: a small result
    is then broadcast by Spark's own threshold and a large one is not. What the plan shuffled goes as soon as the table is written; the
    table itself goes with ``discard``, with ``release``, or when the driver's process ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/promptmill/{uuid.uuid4().hex}"
    with _setting(spark, _CLEANUP, "true"):
        df.write.options(**options).parquet(path)
    if not _TABLES:
        atexit.register(release)
    _TABLES[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._promptmill_path = path
    return table


def _delete(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder is the cluster's to clear
        pass


def discard(table: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    path = getattr(table, "_promptmill_path", None)
    if path in _TABLES:
        _delete(path, _TABLES.pop(path))


def release() -> None:
    """Delete all tables that ``materialize`` has written and that are still there. Call it between runs of a long session, once
    their results are written; at the end of the process it is called anyway."""
    while _TABLES:
        _delete(*_TABLES.popitem())


@contextmanager
def partitions(spark: SparkSession, least: int):
    """Shuffles of what runs inside have this many partitions at least (adaptive execution still joins small ones)."""
    name = "spark.sql.shuffle.partitions"
    with _setting(spark, name, str(max(least, int(spark.conf.get(name))))):
        yield


def lookup(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``big`` with a (usually small) aggregate. The aggregate is written first, so Spark knows
    its size when it plans the join: under ``autoBroadcastJoinThreshold`` the big side is not
    shuffled, above it the join is a sort-merge join whose hot keys adaptive execution splits."""
    return big.join(materialize(small), on, how)
