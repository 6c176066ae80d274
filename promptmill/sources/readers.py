"""Readers for prompt files and arbitrary datasets."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import flatten
from ..session import materialize

PROMPT_SCHEMA = "prompt string, dataset string, intent_disc int, intent_cont double"
EXTENSIONS = [".csv", ".json", ".jsonl", ".parquet"]


def read_prompts(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the read, and so does a file none of whose lines has the key
    ``intent_disc`` (the file's own keys count, not a schema that is handed in). A schema saves the pass that infers one; the
    look for the key ends at the first line that has it."""
    keys = F.json_object_keys("value")
    if not spark.read.text(path).where(F.array_contains(keys, "intent_disc")).limit(1).count():
        raise ValueError("missing 'intent_disc' in dataset")
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line``: zero-based line numbers per file. Each file split counts its lines; the
    offsets of the splits are a running sum over a table with one row per split."""
    lines = materialize(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line")))
    blocks = lines.groupBy("path", "_block").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    return lines.join(offsets, ["path", "_block"]).select(
        "path", (F.col("_from") + F.col("_m") - F.col("_first")).alias("line_no"), "line")


def _coerced(value: Column, kind: T.DataType) -> Column:
    """A JSON value given as text, as the column's type; null where it cannot be one. Numbers may stand in quotes, and a whole
    number may be written with a fraction."""
    if isinstance(kind, T.IntegralType):
        number = value.try_cast("double")
        return F.when(number == F.floor(number), number).try_cast(kind)
    return value.try_cast(kind)


def read_prompts_tolerant(spark: SparkSession, path: str, source: str, schema: str = PROMPT_SCHEMA,
                          with_lines: bool = False, extra: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows labelled with ``source``, and the malformed lines. ``with_lines`` adds ``line_no``.

    A line is malformed only if it is no JSON object. Values of other types than the schema's are coerced, or null where they
    cannot be; with ``extra``, every other key of the file becomes a column of text, in the order of their names."""
    fields = T.StructType.fromDDL(schema).fields
    lines = numbered_lines(spark, path) if with_lines else spark.read.text(path).select(F.col("value").alias("line"))
    keep = ["line_no"] if with_lines else []
    # A line with blanks alone is skipped. Written once, as both results and the keys are read from it.
    parsed = materialize(lines.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").select(
        "line", F.when(F.json_object_keys("line").isNotNull() & F.try_parse_json("line").isNotNull(), F.json_object_keys("line"))
        .alias("keys"), *keep))
    good = parsed.where(F.col("keys").isNotNull())
    names = [f.name for f in fields]
    others = []
    if extra:
        # One row per different key.
        found = good.select(F.explode("keys").alias("k")).distinct().where(~F.col("k").isin(*names)).collect()
        others = sorted(r["k"] for r in found)
    data = F.try_parse_json("line")

    def text_of(name: str) -> Column:
        quoted = name.replace("'", "\\'")
        return F.try_variant_get(data, f"$['{quoted}']", "string")
    rows = good.select(*[_coerced(text_of(f.name), f.dataType).alias(f.name) for f in fields],
                       *[text_of(n).alias(n) for n in others], *keep, F.lit(source).alias("source" if "source" not in others else "_source"))
    if "source" in others:
        rows = rows.drop("source").withColumnRenamed("_source", "source")
    return rows, parsed.where(F.col("keys").isNull()).select("line", *keep)


def discover(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Path and extension of the dataset in a folder: the first extension that occurs at any depth, names
    with ``combined`` first, then by path. Of a table written in parts the whole folder is taken."""
    for ext in EXTENSIONS:
        found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", f"*{ext}").load(folder).select("path"))
        name = F.lower(F.element_at(F.split("path", "/"), -1))
        best = found.orderBy(F.desc(name.contains("combined")), "path").limit(1).collect()
        if best:
            parent, _, file = best[0]["path"].rpartition("/")
            return (parent if file.startswith("part-") else best[0]["path"]), ext
    raise ValueError(f"no dataset file under {folder}")


def read_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = False,
             infer: bool = False) -> DataFrame:
    """CSV, JSON, JSON lines or Parquet by extension. A path without one of these extensions is searched
    as a folder. ``multi_line`` allows line ends inside CSV fields, but then a file is one task; ``infer`` finds the types of
    CSV columns (else they are text), but reads everything twice. A ``.json`` file is one document by its format."""
    ext = PurePosixPath(path).suffix.lower()
    if ext not in EXTENSIONS:
        path, ext = discover(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    if ext == ".csv":
        return (reader.option("header", "true").option("inferSchema", str(infer and schema is None).lower())
                .option("multiLine", str(multi_line).lower()).option("escape", '"').csv(path))
    if ext == ".json":
        return flatten(reader.option("multiLine", "true").json(path))
    if ext == ".jsonl":
        return reader.option("mode", "FAILFAST").json(path)
    return reader.parquet(path)
