"""Writers for datasets, metric tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

OUTPUT_COLUMNS = ["prompt", "dataset", "intent_disc", "intent_cont"]


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8; nulls are written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_augmented(df: DataFrame, path: str) -> None:
    """New rows only, in their four columns."""
    write_jsonl(df.select(*OUTPUT_COLUMNS), path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table (a row per dataset) as one CSV file and one JSON file."""
    one = df.coalesce(1)
    write_csv(one, f"{path}/csv")
    write_jsonl(one, f"{path}/json")


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (ten per run) as one text file, in order."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)
