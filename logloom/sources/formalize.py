"""Raw log folders to formalized CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.formal import formal_fields
from logloom.operators.assembly import assembled, starts_with_two
from logloom.operators.ordering import positions
from logloom.sources.readers import read_lines
from logloom.sources.sinks import write_formalized


def formalized(spark: SparkSession, folder: str, removed: list[str] | None = None) -> DataFrame:
    """``log_id, time, level, ms_id, message`` of all records below a folder, numbered from 0 by file and record."""
    lines = read_lines(spark, folder)
    records = assembled(lines, "file", "line_no", "line", starts_with_two(F.col("line")))
    return positions(records, "file", "record", name="log_id").select("log_id", *formal_fields(F.col("text"), removed))


def formalize(spark: SparkSession, folders: dict[str, str]) -> None:
    """Write the formalized log of each folder to its target; every folder is read by itself."""
    for source, target in folders.items():
        write_formalized(formalized(spark, source), target)
