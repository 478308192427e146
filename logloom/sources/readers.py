"""Reading logs: raw lines of plain and gzip files, business and formalized CSV, tab and sequence files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUSINESS = "time string, deploy_id long, service string, component string, event_id long, level string, ip string, log_txt string"
FORMALIZED = "log_id long, time string, level string, ms_id string, message string"
SERIES = "event_id long, instance_name string, time double"
PARSED = "event long, log_id long, time_stamp double"


def list_files(folder: str, spark: SparkSession | None = None) -> list[str]:
    """All files below a folder in order of path, but for hidden ones: names that start with ``.`` or ``_``, which Spark reads nowhere.

    With a session the folder may be on any file system that it reads.
    """
    if spark is None:
        return sorted(os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f[:1] not in "._")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName()[:1] not in "._":
            out.append(path.toString())
    return sorted(out)


def read_lines(spark: SparkSession, folder: str, drop_blank: bool = False) -> DataFrame:
    """``file, line_no, line`` of all files below a folder, lines counted from 0; gzip files by their suffix.

    Large files are read by as many tasks as they have blocks. Lines are numbered inside their block, from the
    number of lines in the blocks before, which are counted first; so no task holds or orders a whole file.
    """
    paths = list_files(folder, spark)
    if not paths:
        return spark.createDataFrame([], "file string, line_no int, line string")
    files = spark.read.text(paths)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    counts = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = counts.select("file", "_block", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = rows.withColumn("_k", F.row_number().over(W.partitionBy("file", "_block").orderBy("_i")) - 1)
    out = local.join(before, ["file", "_block"]).select("file", (F.col("_before") + F.col("_k")).cast("int").alias("line_no"), "line")
    return out.where(F.trim("line") != "") if drop_blank else out


def read_line_splits(spark: SparkSession, folder: str) -> DataFrame:
    """``file, line`` of all files below a folder, split by size, without the lines' order."""
    return spark.read.text(list_files(folder, spark)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_csv(spark: SparkSession, path: str, schema: str, rows: int | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with header by a declared schema; at most ``rows`` rows if given.

    With ``multi_line`` quoted fields may span lines, and a file is read by one task; without, files are split.
    """
    df = spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, escape='"')
    return df if rows is None else df.limit(rows)


def read_tabbed(spark: SparkSession, path: str) -> DataFrame:
    """``log_id, message`` of lines with a number, a tab and a message; other lines are left out."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].try_cast("long").alias("log_id"), parts[1].alias("message")).where("log_id is not null")


def read_deploy_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``deploy_id, events`` of lines such as ``[id, e1, e2]``; brackets are optional."""
    parts = F.split(F.regexp_replace("value", r"[\[\]'\"\s]", ""), ",", -1)
    events = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("deploy_id"), events.alias("events"))


def read_sequences(spark: SparkSession, train: str, test: str, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """``seq, pos, item`` of two CSV files of one sequence a row, header left out; ``merge`` adds test to train.

    Rows may be of different length; empty cells end nothing but are no items. ``seq`` counts the rows of a file.
    """

    def read(path: str) -> DataFrame:
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n", -1)).alias("row", "line")).where("row > 0 and trim(line) <> ''")
        items = F.filter(F.split("line", ",", -1), lambda x: F.trim(x) != "")
        return rows.select((F.col("row") - 1).cast("long").alias("seq"), F.posexplode(items).alias("pos", "item"))

    a, b = read(train), read(test)
    if not merge:
        return a, b
    after = a.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("_n"))
    return a.unionByName(b.join(F.broadcast(after)).select((F.col("seq") + F.col("_n")).alias("seq"), "pos", "item")), b
