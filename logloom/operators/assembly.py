"""Records from lines: continuation lines join the record before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.formal import valid_date


def starts_with_two(line: Column) -> Column:
    """A record starts with the digit 2, as years do."""
    return F.substring(line, 1, 1) == "2"


def starts_with_date(line: Column, ended: Column | bool = True) -> Column:
    """A record starts with a valid date and time in a line of 20 characters at least, its line end counted.

    ``ended``: whether the line has a line end, as all but the last of a file have.
    """
    end = F.lit(1) if ended is True else F.lit(0) if ended is False else ended.cast("int")
    return (F.length(line) + end >= 20) & valid_date(F.substring(line, 1, 19))


def assembled(lines: DataFrame, source: str, order: str, line: str, is_start: Column, flush_last: bool = True, between: str = " ", first_opens: bool = False) -> DataFrame:
    """``source, record, text``: lines joined to records by ``between``, numbered from 1 per source.

    ``is_start`` says of a line whether it starts a record. Lines before the first start belong to no
    record, unless ``first_opens``: then a source's first line always starts one. Without ``flush_last`` each
    source's last record is left out, as a reader does that emits a record only when it sees the next. The
    order column must be unique per source. Null lines are empty ones. Sources are independent; a source's lines
    are ordered by one task, spilling as needed.
    """
    own = W.partitionBy(source).orderBy(order)
    starts = F.coalesce(is_start, F.lit(False))
    if first_opens:
        starts = starts | (F.row_number().over(own) == 1)
    marked = lines.withColumn("_starts", starts).withColumn("record", F.sum(F.col("_starts").cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0))).where("record > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(line, F.lit("")).alias("t")))), lambda x: x["t"])
    out = marked.groupBy(source, "record").agg(F.array_join(parts, between).alias("text"))
    if not flush_last:
        out = out.withColumn("_last", F.max("record").over(W.partitionBy(source))).where("record < _last").drop("_last")
    return out


def stream_records(lines: DataFrame, source: str, order: str, line: str, ended: Column | bool = True, compat: bool = True) -> DataFrame:
    """``source, record, text``: records of lines as a stream of them is read.

    A source's first line opens a record, and so does every line that starts with a date; continuation lines
    follow with nothing between. Then what stands between the first ``{`` and the last ``}``, and between the
    first ``(`` and the last ``)``, is left out. Quirk (``compat``): a record is given out only when the next one
    starts, so the last one of every source is not.
    """
    out = assembled(lines, source, order, line, starts_with_date(F.col(line), ended), flush_last=not compat, between="", first_opens=True)
    return out.withColumn("text", without_braces(F.col("text")))


def without_braces(text: Column) -> Column:
    """A record's text without its braced and its bracketed part, each from the first mark to the last."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\{.*\}", ""), r"(?s)\(.*\)", "")
