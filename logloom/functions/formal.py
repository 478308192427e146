"""Fields of a raw log line: stamp, level, request id, and what remains, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of stamps in the order they are tried, of levels and ids, and what is removed from a line.
STAMPS = [
    r"\d{4} \d{2}:\d{2}:\d{2}.\d{6}",
    r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d{3}",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.\d{3}",
    r"\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},?",
]
LEVEL = r"(\bCRIT\b)|(\bDEBUG\b)|(\bINFO\b)|(\bWARNING\b)|(\bTRACE\b)|(\bWARN\b)|(\bERROR\b)|(\bFATAL\b)|(\berror\b)|(\bwarning\b)|(\binfo\b)"
MS_ID = r"[0-9 a-z A-Z]{8}-[0-9 a-z A-Z]{4}-[0-9 a-z A-Z]{4}-[0-9 a-z A-Z]{4}-[0-9 a-z A-Z]{12}"
POD_ID = MS_ID + r"-[0-9 a-z A-Z]{1}-[0-9 a-z A-Z]{5}"
PID = r"\d{1,}"
IP = r"\d{1,}\.\d{1,}\.\d{1,}\.\d{1,}"
REMOVED_BATCH = [
    r"\[.*?\]",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d{3} \d+",
    r"\sINFO|\sWARNING|\sWARN|\sCRIT|\sDEBUG|\sTRACE|\sFATAL|\sERROR|\serror|\swarning|\sinfo",
    r"(req-)?[0-9a-z]{8}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{12}",
]
REMOVED_STREAM = [
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d{3} \d+",
    r"\sINFO|\sWARNING|\sWARN|\sCRIT|\sDEBUG|\sTRACE|\sFATAL|\sERROR|\swarning|\sinfo",
    r"(req-)?[0-9a-z]{8}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{12}",
]


def found(line: Column, pattern: str) -> Column:
    """The leftmost match of a pattern, null if there is none."""
    return F.nullif(F.regexp_extract(line, f"(?d){pattern}", 0), F.lit(""))


def line_stamp(line: Column) -> Column:
    """The stamp by the first pattern that matches anywhere; earlier patterns win over earlier places."""
    return F.coalesce(*[found(line, p) for p in STAMPS])


def line_level(line: Column) -> Column:
    """The leftmost level word."""
    return found(line, LEVEL)


def line_ms_id(line: Column) -> Column:
    """The leftmost request id; its characters include blanks."""
    return found(line, MS_ID)


def line_pid(line: Column) -> Column:
    """The leftmost number, as process ids are written."""
    return found(line, PID)


def line_ip(line: Column) -> Column:
    """The leftmost four numbers with dots between."""
    return found(line, IP)


def line_pod_id(line: Column) -> Column:
    """The leftmost id of a pod: a request id and two more parts."""
    return found(line, POD_ID)


def line_message(line: Column, removed: list[str] | None = None) -> Column:
    """The line without what ``removed`` lists and without stamps."""
    for pattern in [*(REMOVED_BATCH if removed is None else removed), *STAMPS]:
        line = F.regexp_replace(line, f"(?d){pattern}", "")  # only \n ends a line
    return line


def valid_date(text: Column) -> Column:
    """Whether a text is exactly a date, or a date and time; seconds may be leap ones, 60 and 61."""
    plain = F.regexp_replace(text, r":6[01]$", ":00")
    with_time = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$") & F.try_to_timestamp(plain, F.lit("yyyy-M-d H:m:s")).isNotNull()
    only_date = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(text, F.lit("yyyy-M-d")).isNotNull()
    return F.coalesce(F.when(F.instr(text, ":") > 0, with_time).otherwise(only_date), F.lit(False))


def formal_fields(lines: Column, removed: list[str] | None = None) -> list[Column]:
    """``time, level, ms_id, message`` of a line."""
    return [line_stamp(lines).alias("time"), line_level(lines).alias("level"), line_ms_id(lines).alias("ms_id"), line_message(lines, removed).alias("message")]


def epoch_seconds(text: Column) -> Column:
    """Seconds since the epoch of ``yyyy-MM-dd HH:mm:ss`` with ``,`` or ``.`` and a fraction, in the session's zone; null if malformed."""
    parts = F.split(text, "[,.]", 2)
    whole = F.unix_timestamp(F.try_to_timestamp(parts[0], F.lit("yyyy-MM-dd HH:mm:ss")))
    frac = F.when(F.size(parts) > 1, F.concat(F.lit("0."), parts[1]).try_cast("double")).otherwise(0.0)
    return whole + F.round(frac, 3)
