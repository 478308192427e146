"""Reading time stamps of many notations and zones: Arrow kernels over whole batches behind two UDFs, and column helpers."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Zone abbreviations and names of UTC with their hours; months; what spellings of levels mean.
ZONE_HOURS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LEVELS = {
    "TRACE": ["TRACE", "TRC"],
    "DEBUG": ["DEBUG", "DBG", "D"],
    "INFO": ["INFO", "INF", "I", "INFORMATION", "NOTICE"],
    "WARN": ["WARN", "WARNING", "WRN", "W"],
    "ERROR": ["ERROR", "ERR", "E"],
    "FATAL": ["FATAL", "CRIT", "CRITICAL", "F", "C", "FTL", "EMERG"],
}

DAY_US = 86_400_000_000
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d+))?"
_ZONE = r"(?:\s*(?P<z>[A-Za-z]{1,5}))?\s*(?P<o>[+-]\d{2}:?\d{2})?\s*"
_NAME = r"(?P<m>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
#: The notations of a calendar stamp; a stamp without year matches none.
NOTATIONS = [
    rf"(?i)^{p}$"
    for p in (
        r"\s*(?P<y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})[T ]\s*" + _CLOCK + _ZONE,
        r"\s*(?P<d>\d{2})\.(?P<m>\d{2})\.(?P<y>\d{4})[T ]\s*" + _CLOCK + _ZONE,
        r"\s*(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d+))?" + _ZONE,
        r"\s*" + _NAME + r"\s+(?P<d>\d{1,2}),\s*(?P<y>\d{4})\s+" + _CLOCK + r"\s*(?P<p>[AP]M)" + _ZONE,
        r"\s*(?:[A-Z]{3},\s*)?(?P<d>\d{1,2})[\s-]" + _NAME + r"[\s-](?P<y>\d{4})\s+" + _CLOCK + _ZONE,
    )
]
#: Counts from the epoch by number of digits: 9-10 s, 12-13 ms, 15-16 us, 18-19 ns.
COUNT = r"^\s*(?P<n>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:[.,](?P<f>\d+))?\s*$"
_EPOCH = datetime(1970, 1, 1)
_NONE = np.iinfo(np.int64).min

#: The stamp in the header of the entry that starts a field.
HEADER_STAMP = (
    r"^\s*(?:\{(?:.*?,)?\s*\"(?:@timestamp|timestamp|time|ts)\"\s*:\s*\"|\[|(?:\w+=\w+ )?ts=|\w+\|)?"
    r"(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|\s?[+-]\d{2}:?\d{2})?)(?=[\s\]|\",]|$)"
)


def header_stamp(log_txt: Column) -> Column:
    """The text of the stamp in the header that starts ``log_txt``; '' where there is none."""
    return F.regexp_extract(log_txt, HEADER_STAMP, 1)


def _ints(text: pa.Array) -> np.ndarray:
    return pc.cast(text, pa.int64()).to_numpy(zero_copy_only=False)


def _micros(digits: pa.Array) -> np.ndarray:
    """Microseconds of the digits after the decimal mark: missing ones are 0, further ones are dropped."""
    return _ints(pc.utf8_rpad(pc.utf8_slice_codeunits(digits, 0, 6), 6, "0"))


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of dates that exist."""
    return ((y - 1970) * 12 + m - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def stamps(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(local, off)`` of every text, in microseconds; the least integer stands for none.

    ``local`` counts microseconds of the stamp's own clock since 1970-01-01; ``off`` is that clock's distance
    from UTC, none if the stamp names no zone. Missing digits are 0, digits beyond microseconds are dropped. An
    unknown zone name or a date that doesn't exist makes it no stamp.
    """
    local, off = np.full(len(text), _NONE), np.full(len(text), _NONE)
    rest = np.flatnonzero(pc.is_valid(text).to_numpy(zero_copy_only=False))
    for k, notation in enumerate([NOTATIONS[0], COUNT, *NOTATIONS[1:]]):
        if not len(rest):
            break
        found = pc.extract_regex(text.take(pa.array(rest)), notation)
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        at, rest = rest[hit], rest[~hit]
        if len(at):
            parts = found.filter(pa.array(hit))
            local[at], off[at] = _counted(parts) if k == 1 else _calendar(parts)
    return local, off


def _counted(parts: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    whole = parts.field("n")
    digits = pc.binary_join_element_wise(whole, parts.field("f"), "")
    long = pc.utf8_length(whole).to_numpy(zero_copy_only=False) % 3 == 1  # 9 or 10 digits are whole seconds
    lead = np.where(long, _ints(pc.utf8_slice_codeunits(digits, 0, 10)), _ints(pc.utf8_slice_codeunits(digits, 0, 9)))
    tail = np.where(long, _micros(pc.utf8_slice_codeunits(digits, 10)), _micros(pc.utf8_slice_codeunits(digits, 9)))
    return lead * 1_000_000 + tail, np.zeros(len(parts), np.int64)


def _calendar(parts: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    names = [f.name for f in parts.type]
    get = lambda x: parts.field(names.index(x))
    y, d, h, mi, s = (_ints(get(x)) for x in ("y", "d", "h", "mi", "s"))
    if pc.all(pc.utf8_is_digit(get("m"))).as_py():
        m = _ints(get("m"))
    else:
        m = pc.index_in(pc.utf8_lower(pc.utf8_slice_codeunits(get("m"), 0, 3)), pa.array(MONTHS)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ok = np.ones(len(y), bool)
    if "p" in names:
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + 12 * pc.equal(pc.utf8_upper(get("p")), "PM").to_numpy(zero_copy_only=False)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = np.where(np.isin(m, (4, 6, 9, 11)), 30, np.where(m == 2, 28 + leap, 31))
    ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= most) & (h <= 23) & (mi <= 59) & (s <= 59)
    zone = pc.fill_null(pc.index_in(pc.utf8_upper(get("z")), pa.array(["", *ZONE_HOURS])), -1).to_numpy(zero_copy_only=False)
    ok &= zone >= 0
    off = np.array([_NONE, *(x * 3_600_000_000 for x in ZONE_HOURS.values())])[np.maximum(zone, 0)]
    written = pc.greater(pc.utf8_length(get("o")), 0).to_numpy(zero_copy_only=False)
    if written.any():
        o = pc.if_else(pa.array(written), get("o"), "+0000")
        digits = _ints(pc.replace_substring(pc.utf8_slice_codeunits(o, 1), ":", ""))
        minutes = (digits // 100 * 60 + digits % 100) * np.where(pc.starts_with(o, "-").to_numpy(zero_copy_only=False), -1, 1)
        off = np.where(written, minutes * 60_000_000, off)
    local = np.full(len(y), _NONE)
    local[ok] = ((_days(y[ok], m[ok], d[ok]) * 86_400 + h[ok] * 3600 + mi[ok] * 60 + s[ok]) * 1_000_000) + _micros(get("f").filter(pa.array(ok)))
    return local, np.where(ok, off, _NONE)


@lru_cache(1024)
def _zone(tz: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(tz)
    except (OSError, ValueError, KeyError):  # no such zone
        return None


def zone_exists(tz: str | None) -> bool:
    """Whether there is a zone of that name."""
    return bool(tz) and _zone(tz) is not None


def wall_to_utc(local_us: int, tz: str | None) -> int | None:
    """The one instant at which a clock of zone ``tz`` showed ``local_us``.

    None for times that the clock showed twice (it was set back), for times it never showed, and for
    zones that don't exist.
    """
    if not tz or (zone := _zone(tz)) is None:
        return None
    try:
        wall = _EPOCH + timedelta(seconds=local_us // 1_000_000)
    except (ValueError, OverflowError):
        return None
    first, second = zone.utcoffset(wall), zone.utcoffset(wall.replace(fold=1))
    if first != second:
        return None
    return local_us - (first.days * 86_400 + first.seconds) * 1_000_000


@lru_cache(1_000_000)
def day_offset(day: int, tz: str) -> int | None:
    """Microseconds that a clock of zone ``tz`` is ahead of UTC on a day of its own; None where that changes or isn't known."""
    first, last = day * DAY_US, (day + 1) * DAY_US - 1
    starts, ends = wall_to_utc(first, tz), wall_to_utc(last, tz)
    return None if starts is None or ends is None or first - starts != last - ends else first - starts


def walls(local: np.ndarray, tz: pa.Array) -> np.ndarray:
    """``wall_to_utc`` of whole arrays: one look at the zone's history per zone and day, rows of days with a change one by one."""
    out = np.full(len(local), _NONE)
    coded = tz.dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero((local != _NONE) & (code >= 0))
    if not len(at):
        return out
    names = coded.dictionary.to_pylist()
    day = local[at] // DAY_US
    pairs, back = np.unique(np.stack([code[at], day]), axis=1, return_inverse=True)
    offsets = [day_offset(int(d), names[c]) for c, d in pairs.T]
    known = np.array([_NONE if o is None else o for o in offsets])[back.ravel()]
    out[at] = np.where(known != _NONE, local[at] - known, _NONE)
    for i in at[known == _NONE]:
        exact = wall_to_utc(int(local[i]), names[code[i]])
        if exact is not None:
            out[i] = exact
    return out


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _NONE)


def _text(array: pa.Array) -> pa.Array:
    return array.cast(pa.string()) if not pa.types.is_string(array.type) else array


def _read(text: pa.Array, tz: pa.Array) -> pa.Array:
    local, off = stamps(_text(text))
    named = off != _NONE
    at = walls(np.where(named, _NONE, local), _text(tz))
    utc = np.where(named & (local != _NONE), local - np.where(named, off, 0), at)
    return pa.StructArray.from_arrays([_nullable(utc), pa.array(named), _nullable(local)], names=["utc", "named", "local"])


def _walls(local: pa.Array, tz: pa.Array) -> pa.Array:
    return _nullable(walls(pc.fill_null(local, _NONE).to_numpy(zero_copy_only=False), _text(tz)))


_STRUCT = T.StructType([T.StructField("utc", T.LongType()), T.StructField("named", T.BooleanType()), T.StructField("local", T.LongType())])


def read_stamp(text: Column, tz: Column) -> Column:
    """``struct<utc, named, local>`` of a stamp: its instant, whether it names its zone, and its clock.

    A stamp without zone is the wall clock of zone ``tz``. Declared non-deterministic so that the optimizer
    neither copies it into filters nor runs it twice.
    """
    return F.arrow_udf(_read, _STRUCT).asNondeterministic()(text, tz)


def walls_to_utc(local: Column, tz: Column) -> Column:
    """``wall_to_utc`` as a column."""
    return F.arrow_udf(_walls, T.LongType()).asNondeterministic()(local, tz)


def level_name(text: Column) -> Column:
    """TRACE, DEBUG, INFO, WARN, ERROR or FATAL of a level in whatever spelling; null for others."""
    up, out = F.upper(F.trim(text)), None
    for name, spellings in LEVELS.items():
        out = F.when(up.isin(spellings), name) if out is None else out.when(up.isin(spellings), name)
    return out
