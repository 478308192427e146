"""Stamps and instants against brute force, and the cases that must not crash."""

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logloom.functions.instants import DAY_US, HEADER_STAMP, MONTHS, ZONE_HOURS, day_offset, read_stamp, stamps, wall_to_utc, walls_to_utc
from logloom.operators.instants import estimated_zones, held_out_zones, instants, listed_zones, stamped
from logloom.session import table

DATA = "/root/testdata/sf0.001"
T = 1_539_086_400_000_000  # 2018-10-09T12:00:00Z


# A plain reader of stamps, a row at a time, that the column expressions are held against.
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d+))?"
_ZONE = r"(?:\s*(?P<z>[A-Za-z]{1,5}))?\s*(?P<o>[+-]\d{2}:?\d{2})?\s*"
_NAME = r"(?P<m>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
#: The notations of a calendar stamp; a stamp without year matches none.
NOTATIONS = [
    re.compile(p, re.IGNORECASE | re.ASCII)
    for p in (
        r"\s*(?P<y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})[T ]\s*" + _CLOCK + _ZONE,
        r"\s*(?P<d>\d{2})\.(?P<m>\d{2})\.(?P<y>\d{4})[T ]\s*" + _CLOCK + _ZONE,
        r"\s*(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d+))?" + _ZONE,
        r"\s*" + _NAME + r"\s+(?P<d>\d{1,2}),\s*(?P<y>\d{4})\s+" + _CLOCK + r"\s*(?P<p>[AP]M)" + _ZONE,
        r"\s*(?:[A-Z]{3},\s*)?(?P<d>\d{1,2})[\s-]" + _NAME + r"[\s-](?P<y>\d{4})\s+" + _CLOCK + _ZONE,
    )
]
_COUNT = re.compile(r"\s*(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:[.,](\d+))?\s*", re.ASCII)
_EPOCH = datetime(1970, 1, 1)


def stamp(text: str | None) -> tuple[int, int | None] | None:
    """``(local_us, off_us)`` of a stamp, or None where the text is none.

    ``local_us`` counts microseconds of the stamp's own clock since 1970-01-01; ``off_us`` is that
    clock's distance from UTC, None if the stamp names no zone. Missing digits are 0, digits beyond
    microseconds are dropped. An unknown zone name or a date that doesn't exist makes it no stamp.
    """
    if not text:
        return None
    if c := _COUNT.fullmatch(text):
        lead = 9 + len(c[1]) % 3 % 2  # 9 or 10 digits are whole seconds
        digits = c[1] + (c[2] or "")
        return int(digits[:lead]) * 1_000_000 + int(digits[lead : lead + 6].ljust(6, "0")), 0
    for notation in NOTATIONS:
        if hit := notation.fullmatch(text):
            return _calendar(hit.groupdict())
    return None


def _calendar(g: dict[str, str | None]) -> tuple[int, int | None] | None:
    hour = int(g["h"])
    if half := g.get("p"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.upper() == "PM")
    name = (g["z"] or "").upper()
    if name and name not in ZONE_HOURS:
        return None
    try:
        month = int(g["m"]) if g["m"].isdigit() else MONTHS.index(g["m"][:3].lower()) + 1
        gap = datetime(int(g["y"]), month, int(g["d"]), hour, int(g["mi"]), int(g["s"])) - _EPOCH
    except ValueError:
        return None
    local = (gap.days * 86_400 + gap.seconds) * 1_000_000 + int((g["f"] or "")[:6].ljust(6, "0"))
    hours = ({"": None} | ZONE_HOURS)[name]
    off = None if hours is None else hours * 3_600_000_000
    if o := g["o"]:
        off = (int(o[1:3]) * 60 + int(o[-2:])) * 60_000_000 * (-1 if o[0] == "-" else 1)
    return local, off


STAMPS = [
        ("2018-10-09T12:00:00Z", (T, 0)), ("2018-10-09 12:00:00,5", (T + 500_000, None)), (" 2018/10/09 12:00:00 ", (T, None)), ("09.10.2018 12:00:00", (T, None)),
        ("20181009T120000Z", (T, 0)), ("Oct 9, 2018 12:00:00 PM", (T, None)), ("Oct 9, 2018 12:00:00 AM", (T - 43_200_000_000, None)), ("Tue, 09 Oct 2018 12:00:00 GMT", (T, 0)),
        ("1539086400", (T, 0)), ("1539086400123", (T + 123_000, 0)), ("1539086400123456", (T + 123_456, 0)), ("1539086400.1234567", (T + 123_456, 0)), ("1539086400123456789", (T + 123_456, 0)),
        ("2018-10-09 12:00:00 GMT+08:00", (T, 28_800_000_000)), ("2018-10-09T12:00:00.123456789-04:00", (T + 123_456, -14_400_000_000)), ("2018-10-09 12:00:00 CEST", (T, 7_200_000_000)),
        ("2018-10-09 12:00:00.000000 +0530", (T, 19_800_000_000)), ("0000-00-00 00:00:00", None), ("unknown", None), ("", None), (None, None), ("2018-10-09 25:00:00", None),
        ("2018-10-09 12:00:00 XYZ", None), ("Oct  9 12:00:00", None), ("Oct 9, 2018 13:00:00 PM", None),
    ("2016-02-29 00:00:00Z", (1_456_704_000_000_000, 0)), ("2015-02-29 00:00:00Z", None), ("1900-02-29 00:00:00", None), ("2000-02-29T23:59:59.9999999Z", (951_868_799_999_999, 0)), ("1969-12-31 23:59:59Z", (-1_000_000, 0)),
    ("31-Dec-1999 23:59:60", None), ("31-dec-1999 23:59:59 est", (946_684_799_000_000, -18_000_000_000)), ("2018-04-31 00:00:00", None), ("2018-00-10 00:00:00", None), ("2018-10-09T12:00:00Z\n", (T, 0)), ("12345678", None), ("12345678901", None), ("1539086400,5", (T + 500_000, 0)),
]


def test_stamp(spark):
    assert [(text, stamp(text)) for text, _ in STAMPS] == STAMPS
    local, off = stamps(pa.array([t for t, _ in STAMPS]))
    none = np.iinfo(np.int64).min
    got = [None if a == none else (a, None if b == none else b) for a, b in zip(local.tolist(), off.tolist(), strict=True)]
    assert list(zip([t for t, _ in STAMPS], got, strict=True)) == STAMPS
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STAMPS)], "i int, t string")
    utc = {r.i: r.s.utc for r in rows.select("i", read_stamp(F.col("t"), F.lit("UTC")).alias("s")).collect()}
    assert [utc[i] for i in range(len(STAMPS))] == [w and w[0] - (w[1] or 0) for _, w in STAMPS]


def test_wall_clock(spark):
    twice = 1_540_692_000_000_000  # 2018-10-28 02:00:00, shown twice in Berlin
    assert wall_to_utc(twice, "Europe/Berlin") is None
    assert wall_to_utc(twice, "UTC") == twice
    never = 1_521_944_100_000_000  # 2018-03-25 02:15:00 was skipped there
    assert wall_to_utc(never, "Europe/Berlin") is None
    assert wall_to_utc(T, "Europe/Berlin") == T - 7_200_000_000
    assert wall_to_utc(T, None) is None and wall_to_utc(T, "No/Where") is None
    zones = [None, "UTC", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "Pacific/Apia", "+05:30"]
    asked = [(z, t) for z in zones[:-1] for t in [None, T, twice, never, *range(1_520_000_000_000_000, 1_545_000_000_000_000, 1_750_000_000_000), *range(twice - 4 * 3_600_000_000, twice + 4 * 3_600_000_000, 600_000_000)]]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, z string, t long")
    got = {r.i: r.u for r in rows.select("i", walls_to_utc(F.col("t"), F.col("z")).alias("u")).collect()}
    assert [got[i] for i in range(len(asked))] == [None if t is None else wall_to_utc(t, z) for z, t in asked]


def _brute(rows, zones):
    out = {}
    for r in rows:
        for text in (r["time"], (m[1] if (m := re.match(HEADER_STAMP, r["log_txt"] or "")) else None)):
            read = stamp(text)
            at = None if read is None else read[0] - read[1] if read[1] is not None else wall_to_utc(read[0], zones.get(r["ip"]))
            if at is not None:
                out[r["log_id"]] = at
                break
    return out


def test_against_brute_force(spark):
    log, zones = table(spark, DATA, "event_type_ansible"), table(spark, DATA, "node_zones")
    got = {r["log_id"]: r["utc_us"] for r in instants(log, zones).where("basis <> 'estimated'").collect()}
    assert got == _brute(log.collect(), {r["ip"]: r["tz"] for r in zones.collect()})


def test_estimated_zone(spark):
    rows = [(i, f"2018-10-09 12:{i % 60:02d}:00" if i % 2 else f"2018-10-09T10:{i % 60:02d}:00Z", "n", "") for i in range(60)]
    log = spark.createDataFrame(rows, "log_id long, time string, ip string, log_txt string")
    zones = spark.createDataFrame([("other", "Europe/Berlin"), ("third", "Asia/Shanghai")], "ip string, tz string")
    found = estimated_zones(stamped(log, zones), listed_zones(zones)).collect()
    assert [(r["__node"], r["__tz"]) for r in found] == [("n", "Europe/Berlin")]
    got = {r["log_id"]: (r["utc_us"], r["basis"]) for r in instants(log, zones).collect()}
    assert got[1] == (T - 7_200_000_000 + 60_000_000, "estimated")


def test_estimated_zone_that_no_node_is_listed_in(spark):
    shown = {"p": -3 * 60, "k": 5 * 60 + 45}  # minutes ahead of UTC; only Kolkata, 15 minutes off the second, is listed
    noon = datetime(2018, 10, 9, 12)
    rows = [(i, f"{noon + timedelta(minutes=i)}Z", "z", "") for i in range(0, 120, 2)]
    for i in range(1, 120, 2):
        node = "pk"[i // 2 % 2]
        rows.append((i, str(noon + timedelta(minutes=i + shown[node])), node, ""))
    log = spark.createDataFrame(rows, "log_id long, time string, ip string, log_txt string")
    zones = spark.createDataFrame([("other", "Europe/Berlin"), ("third", "Asia/Kolkata")], "ip string, tz string")
    found = {r["__node"]: r for r in estimated_zones(stamped(log, zones), listed_zones(zones)).collect()}
    assert {k: ZoneInfo(r["__tz"]).utcoffset(noon) for k, r in found.items()} == {k: timedelta(minutes=m) for k, m in shown.items()}
    assert [(found[k]["n"], found[k]["violations"]) for k in "pk"] == [(30, 0)] * 2
    got = {r["log_id"]: r["utc_us"] for r in instants(log, zones).collect()}
    assert got == {i: T + i * 60_000_000 for i in range(120)}


def test_hidden_zones_are_found(spark):
    log, zones = table(spark, "/root/testdata/sf0.01", "event_type_ansible"), table(spark, "/root/testdata/sf0.01", "node_zones")
    rows = held_out_zones(log, zones).collect()
    assert len(rows) == zones.count() and sum(r["same"] for r in rows) >= 0.9 * sum(r["n"] for r in rows) > 0


def test_day_offset():
    october = 1_540_684_800_000_000 // DAY_US  # 2018-10-28, when the clock was set back in Berlin
    assert [day_offset(october + d, "Europe/Berlin") for d in (-1, 0, 1)] == [7_200_000_000, None, 3_600_000_000]
    assert day_offset(october, "UTC") == 0 and day_offset(october, "No/Where") is None and day_offset(10**9, "UTC") is None


def test_odd_rows(spark):
    schema = "log_id long, time string, ip string, log_txt string, basis string, tz string, utc_us long, n int"
    rows = [(1, None, None, None, "x", "y", 5, 1), (2, "", "ip", "", "x", None, None, None), (2, "", "ip", "", "x", None, None, None), (3, "2018-10-09T12:00:00Z", None, "x" * 2_000_000, None, None, None, None)]
    log = spark.createDataFrame(rows, schema)
    zones = spark.createDataFrame([("ip", None), (None, "UTC"), ("bad", "No/Where")], "ip string, tz string")
    got = instants(log, zones)
    assert sorted(got.columns) == sorted(log.columns)
    assert sorted((r["log_id"], r["utc_us"]) for r in got.fillna(-1, ["utc_us"]).collect()) == [(1, -1), (2, -1), (2, -1), (3, T)]
    assert instants(log.limit(0), zones.limit(0)).count() == 0
    assert [(r["ip"], r["n"], r["estimated"]) for r in held_out_zones(log.limit(0), zones).collect()] == [("bad", 0, None)]
    assert instants(log, zones, keep=["log_id"]).columns == ["log_id", "utc_us", "basis"]
    assert instants(log, zones.limit(0)).where(F.col("utc_us").isNotNull()).count() == 1
