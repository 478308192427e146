"""Problem 6: one UTC instant per row from stamps of mixed notation and zone."""

from __future__ import annotations

from collections.abc import Iterator
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.instants import DAY_US, day_offset, header_stamp, read_stamp, wall_to_utc, walls_to_utc
from logloom.session import staged

def listed_zones(zones: DataFrame) -> DataFrame:
    """``__node, __tz``: one zone per ip; an ip with two zones is of no known zone, and so, later, is one whose zone doesn't exist."""
    return (
        zones.select("ip", "tz").where("ip is not null and tz is not null")
        .groupBy("ip").agg(F.min("tz").alias("tz"), F.max("tz").alias("tz_max"))
        .where(F.col("tz") == F.col("tz_max")).select(F.col("ip").alias("__node"), F.col("tz").alias("__tz"))
    )


def stamped(log: DataFrame, zones: DataFrame) -> DataFrame:
    """``log`` plus ``__tz`` and ``__x``: ``struct<utc, basis, local>``.

    The header's stamp is read only where ``time`` denotes no instant. ``basis`` is 'absolute' (the
    stamp names its zone) or 'catalog' (the node's zone is known); null where there is no instant yet,
    and only there ``local`` holds the wall clock of the stamp, if any.
    """
    rows = log.join(listed_zones(zones), log["ip"] == F.col("__node"), "left").drop("__node")
    rows = rows.withColumn("__a", read_stamp(F.col("time"), F.col("__tz")))
    rows = rows.withColumn("__h", F.when(F.col("__a.utc").isNull(), header_stamp(F.col("log_txt"))))
    rows = rows.withColumn("__b", read_stamp(F.col("__h"), F.col("__tz")))
    utc = F.coalesce("__a.utc", "__b.utc")
    named = F.when(F.col("__a.utc").isNotNull(), F.col("__a.named")).otherwise(F.col("__b.named"))
    basis = F.when(utc.isNotNull(), F.when(named, "absolute").otherwise("catalog"))
    local = F.when(utc.isNull(), F.coalesce("__a.local", "__b.local"))
    return rows.withColumn("__x", F.struct(utc.alias("utc"), basis.alias("basis"), local.alias("local"))).drop("__a", "__h", "__b")


def estimated_zones(rows: DataFrame, listed: DataFrame, bucket_rows: int = 32, tolerance_s: int = 600) -> DataFrame:
    """Zones of the nodes the catalog lacks: ``(__node, __tz, n, violations)``.

    ``rows`` has ``log_id, ip, __tz, __x`` (see ``stamped``), ``listed`` the catalog. Rows that arrived together
    are those of one stretch of ``bucket_rows`` log ids; the arrival clock shows the stretch's known instants, of
    which there are several where late rows came in between. The candidates are all IANA zones, listed for other
    nodes or not; a stamp violates one if, read by it, it denotes no instant or one further than ``tolerance_s``
    from all that the arrival clock shows. Each node gets the candidate with fewest violations, then with the
    least distance of its other stamps from the arrival clock, provided that fewer than half of its stamps
    violate it. Zones alike in all that had the same offsets at the stamps: one listed for another node is
    preferred, then the first by name. Instants per stretch, the stamps of these nodes and per-node counts are
    shuffled.
    """
    bucket = F.floor(F.col("log_id") / bucket_rows)
    # at most bucket_rows instants, ids being unique
    clock = rows.select(bucket.alias("_k"), F.col("__x")["utc"].alias("u")).where("u is not null").groupBy("_k").agg(F.collect_set("u").alias("_clock"))
    unknown = rows.where("__tz is null and ip is not null").select("ip", bucket.alias("_k"), F.col("__x")["local"].alias("_l")).where("_l is not null")
    candidates = sorted(available_timezones() - {"Factory", "localtime"})

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _zone_votes(batch, candidates, tolerance_s * 1_000_000)

    cast = unknown.join(clock, "_k").select("ip", "_l", "_clock").mapInPandas(votes, "ip string, _z string, n long, hits long, far long")
    counts = cast.groupBy("ip", "_z").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("far").alias("far"))
    each = counts.withColumn("n", F.sum("n").over(W.partitionBy("ip"))).where("_z is not null").withColumn("violations", F.col("n") - F.col("hits"))
    met = listed.select(F.col("__tz").alias("_z"), F.lit(True).alias("_met")).distinct()
    ranked = each.where("violations * 2 < n").join(met, "_z", "left")
    best = ranked.withColumn("_r", F.row_number().over(W.partitionBy("ip").orderBy("violations", "far", F.col("_met").isNull(), "_z")))
    return best.where("_r = 1").select(F.col("ip").alias("__node"), F.col("_z").alias("__tz"), "n", "violations")


def _zone_votes(rows: pd.DataFrame, candidates: list[str], tolerance_us: int) -> pd.DataFrame:
    """``ip, _z, n, hits, far``: per node its stamps (zone null), and per zone those within the tolerance and their distances' sum."""
    node, ips = pd.factorize(rows["ip"])
    local, shown = rows["_l"].to_numpy(np.int64), rows["_clock"]
    clock = np.full((len(rows), max(map(len, shown), default=0)), np.inf)
    for i, at in enumerate(shown):
        clock[i, : len(at)] = at
    days, at = np.unique(local // DAY_US, return_inverse=True)
    total = np.bincount(node, minlength=len(ips))
    out = [(ip, None, int(n), 0, 0) for ip, n in zip(ips, total, strict=True)]
    alike: dict[tuple, list[str]] = {}  # zones of the same offsets on all days, where they don't change within one
    for zone in candidates:
        offsets = tuple(day_offset(int(d), zone) for d in days)
        alike.setdefault((offsets, zone if None in offsets else ""), []).append(zone)
    for (offsets, _), zones in alike.items():
        utc = local - np.array([np.nan if o is None else o for o in offsets])[at]
        for i in np.flatnonzero(np.isnan(utc)):  # the clock was set on that day
            exact = wall_to_utc(int(local[i]), zones[0])
            utc[i] = np.nan if exact is None else exact
        far = np.abs(utc[:, None] - clock).min(axis=1)
        near = far <= tolerance_us
        if near.any():
            hits = np.bincount(node[near], minlength=len(ips))
            gaps = np.bincount(node[near], far[near], minlength=len(ips))
            out += [(ips[i], zone, 0, int(hits[i]), int(gaps[i])) for i in np.flatnonzero(hits) for zone in zones]
    return pd.DataFrame(out, columns=["ip", "_z", "n", "hits", "far"])


def read_once(log: DataFrame, zones: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``log_id, ip, __tz, __x``, stored: the log's stamps are read once, however often they are used."""
    columns = list(dict.fromkeys([*keep, "log_id", "ip"]))
    return staged(stamped(log, zones).select(*columns, "__tz", "__x"), "stamps")


def instants(log: DataFrame, zones: DataFrame, estimate: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``log`` with ``utc_us`` (microseconds since 1970-01-01 UTC) and ``basis``.

    Needs columns ``log_id, time, ip, log_txt``; other columns pass through, or only those in ``keep``, and
    columns named ``utc_us`` or ``basis`` are replaced. ``basis``: 'absolute', 'catalog', 'estimated' (the
    node's zone is not in ``zones`` but was inferred from order of arrival), or null together with ``utc_us``
    where no stamp denotes exactly one instant. Null columns, blank texts and an empty table are fine; every
    row of ``log`` comes out once.
    """
    keep = [c for c in (log.columns if keep is None else keep) if c not in ("utc_us", "basis")]
    used = list(dict.fromkeys([*keep, "log_id", "time", "ip", "log_txt"]))
    if not estimate:
        rows = stamped(log.select(*used), zones)
        return rows.select(*keep, F.col("__x")["utc"].alias("utc_us"), F.col("__x")["basis"].alias("basis"))
    rows = read_once(log.select(*used), zones, keep)
    guess = estimated_zones(rows, listed_zones(zones)).select("__node", F.col("__tz").alias("__gz"))
    # one row per node of the log without zone: Spark broadcasts it if it is small, else joins by hash
    both = rows.join(guess, rows["ip"] == F.col("__node"), "left").withColumn("__guess", walls_to_utc(F.col("__x.local"), F.col("__gz")))
    return both.select(
        *[rows[c] for c in keep], F.coalesce(F.col("__x")["utc"], "__guess").alias("utc_us"),
        F.coalesce(F.col("__x")["basis"], F.when(F.col("__guess").isNotNull(), F.lit("estimated"))).alias("basis"),
    )


def held_out_zones(log: DataFrame, zones: DataFrame) -> DataFrame:
    """``ip, listed, estimated, n, same``: how well the zones of listed nodes are found if they are hidden.

    The catalog is taken away, so that only stamps that name their zone make the arrival clock, and every
    node's zone is estimated. ``n`` counts the node's stamps without zone, ``same`` those that listed and
    estimated zone place at the same instant or both at none. A node for which no zone is found has
    ``estimated`` null and ``same`` 0; nodes without such stamps have ``n`` 0.
    """
    listed = listed_zones(zones)
    rows = read_once(log.select("log_id", "time", "ip", "log_txt"), zones.limit(0), ["log_id"])
    guess = estimated_zones(rows, listed.limit(0)).select("__node", F.col("__tz").alias("__gz"))
    asked = rows.select("ip", F.col("__x.local").alias("__local")).where("__local is not null")
    both = asked.join(listed.withColumnRenamed("__tz", "__lz"), asked["ip"] == F.col("__node")).drop("__node")
    both = both.join(guess, both["ip"] == F.col("__node"), "left").drop("__node")
    both = both.withColumns({"__a": walls_to_utc(F.col("__local"), F.col("__lz")), "__b": walls_to_utc(F.col("__local"), F.col("__gz"))})
    same = F.count_if(F.col("__gz").isNotNull() & F.col("__a").eqNullSafe(F.col("__b")))
    counted = both.groupBy("ip").agg(F.max("__gz").alias("estimated"), F.count("*").alias("n"), same.alias("same"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "same")]
    return listed.select(F.col("__node").alias("ip"), F.col("__tz").alias("listed")).join(counted, "ip", "left").select("ip", "listed", "estimated", *zero)
