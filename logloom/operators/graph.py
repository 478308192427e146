"""Graphs of event series: operational events, time-weighted control flow, transaction flow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.ordering import positions

#: Rows of one stretch of the global order; neighbours are looked for in it and the next one only.
STRETCH = 4096


def neighbours(series: DataFrame, order: str = "rn", event: str = "event", window: int = 3) -> DataFrame:
    """``event, neighbour`` for each of the next ``window`` rows of every row.

    A window over stretches of the order, each with the rows just after it, instead of one over all rows.
    """
    rows = positions(series.select(F.col(order).alias("_o"), F.col(event).alias("event")), "_o")
    k = F.floor(F.col("rn") / STRETCH)
    own = F.struct(k.alias("k"), F.lit(True).alias("own"))
    spread = rows.withColumn("_s", F.explode(F.when((F.col("rn") % STRETCH < window) & (k > 0), F.array(own, F.struct((k - 1).alias("k"), F.lit(False).alias("own")))).otherwise(F.array(own))))
    ahead = F.collect_list("event").over(W.partitionBy("_s.k").orderBy("rn").rowsBetween(1, window))
    return spread.withColumn("_n", ahead).where("_s.own").select("event", F.explode("_n").alias("neighbour"))


def vicinity_counts(series: DataFrame, order: str = "rn", event: str = "event", window: int = 3) -> DataFrame:
    """``event, neighbour, n``: how often two events are neighbours, counted from both sides; a pair of equal ones counts twice."""
    pairs = neighbours(series, order, event, window)
    counted = pairs.groupBy("event", "neighbour").agg(F.count("*").alias("n"))
    return counted.unionByName(counted.select(F.col("neighbour").alias("event"), F.col("event").alias("neighbour"), "n")).groupBy("event", "neighbour").agg(F.sum("n").alias("n"))


def operational_events(series: DataFrame, order: str = "rn", event: str = "event", window: int = 3, threshold: int = 10) -> DataFrame:
    """``event``: events with neighbours of which none is a neighbour more than ``threshold`` times."""
    return vicinity_counts(series, order, event, window).groupBy("event").agg(F.max("n").alias("most")).where(F.col("most") <= threshold).select("event")


def without_operational(series: DataFrame, order: str = "rn", event: str = "event", window: int = 3, threshold: int = 10) -> DataFrame:
    """The series without its operational events."""
    gone = operational_events(series, order, event, window, threshold).withColumnRenamed("event", "_gone")
    return series.join(gone, series[event] == gone["_gone"], "left_anti")


def successors(series: DataFrame, period: float, order: str = "rn", event: str = "event", time: str = "time") -> DataFrame:
    """``start, event, successor, dt``: for every row but the last, the first later row of each other event within ``period`` seconds.

    The rows must be in order of time. The time axis is cut into buckets of one period, so a row's successors lie
    in its own bucket or the next. Buckets go through their task backwards, holding the next row of each event:
    that is rows times events at most, however many rows a period has, and no bucket is held whole.
    """
    rows = series.select(F.col(order).cast("long").alias("rn"), F.col(event).alias("event"), F.col(time).cast("double").alias("t")).dropna()
    kind = rows.schema["event"].dataType.simpleString()
    last = rows.agg(F.max("rn").alias("_last"))
    bucket = F.floor(F.col("t") / period)
    spread = rows.join(F.broadcast(last)).select("rn", "event", "t", (F.col("rn") < F.col("_last")).alias("starts"), F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket - 1).alias("b"), F.lit(False).alias("own")))).alias("_s"))

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, following = None, {}
        for batch in batches:
            out = []
            for b, own, rn, e, t, starts in batch[["b", "own", "rn", "event", "t", "starts"]].itertuples(index=False):
                if b != at:
                    at, following = b, {}
                if own and starts:
                    out += [(rn, e, x, t1 - t) for x, t1 in following.items() if x != e and 0 <= t1 - t < period]
                following[e] = t
            yield pd.DataFrame(out, columns=["start", "event", "successor", "dt"])

    ordered = spread.select("_s.b", "_s.own", "rn", "event", "t", "starts").repartition("b").sortWithinPartitions("b", F.desc("rn"))
    return ordered.mapInPandas(back, f"start long, event {kind}, successor {kind}, dt double")


def supported(found: DataFrame, series: DataFrame, threshold: float, order: str = "rn", event: str = "event") -> DataFrame:
    """Successors of pairs whose share of the event's windows exceeds ``threshold``; the last row is no window."""
    last = series.agg(F.max(order).alias("_last"))
    windows = series.join(F.broadcast(last)).where(F.col(order) < F.col("_last")).groupBy(F.col(event).alias("event")).agg(F.count("*").alias("_w"))
    share = found.groupBy("event", "successor").agg(F.count("*").alias("_n")).join(windows, "event").where(F.col("_n") / F.col("_w") > threshold)
    return found.join(share.select("event", "successor"), ["event", "successor"])


def cfg_edges(found: DataFrame) -> DataFrame:
    """``src, dst, weight``: control-flow edges, weighted by the longest time between."""
    return found.groupBy(F.col("event").alias("src"), F.col("successor").alias("dst")).agg(F.max("dt").alias("weight"))


def tfg_edges(found: DataFrame, epsilon: float, outlier: float) -> DataFrame:
    """``src, dst, weight``: transaction edges by the modal time between, if below ``outlier``.

    The mode is the largest of the times with the most others within the open interval of ``epsilon``.
    It is the number of times below the upper end less that of times up to the lower end, both read off one
    running count over times and ends in order. Each pair's times are cut into stretches of many epsilons that
    overlap by one, so no task sorts all times of a pair.
    """
    key = ["event", "successor"]
    times = found.groupBy(*key, "dt").agg(F.count("*").alias("c"))
    cell = lambda t: F.floor(t / (64.0 * epsilon))
    reach = F.array_distinct(F.array(cell(F.col("dt")), cell(F.col("dt") - epsilon), cell(F.col("dt") + epsilon)))
    row = lambda v, kind, c, sign: F.struct(v.alias("v"), F.lit(kind).alias("kind"), c.alias("c"), F.lit(sign).alias("sign"))
    points = times.select(*key, "dt", F.explode(reach).alias("k"), row(F.col("dt"), 1, F.col("c"), 0).alias("x"))
    # at equal values the upper end comes before the times, the lower end after them: the interval is open
    ends = F.array(row(F.col("dt") + epsilon, 0, F.lit(0).cast("long"), 1), row(F.col("dt") - epsilon, 2, F.lit(0).cast("long"), -1))
    asked = times.select(*key, "dt", cell(F.col("dt")).alias("k"), F.explode(ends).alias("x"))
    running = F.sum("x.c").over(W.partitionBy(*key, "k").orderBy("x.v", "x.kind").rowsBetween(W.unboundedPreceding, 0))
    counted = points.unionByName(asked).withColumn("_r", running).where("x.kind <> 1")
    dense = counted.groupBy(*key, "dt").agg(F.sum(F.col("x.sign") * F.col("_r")).alias("_n"))
    best = dense.groupBy(*key).agg(F.max_by("dt", F.struct("_n", "dt")).alias("dt"))
    return best.where((F.col("dt") > -1) & (F.col("dt") < outlier)).select(F.col("event").alias("src"), F.col("successor").alias("dst"), F.col("dt").alias("weight"))


def dot(edges: DataFrame, name: str = "flow", src: str = "src", dst: str = "dst", label: str = "weight", limit: int = 10_000) -> str:
    """DOT text of a graph of at most ``limit`` edges, in order; larger graphs are refused."""
    rows = edges.select(src, dst, label).orderBy(src, dst).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges")
    body = "".join(f'  "{r[0]}" -> "{r[1]}" [label="{r[2]}"];\n' for r in rows)
    return f"digraph {name} {{\n{body}}}\n"


def observation_matrix(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight", absent: float = -1.0) -> DataFrame:
    """One row per ``src`` in order, one column per ``dst``: weights, ``absent`` where there is no edge.

    For writing and looking at small graphs; the edge table is the form to compute with.
    """
    wide = edges.groupBy(src).pivot(dst).agg(F.first(weight))
    return wide.fillna(absent, [c for c in wide.columns if c != src]).orderBy(src)
