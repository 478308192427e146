"""Problem 9: mixing sources to target shares of the tokens, by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import staged

def source_name(source: Column) -> Column:
    """Sources that differ only in case, outer blanks or ``-`` for ``_`` are one."""
    return F.lower(F.replace(F.trim(source), F.lit("-"), F.lit("_")))


@dataclass
class Plan:
    """What a source gives: every document ``whole`` times, and ``rest`` tokens once more."""

    weight: float
    max_repeats: int
    tokens: int = 0
    squares: float = 0.0
    docs: int = 0
    goal: float = 0.0
    whole: int = 0
    rest: float = 0.0
    #: Documents of at least this size are certain of the further copy; smaller ones have odds ``factor * size``.
    certain: float = float("inf")
    factor: float = 0.0


def _goals(plans: dict[str, Plan], total: float | None) -> None:
    """Tokens per source: shares of ``total``, at most ``max_repeats`` copies; what capped sources lack the others give."""
    open_ = {s for s, p in plans.items() if p.tokens and p.weight > 0 and p.max_repeats > 0}
    weight = sum(plans[s].weight for s in open_)
    if total is None and open_:
        total = min(plans[s].max_repeats * plans[s].tokens * weight / plans[s].weight for s in open_)
    left = float(total or 0)
    while open_:
        weight = sum(plans[s].weight for s in open_)
        over = {s for s in open_ if left * plans[s].weight / weight > plans[s].max_repeats * plans[s].tokens * (1 + 1e-12)}
        for s in over or open_:
            p = plans[s]
            p.goal = float(p.max_repeats * p.tokens) if over else min(left * p.weight / weight, float(p.max_repeats * p.tokens))
        if not over:
            break
        left -= sum(plans[s].goal for s in over)
        open_ -= over
    for p in plans.values():
        if p.goal:
            p.whole = min(int(p.goal / p.tokens + 1e-12), p.max_repeats)
            p.rest = max(0.0, p.goal - p.whole * p.tokens) if p.whole < p.max_repeats else 0.0


def _planned(spark: SparkSession, plans: dict[str, Plan], *what: str) -> DataFrame:
    """The plans as a table ``source`` and one column for each of ``what``: joined, not written out as cases."""
    # a local table, so that its size is known and Spark broadcasts it where it is small
    columns = {"source": pa.array(list(plans), pa.string())} | {w: pa.array([float(getattr(p, w)) for p in plans.values()], pa.float64()) for w in what}
    return spark.createDataFrame(pa.table(columns))


def mixed(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42) -> tuple[DataFrame, dict[str, Plan]]:
    """Copies of every document: ``doc_id, source, n_tokens, copies`` (0: not used), and the plan by source.

    ``sizes`` has ``doc_id, source, n_tokens`` (a stored table: it is read several times); ``targets`` has
    ``source, weight, max_repeats``. Without ``total_tokens`` the mix is the largest whose present sources
    all get their shares. Shares of sources without tokens go to the others in proportion. Documents
    without tokens, and those of sources without target, have no copies.

    Each source gives all documents ``floor(goal / tokens)`` times, certain. The rest is one more copy of
    some: a document's odds of inclusion grow with its size so that the expected tokens are the rest, and
    those whose odds reach 1 are certain too. The others are ranked by random odds over inclusion odds
    (Pareto order sampling) and taken in this order as long as that brings the tokens closer to the rest,
    so the share is met to within half a document. The random number depends on ``doc_id`` and ``seed`` only.

    The targets' sources, one plan each of some hundred bytes, are planned on the driver, whatever their number;
    documents get their source's plan by a join.

    Ranks are running sums over a range partitioning by (source, rank key): a source of most documents is
    ranked by many tasks.
    """
    spark = sizes.sparkSession
    rows = targets.where("source is not null and weight is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("weight").alias("w"), F.max("max_repeats").alias("m")).collect()
    plans = {r["source"]: Plan(float(r["w"]), int(r["m"] or 0)) for r in rows}
    size = F.col("n_tokens").cast("double")
    known = sizes.where("n_tokens > 0").join(_planned(spark, plans), "source", "left_semi")
    for r in known.groupBy("source").agg(F.count("*").alias("d"), F.sum("n_tokens").alias("t"), F.sum(size * size).alias("q")).collect():
        p = plans[r["source"]]
        p.docs, p.tokens, p.squares = r["d"], r["t"], r["q"]
    _goals(plans, total_tokens)
    for p in plans.values():
        p.factor = p.rest / p.squares if p.rest else 0.0
    while True:  # odds that would exceed 1 are 1; the others make up for it, until nothing changes
        bounds = {s: Plan(0, 0, certain=1 / p.factor) for s, p in plans.items() if p.factor}
        sure = size >= F.col("certain")
        each = known.join(_planned(spark, bounds, "certain"), "source").groupBy("source")
        sums = each.agg(F.sum(F.when(sure, size).otherwise(0.0)).alias("c"), F.sum(F.when(sure, 0.0).otherwise(size * size)).alias("q")).collect()
        changed = False
        for r in sums:
            p = plans[r["source"]]
            if r["c"] > 0 and (1 / p.factor) < p.certain:
                p.certain, changed = 1 / p.factor, True
                p.factor = max(p.rest - r["c"], 0.0) / r["q"] if r["q"] else 0.0
        if not changed:
            break
    sure = size >= F.col("certain")
    odds = F.least(F.lit(1 - 1e-12), size * F.col("factor"))
    u = ((F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11)).cast("double") + 0.5) / float(1 << 53)
    key = F.when(sure, -1.0).otherwise((u / (1 - u)) / (odds / (1 - odds)))
    # documents of odds 0 are no candidates, and their key would be infinite
    drawn = _planned(spark, {s: p for s, p in plans.items() if p.rest > 0}, "certain", "factor", "rest")
    open_ = known.join(drawn, "source").where(sure | (odds > 0)).select("doc_id", "source", "n_tokens", key.alias("key"), "rest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, carried = TaskContext.get().partitionId(), {}
        for batch in batches:
            local = batch.groupby("source", sort=False)["n_tokens"].cumsum()
            batch["running"] = local + batch["source"].map(carried).fillna(0).astype(np.int64)
            carried |= batch.groupby("source", sort=False)["running"].last().to_dict()
            batch["part"] = part
            yield batch[["doc_id", "source", "n_tokens", "running", "part", "rest"]]

    ordered = open_.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    ranked = staged(ordered.mapInPandas(run, "doc_id long, source string, n_tokens long, running long, part int, rest double"), "ranked")
    before = ranked.groupBy("source", "part").agg(F.max("running").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    more = ranked.join(before, ["source", "part"]).where(F.col("_before") + F.col("running") - size / 2 <= F.col("rest")).select("doc_id", F.lit(1).alias("_more"))
    whole = F.when(F.col("n_tokens") > 0, F.coalesce("whole", F.lit(0.0))).otherwise(0.0).cast("long")
    out = sizes.join(_planned(spark, plans, "whole"), "source", "left").join(more, "doc_id", "left")
    return out.select("doc_id", "source", "n_tokens", (whole + F.coalesce("_more", F.lit(0))).alias("copies")), plans


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of the targets gave: documents, copies, tokens, the share reached beside the target, and the most copies of one document."""
    named = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("weight").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    used = mix.where("copies > 0").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    total = used.agg(F.sum("tokens").alias("_total"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_copies", "most_copies", "tokens")]
    joined = named.join(used, "source", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select("source", "target_share", "max_repeats", *zero, F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), F.col("_total")), F.lit(0.0)).alias("reached_share"))
