"""Problem 7: figures per key where a few keys hold most rows, by exact offset chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import staged

#: Rows of one key that one chunk holds at most.
CHUNK_ROWS = 16_384


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` plus ``_n``: the exact number, from 0, of the row among the rows of its key.

    Rows are counted per key and input partition, the counts are prefix-summed to offsets, and rows are
    numbered inside (key, input partition) only. A key that holds most rows is thus numbered by as many
    groups as there are input partitions that hold it, never by one task. Null keys are keys.
    """
    # names of our own, so that columns of any name pass through
    part = [f"__k{i}" for i in range(len(keys))]
    # stored, so that both uses see the same input partitions whatever the plan above
    base = staged(rows.withColumns({"__p": F.spark_partition_id(), "__o": F.monotonically_increasing_id()} | dict(zip(part, map(F.col, keys), strict=True))), "numbered")
    counts = base.groupBy(*part, "__p").agg(F.count("*").alias("__c"))
    before = W.partitionBy(*part).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"{c}r") for c in part], F.col("__p").alias("__pr"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    local = base.withColumn("__i", F.row_number().over(W.partitionBy(*part, "__p").orderBy("__o")) - 1)
    same = F.col("__p") == F.col("__pr")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}r"))
    return local.join(offsets, same).withColumn("_n", F.col("__before") + F.col("__i")).drop(*part, *[f"{c}r" for c in part], "__p", "__pr", "__o", "__i", "__before")


def key_figures(rows: DataFrame, keys: list[str], instant: str, label: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key: ``n_rows, first_us, last_us, n_labels`` (distinct non-null values of ``label``).

    Each key's rows are cut into chunks of exactly ``chunk_rows`` (the last may be shorter); a chunk is
    one state (rows, first, last by label), and the ordered states of a key are merged. Null instants and
    labels count as rows but give no instant and no label; a key without any has null instants and 0
    labels. Null keys form a group of their own. An empty table gives no rows.
    """
    slim = rows.select(*keys, F.col(instant).alias("_t"), F.col(label).alias("_l"))
    chunked = numbered(slim, keys).withColumn("_chunk", F.floor(F.col("_n") / chunk_rows))
    # the state of a chunk: its rows and bounds by label; a key has at most rows / chunk_rows chunks
    bounds = [F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    states = chunked.groupBy(*keys, "_chunk", "_l").agg(F.count("*").alias("_rows"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    # states of one label are merged first, so no key's labels are ever gathered in one value
    merged = states.groupBy(*keys, "_l").agg(F.sum("_rows").alias("_rows"), *bounds, F.max("_chunk").alias("_chunk"))
    return merged.groupBy(*keys).agg(
        F.sum("_rows").alias("n_rows"), F.min("_first").alias("first_us"), F.max("_last").alias("last_us"),
        F.count("_l").alias("n_labels"), (F.max("_chunk") + 1).alias("n_chunks"),
    )


def by_field(rows: DataFrame, fields: list[str], *others: Column) -> DataFrame:
    """One row per row and field: ``field, key_value`` and the other columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("key_value")) for f in fields])).alias("_kv")
    return rows.select(pairs, *others).select("_kv.field", "_kv.key_value", *[c for c in rows.select(*others).columns])
