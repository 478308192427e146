"""Exact positions in a global order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import staged


def positions(rows: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """``rows`` plus ``name``: the row's place from 0 by ``order``, which should have no ties.

    Rows are range-partitioned and sorted, stored, counted per part, and numbered inside their part from the
    number of rows in the parts before. Only the counts, one a part, meet in one task.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    kept = staged(ranged, "ordered")
    counts = kept.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__i").alias("__first"))
    before = counts.select("__p", "__first", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return kept.join(before, "__p").withColumn(name, F.col("__before") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__first", "__before")
