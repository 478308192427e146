"""Offset chunking against plain grouping."""

from pyspark.sql import functions as F

from logloom.operators.skew import key_figures, numbered


def test_numbers_are_exact(spark):
    df = spark.range(0, 10_000, 1, 7).select((F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50)).alias("k"), "id", F.lit(1).alias("_n0"))
    got = numbered(df, ["k"])
    bad = got.groupBy("k").agg(F.count("*").alias("c"), F.countDistinct("_n").alias("d"), F.min("_n").alias("lo"), F.max("_n").alias("hi")).where("c <> d or lo <> 0 or hi <> c - 1")
    assert bad.count() == 0 and got.count() == 10_000


def test_figures(spark):
    rows = [(k, t, v) for k in (1, 2, None) for t, v in ((5, "a"), (3, "b"), (None, None), (3, "b"))] + [(1, 9, "c")] * 50
    df = spark.createDataFrame(rows, "k long, t long, v string")
    got = {r["k"]: tuple(r)[1:] for r in key_figures(df, ["k"], "t", "v", chunk_rows=7).collect()}
    assert got == {1: (54, 3, 9, 3, 8), 2: (4, 3, 5, 2, 1), None: (4, 3, 5, 2, 1)}
    assert key_figures(df.limit(0), ["k"], "t", "v").count() == 0
    only_null = spark.createDataFrame([(1, None, None)], "k long, t long, v string")
    assert [tuple(r) for r in key_figures(only_null, ["k"], "t", "v").collect()] == [(1, 1, None, None, 0, 1)]
