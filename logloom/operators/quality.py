"""Quality of templates and of labellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.similarity import ANY


def folded_templates(logs: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """``keys, template, n``: token lists of one group folded position by position: equal tokens stay, others are ``*``.

    The fold doesn't depend on order: a position is constant if its least and greatest token are equal.
    """
    places = logs.select(*keys, F.posexplode(tokens).alias("i", "token"))
    cells = places.groupBy(*keys, "i").agg(F.min("token").alias("lo"), F.max("token").alias("hi"), F.count("*").alias("n"))
    token = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(ANY)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", token.alias("t")))), lambda x: x["t"])
    return cells.groupBy(*keys).agg(F.array_join(parts, " ").alias("template"), F.max("n").alias("n"))


def position_counts(logs: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """``keys, i, token, f``: how often each token stands at each position of a group."""
    return logs.select(*keys, F.posexplode(tokens).alias("i", "token")).groupBy(*keys, "i", "token").agg(F.count("*").alias("f"))


def position_gini(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, i, gini``: 1 less the sum of squared shares of the tokens."""
    f = F.col("f").cast("double")
    return counts.groupBy(*keys, "i").agg((1 - F.sum(f * f) / (F.sum(f) * F.sum(f))).alias("gini"))


def position_entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, i, entropy``: natural-log entropy of the tokens."""
    f = F.col("f").cast("double")
    return counts.groupBy(*keys, "i").agg((F.ln(F.sum(f)) - F.sum(f * F.ln(f)) / F.sum(f)).alias("entropy"))


def token_pairs(templates: DataFrame, key: str, tokens: Column, lead: bool = False) -> DataFrame:
    """``key, a, b``: distinct ordered pairs of a template's constants; ``lead`` puts ``Previous_Token`` first."""
    kept = F.filter(tokens, lambda x: (x != ANY) & ~x.contains("PATTERN_"))
    if lead:
        kept = F.concat(F.array(F.lit("Previous_Token")), kept)
    rows = templates.select(key, kept.alias("_k")).select(key, F.explode(F.flatten(F.transform("_k", lambda a, i: F.transform(F.slice("_k", i + 2, F.greatest(F.size("_k") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b"))))) ).alias("p"))
    return rows.select(key, "p.a", "p.b").distinct()


def quality(templates: DataFrame, key: str, tokens: Column, lead: bool = False) -> DataFrame:
    """``compactness, distance, quality``: mean share of constants times the mean least distance to another template.

    Distance is 1 less the Jaccard similarity of token pairs, 1 at most. Only templates that share a pair
    can be closer than 1, so they are joined on pairs, not compared all with all; templates without pairs
    are at distance 1.
    """
    shape = templates.select(key, F.try_divide(F.size(F.filter(tokens, lambda x: x != ANY)), F.size(tokens)).alias("_c"))
    pairs = token_pairs(templates, key, tokens, lead)
    size = pairs.groupBy(key).agg(F.count("*").alias("_s"))
    x, y = [pairs.select(F.col(key).alias(f"k{s}"), "a", "b") for s in "12"]
    shared = x.join(y, ["a", "b"]).where("k1 <> k2").groupBy("k1", "k2").agg(F.count("*").alias("_n"))
    s1, s2 = [size.select(F.col(key).alias(f"k{s}"), F.col("_s").alias(f"s{s}")) for s in "12"]
    close = shared.join(s1, "k1").join(s2, "k2").groupBy(F.col("k1").alias(key)).agg(F.min(1 - F.col("_n") / (F.col("s1") + F.col("s2") - F.col("_n"))).alias("_d"))
    each = shape.join(close, key, "left").select("_c", F.least(F.lit(1.0), F.coalesce("_d", F.lit(1.0))).alias("_d"))
    return each.agg(F.avg("_c").alias("compactness"), F.avg("_d").alias("distance")).withColumn("quality", F.col("compactness") * F.col("distance"))


def agreement(labels: DataFrame, standard: DataFrame, key: str = "log_id", event: str = "event") -> DataFrame:
    """``squared_fit, mean_fit``: how well a labelling fits a standard one, as means over the rows of ``labels``.

    With G the row's group, F its standard group and I what both share: mean of ((I/G)^2 + sqrt(I/F)) / 2, and
    of (I/G + I/F) / 2. Rows without standard label share nothing but count.
    """
    x, y = labels.select(key, F.col(event).alias("ex")), standard.select(key, F.col(event).alias("ey"))
    cells = x.join(y, key, "left").groupBy("ex", "ey").agg(F.count("*").alias("i"))
    f = cells.withColumns({"g": F.sum("i").over(W.partitionBy("ex")), "f": F.sum("i").over(W.partitionBy("ey"))})
    c1, c2 = F.when(F.col("ey").isNull(), 0.0).otherwise(F.col("i") / F.col("g")), F.when(F.col("ey").isNull(), 0.0).otherwise(F.col("i") / F.col("f"))
    mean = lambda v: F.sum(v * F.col("i")) / F.sum("i")
    return f.agg(mean((c1 * c1 + F.sqrt(c2)) / 2).alias("squared_fit"), mean((c1 + c2) / 2).alias("mean_fit"))


def written_back(rows: DataFrame, assigned: DataFrame, templates: DataFrame, message: str) -> DataFrame:
    """``rows`` with ``event`` and ``template``, and ``example``: the event's first message by ``log_id``."""
    labelled = rows.join(assigned, "log_id", "left")
    example = labelled.groupBy("event").agg(F.min_by(message, "log_id").alias("example"))
    return labelled.join(templates.select("event", "template"), "event", "left").join(example, "event", "left")
