"""Writing results: formalized logs, parse results, template files, graphs as DOT text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.formal import epoch_seconds
from logloom.functions.tokens import key_layer
from logloom.operators.miners import Mined


def write_formalized(rows: DataFrame, path: str) -> None:
    """CSV with header of ``log_id, time, level, ms_id, message``."""
    rows.select("log_id", "time", "level", "ms_id", "message").write.mode("overwrite").csv(path, header=True, escape='"')


def parse_result(mined: Mined, logs: DataFrame, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """``(event, log_id, time_stamp)`` in order of time, and ``(event, template)``."""
    rows = mined.assignments.join(logs.select("log_id", epoch_seconds(F.col(time)).alias("time_stamp")), "log_id")
    return rows.select("event", "log_id", "time_stamp").orderBy("time_stamp", "log_id"), mined.templates.select("event", "template").dropDuplicates(["event", "template"])


def write_parse_result(mined: Mined, logs: DataFrame, path: str, name: str, time: str = "time") -> None:
    """Two CSV folders: ``name`` and ``name_template``."""
    rows, templates = parse_result(mined, logs, time)
    rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)
    templates.orderBy("event").write.mode("overwrite").csv(f"{path}/{name}_template", header=True, escape='"')


def write_assignment_lists(mined: Mined, logs: DataFrame, path: str) -> None:
    """Templates with counts, the ids of each template in a folder of its own, and the template of each id (0: none)."""
    mined.templates.select(F.concat_ws("\t", F.col("event").cast("string"), F.concat_ws(" ", F.col("n").cast("string"), "template")).alias("value")).write.mode("overwrite").text(f"{path}/templates")
    mined.assignments.repartition("event").sortWithinPartitions("event", "log_id").write.mode("overwrite").partitionBy("event").csv(f"{path}/ids")
    listed = logs.select("log_id").join(mined.assignments, "log_id", "left").select("log_id", F.coalesce("event", F.lit(0)).alias("event"))
    listed.orderBy("log_id").write.mode("overwrite").csv(f"{path}/list", sep="\t")


def _tree(rows: DataFrame) -> DataFrame:
    """Edges ``src, dst, weight`` of a tree from ``n`` and the labels ``p`` from the root to a leaf; equal beginnings are one path."""
    nodes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), " / "))
    paths = rows.select("n", nodes.alias("s"))
    edges = paths.select("n", F.explode(F.transform(F.slice("s", 2, F.size("s") - 1), lambda d, i: F.struct(F.get("s", i).alias("src"), d.alias("dst")))).alias("e"))
    return edges.groupBy("e.src", "e.dst").agg(F.sum("n").alias("weight"))


def _length(words: Column) -> Column:
    return F.concat(F.lit("length "), F.size(words).cast("string"))


def template_tree(templates: DataFrame, depth: int = 3) -> DataFrame:
    """Edges ``src, dst, weight`` of the tree of template lengths and leading tokens, for drawing, as fixed-depth trees place them."""
    words = F.split("template", " ")
    return _tree(templates.select("n", F.concat(F.array(F.lit("root"), _length(words)), F.slice(words, 1, depth)).alias("p")))


def bucket_tree(templates: DataFrame) -> DataFrame:
    """Edges of the tree of lengths, key layers, keys and templates, as signature buckets place them."""
    key = key_layer(F.split("template", " "))
    layer = F.element_at(F.array(F.lit("first"), F.lit("last"), F.lit("none")), key["pos"] % 3 + 1)
    path = F.array(F.lit("root"), _length(F.split("template", " ")), layer, F.when(key["key"] == "", F.lit("*")).otherwise(key["key"]), F.col("template"))
    return _tree(templates.select("n", path.alias("p")))


def signature_tree(templates: DataFrame) -> DataFrame:
    """Edges of the prefix tree of all templates' tokens, as signatures are looked up."""
    return _tree(templates.select("n", F.concat(F.array(F.lit("root")), F.split("template", " ")).alias("p")))


def cell_graph(templates: DataFrame) -> DataFrame:
    """Edges from lengths to templates and on to the output cells that the templates were joined in; a cell lists its templates, one a line."""
    each = templates.select("n", F.concat(F.lit("cell "), F.col("event").cast("string")).alias("cell"), F.explode(F.split("template", "\n")).alias("t"))
    ways = each.select("n", F.explode(F.array(F.struct(_length(F.split("t", " ")).alias("src"), F.col("t").alias("dst")), F.struct(F.col("t").alias("src"), F.col("cell").alias("dst")))).alias("e"))
    return ways.groupBy("e.src", "e.dst").agg(F.sum("n").alias("weight"))


def labelled_flow(edges: DataFrame, templates: DataFrame, event: str = "event", text: str = "template") -> DataFrame:
    """Workflow edges with the templates of their keys, by event, not by position."""
    a, b = [templates.select(F.col(event).alias(f"_{x}"), F.col(text).alias(f"{x}_template")) for x in ("src", "dst")]
    return edges.join(a, F.col("src") == F.col("_src"), "left").join(b, F.col("dst") == F.col("_dst"), "left").drop("_src", "_dst")
