"""Structured Streaming: files to records, fields and events of any miner; windowed counts."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.functions.formal import REMOVED_STREAM, line_message, line_stamp
from logloom.functions.similarity import ANY
from logloom.functions.tokens import key_layer, mask, tokenize
from logloom.operators.miners import EntropyBucket, FirstFit, FixedTree, Gini, Machine, Plain, Pointer, Signatures


#: Per miner the grouping that keeps it exact, and its machine for one group.
STREAMED: dict[str, tuple[str, Callable[[str], Machine]]] = {
    "bsg": ("bucket", lambda key: Plain(EntropyBucket(0.7, 20, True), key)),
    "bsgi": ("pos", lambda key: Gini(0.7, 20, True)),
    "drain": ("length", lambda key: Plain(FixedTree(3, 10, 0.5, True))),
    "draga": ("length", lambda key: Pointer(120, True)),
    "spell": ("all", lambda key: Plain(Signatures(0.5, True))),
    "first_fit": ("length", lambda key: Plain(FirstFit(0.5))),
}


def mine_stream(messages: DataFrame, miner: str = "bsg", ids: tuple[str, ...] = ("log_id",), tokens: str = "tokens", make: Callable[[str], Machine] | None = None) -> DataFrame:
    """``ids``, ``grp, key, cluster, template`` of every message of a stream, the template as of its micro-batch.

    ``miner`` is one of ``STREAMED``; ``make`` gives another machine for its groups. State is the group's machine.
    Clusters are those of the batch miner as long as rows of a group arrive in the order of ``ids`` across
    micro-batches; inside a micro-batch they are sorted. What batch miners do over all groups at the end (the
    refinement of ``bsgi``, the joining of cells of ``draga``, one number for equal texts) is left to a batch over
    the result. Append mode.
    """
    grouping, own = STREAMED[miner]
    make = make or own
    layer = key_layer(F.col(tokens), ANY if miner == "bsgi" else "")
    grp = {"bucket": F.concat_ws("|", layer["pos"], layer["key"]), "pos": layer["pos"].cast("string"), "length": F.size(tokens).cast("string"), "all": F.lit("")}[grouping]
    rows = messages.where(F.size(tokens) > 0).select(*ids, F.col(tokens).alias("tokens"), grp.alias("grp"), layer["key"].alias("key"))
    columns = [*ids, "grp", "key", "cluster", "template"]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(list(ids), kind="stable")
        machine = pickle.loads(state.get[0]) if state.exists else make(pdf["key"].iat[0])
        placed = [machine.step(list(t), key)[:2] for t, key in zip(pdf["tokens"], pdf["key"], strict=True)]
        texts = {(b, c): " ".join(template) for b, c, _, template, _ in machine.end()}
        state.update((pickle.dumps(machine),))
        out = pdf[list(ids)].assign(grp=group[0], key=pdf["key"], cluster=[c for _, c in placed], template=[texts[x] for x in placed])
        yield out[columns]

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids) + ", grp string, key string, cluster long, template string"
    return rows.groupBy("grp").applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def mine_bsg_stream(messages: DataFrame, tokens: str = "tokens", order: str = "log_id") -> DataFrame:
    """``mine_stream`` by signature buckets."""
    return mine_stream(messages, "bsg", (order,), tokens)


_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", re.ASCII)


def _dated(text: str) -> bool:
    if not _DATE.fullmatch(text):
        return False
    try:
        datetime.strptime(re.sub(r":6[01]$", ":00", text), "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return False
    return True


def records_of(text: str, compat: bool = True) -> list[str]:
    """Records of one file's text, as ``operators.assembly.stream_records`` makes them."""
    lines = [x for x in re.split(r"(?<=\n)", text) if x]
    out: list[str] = []
    for i, line in enumerate(lines):
        if i == 0 or (len(line) >= 20 and _dated(line[:19])):
            out.append(line)
        else:
            out[-1] += line
    done = out[:-1] if compat else out
    return [re.sub(r"\(.*\)", "", re.sub(r"\{.*\}", "", x.replace("\n", ""), flags=re.DOTALL), flags=re.DOTALL) for x in done]


def read_record_stream(spark: SparkSession, folder: str, compat: bool = True, files_per_batch: int = 100) -> DataFrame:
    """``file, record, time, message`` of a stream of files below a folder, records numbered from 1 per file.

    A file is read once it is there, as one value; its records are those of ``records_of``, its fields those of
    the streaming formalizer. Files of a micro-batch come in order of path.
    """
    texts = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True, recursiveFileLookup=True)
    named = texts.select(F.col("_metadata.file_path").alias("file"), "value").where(~F.col("file").endswith("/.DS_Store"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, k, t) for f, text in zip(batch["file"], batch["value"], strict=True) for k, t in enumerate(records_of(text, compat), 1)]
            yield pd.DataFrame(rows, columns=["file", "record", "text"])

    records = named.mapInPandas(split, "file string, record long, text string")
    return records.select("file", "record", line_stamp(F.col("text")).alias("time"), line_message(F.col("text"), REMOVED_STREAM).alias("message"))


def parse_stream(spark: SparkSession, folder: str, miner: str = "bsgi", rules: str | list[tuple[str, str]] = "paas", compat: bool = True) -> DataFrame:
    """Files of a folder to events as they come: records, fields, masked tokens, and any of the streamed miners.

    ``file, record`` name a message.
    """
    records = read_record_stream(spark, folder, compat)
    return mine_stream(records.withColumn("tokens", tokenize(mask(F.col("message"), rules))), miner, ("file", "record"))


def assemble_stream(lines: DataFrame, source: str = "source", order: str = "line_no", line: str = "line", start: str = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}") -> DataFrame:
    """``source, record, text`` of a stream of lines: a record comes out when the next one of its source starts.

    So the last record of each source stays open, as long as the stream runs.
    """
    rows = lines.select(F.col(source).cast("string").alias("source"), F.col(order).cast("long").alias("ord"), F.coalesce(line, F.lit("")).alias("line"), F.col(line).rlike(start).alias("starts"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, text = state.get if state.exists else (0, None)
        out = []
        for _, row in pd.concat(list(batches)).sort_values("ord", kind="stable").iterrows():
            if row["starts"]:
                if text is not None:
                    out.append((group[0], n, text))
                n, text = n + 1, row["line"]
            elif text is not None:
                text = f"{text} {row['line']}"
        state.update((n, text))
        yield pd.DataFrame(out, columns=["source", "record", "text"])

    return rows.groupBy("source").applyInPandasWithState(step, "source string, record long, text string", "n long, text string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, event: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``start, event, n`` by tumbling windows of event time; rows later than ``late`` are left out."""
    rows = events.select(F.col(time).cast("timestamp").alias("_t"), F.col(event).alias("event")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", window), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")
