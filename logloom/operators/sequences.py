"""Sequences of events: prediction by similar sequences, key windows, deploy statistics."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.graph import STRETCH
from logloom.operators.ordering import positions
from logloom.session import staged


def predict_next(train: DataFrame, target: DataFrame, k: int = 5, n: int = 3) -> DataFrame:
    """``target, item, log_score``: the ``n`` likeliest next items of each target sequence.

    Both have ``seq, pos, item`` (positions from 0, none left out). Of a target's last ``k`` items those that training
    knows must all occur in a similar sequence (any sequence is similar if none is known). After the last
    occurrence of the target's last item, never at a sequence's first place, items not among the ``k``
    score ``1 + 1 / similar + 0.001 / distance``; scores of repeats multiply. Ties go to the smaller item.

    Pairs of a target and a similar sequence are never rows: they grow with the product of both. Training travels
    packed, once to every block of targets; a block's task finds its targets' similar sequences and adds up the
    scores. Training of more than ``PACK_ROWS`` rows is cut too; then similar sequences are counted first.
    """
    codes = positions(train.where("item is not null").select("item").distinct(), "item", name="_code")
    ends_at = target.groupBy(F.col("seq").alias("_seq")).agg(F.max("pos").alias("_end"))
    asked = target.join(ends_at, F.col("seq") == F.col("_seq")).where(F.col("pos") > F.col("_end") - k).select("seq", "pos", "item").join(codes, "item", "left")
    aims = asked.groupBy("seq").agg(F.array_sort(F.collect_set("_code")).alias("own"), F.max_by("_code", "pos").alias("last")).where("last is not null")
    aims = staged(aims.select(F.col("seq").alias("target"), "own", "last"), "aims")
    packed = staged(_packed(train.where("seq is not null").join(codes, "item", "left").select("seq", "pos", F.coalesce("_code", F.lit(-1)).cast("int").alias("code"))), "packed")
    asks = aims.select("own", "last").distinct()
    number = asks.count()
    blocks = max(min(32, -(-number // 256)), -(-number // 8192), 1)
    parts = max(1, -(-(packed.agg(F.sum("rows")).first()[0] or 0) // PACK_ROWS))

    def over_cells(asks: DataFrame, count: bool) -> DataFrame:
        """One task for each block of targets and part of training; targets of one set of items are in one block."""
        cell = F.pmod(F.hash("own"), F.lit(blocks)) * parts
        left = asks.withColumn("_cell", F.explode(F.sequence(cell, cell + parts - 1)))
        here = F.pmod(F.col("part"), F.lit(parts))
        right = packed.withColumn("_cell", F.explode(F.sequence(here, here + (blocks - 1) * parts, F.lit(parts))))
        left, right = (x.repartition(3 * blocks * parts, "_cell").groupBy("_cell") for x in (left, right))
        return left.cogroup(right).applyInPandas(_counts if count else _scores(n if parts == 1 else None), "own array<long>, similar long" if count else "own array<long>, last long, code long, log_score double")

    if parts > 1:
        many = staged(over_cells(asks.select("own").distinct(), True).groupBy("own").agg(F.sum("similar").alias("similar")), "similar")
        total = over_cells(asks.join(many, "own"), False).groupBy("own", "last", "code").agg(F.sum("log_score").alias("log_score"))
    else:
        total = over_cells(asks.withColumn("similar", F.lit(None).cast("long")), False)
    rank = F.row_number().over(W.partitionBy("own", "last").orderBy(F.desc(F.round("log_score", 9)), "code"))
    best = total.withColumn("_r", rank).where(F.col("_r") <= n).join(codes, F.col("code") == F.col("_code"))
    return aims.join(best, ["own", "last"]).select("target", "item", "log_score")


#: Rows of training that a task holds at once when it predicts, in 4 bytes each and an index of some 40.
PACK_ROWS = 6_000_000
#: Places after a target's last item that are scored at once.
_AT_ONCE = 1_000_000


def _packed(rows: DataFrame) -> DataFrame:
    """``part, ord, rows, codes, starts``: ``seq, pos, code`` by sequence and place, many a row; a sequence lies in one part."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for k, batch in enumerate(b for b in batches if len(b)):
            seq = batch["seq"].to_numpy()
            new = np.concatenate([[last is None or seq[0] != last], seq[1:] != seq[:-1]])
            last = seq[-1]
            codes, starts = (zlib.compress(x.astype(np.int32).tobytes(), 1) for x in (batch["code"].to_numpy(), np.flatnonzero(new)))
            yield pd.DataFrame({"part": [part], "ord": [k], "rows": [len(batch)], "codes": [codes], "starts": [starts]})

    return rows.repartition("seq").sortWithinPartitions("seq", "pos").mapInPandas(pack, "part int, ord int, rows long, codes binary, starts binary")


class _Training:
    """Sequences in one array of codes, with the last place of each of some items in each sequence that has it."""

    def __init__(self, packed: pd.DataFrame, wanted: np.ndarray) -> None:
        codes, starts, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        for r in packed.sort_values(["part", "ord"]).itertuples(index=False):
            codes.append(np.frombuffer(zlib.decompress(r.codes), np.int32))
            starts.append(np.frombuffer(zlib.decompress(r.starts), np.int32).astype(np.int64) + at)
            at += r.rows
        self.codes, self.starts = np.concatenate(codes), np.concatenate(starts)
        self.ends = np.append(self.starts[1:], at) - 1
        self.most = int(self.codes.max(initial=-1))
        held = np.zeros(max(self.most, int(wanted.max(initial=-1))) + 2, bool)
        held[wanted] = True
        places = np.flatnonzero(held[self.codes])  # an item without code is -1, the last cell
        seqs = np.searchsorted(self.starts, places, side="right") - 1
        order = np.argsort(self.codes[places], kind="stable")
        items, seqs, places = self.codes[places][order], seqs[order], places[order]
        final = np.append((items[1:] != items[:-1]) | (seqs[1:] != seqs[:-1]), True)[: len(items)]
        items, self.seqs, self.places = items[final], seqs[final], places[final]
        self.of = {int(c): slice(a, b) for c, a, b in zip(wanted, np.searchsorted(items, wanted), np.searchsorted(items, wanted, side="right"), strict=True)}

    def similar(self, own: list[int]) -> np.ndarray:
        """Sequences that hold all items."""
        first, *others = sorted(own, key=lambda c: self.of[c].stop - self.of[c].start)
        found = self.seqs[self.of[first]]
        for c in others:
            held = self.seqs[self.of[c]]
            at = np.searchsorted(held, found)
            found = found[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == found)] if len(held) else held
        return found

    def scores(self, own: list[int], last: int, found: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
        """Items after the last place of ``last`` in the sequences ``found``, and the sums of their logarithms of scores."""
        here = self.of[last]
        # scores multiply beyond what a double holds, so their logarithms are added
        at = self.places[here][np.searchsorted(self.seqs[here], found)]
        some = (at > self.starts[found]) & (at < self.ends[found])
        at, length = at[some], (self.ends[found] - at)[some] if len(found) else at
        before = np.cumsum(length)
        total, met = np.zeros(self.most + 1), np.zeros(self.most + 1, bool)
        free = np.ones(self.most + 2, bool)
        free[[c for c in own if c <= self.most]] = False
        free[-1] = False
        bounds = [0, *(np.flatnonzero(np.diff(before // _AT_ONCE)) + 1).tolist(), len(at)] if len(at) else [0]
        for a, b in zip(bounds, bounds[1:], strict=False):
            heads = before[a:b] - length[a:b] - (before[a - 1] if a else 0)
            rows = np.arange(length[a:b].sum()) + np.repeat(at[a:b] + 1 - heads, length[a:b])
            items = self.codes[rows]
            kept = free[items]
            distance = np.cumsum(kept)
            distance -= np.repeat((distance[heads] - kept[heads]), length[a:b])
            items, distance = items[kept], distance[kept]
            if not len(items):
                continue
            logs = np.log(1 + 1 / similar + 0.001 / np.arange(1, distance.max() + 1))
            total += np.bincount(items, logs[distance - 1], len(total))
            met[items] = True
        items = np.flatnonzero(met)
        return items, total[items]


def _counts(asks: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
    """Similar sequences of each set of items."""
    training = _Training(packed, np.unique(np.concatenate([np.empty(0, np.int64), *asks["own"]])))
    many = [len(training.similar(own.tolist())) for own in asks["own"]]
    return pd.DataFrame({"own": asks["own"].astype(object), "similar": np.array(many, np.int64)})


def _scores(n: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores of all next items or, with ``n``, of those that can be among the ``n`` best."""

    def run(asks: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        training = _Training(packed, np.unique(np.concatenate([np.empty(0, np.int64), *asks["own"]])))
        out = [(np.empty(0, np.int64), np.empty(0))]
        for own, last, similar in asks[["own", "last", "similar"]].itertuples(index=False):
            own = own.tolist()
            found = training.similar(own)
            items, scores = training.scores(own, int(last), found, len(found) if pd.isna(similar) else int(similar)) if len(found) else out[0]
            if n is not None and len(items) > n:  # near ties are for the ranking to decide
                best = scores >= np.partition(scores, -n)[-n] - 1e-8
                items, scores = items[best], scores[best]
            out.append((items, scores))
        sizes = [len(x) for x, _ in out[1:]]
        return pd.DataFrame({
            "own": pd.Series(asks["own"].repeat(sizes).to_list(), dtype=object), "last": asks["last"].repeat(sizes).to_numpy(),
            "code": np.concatenate([x for x, _ in out]), "log_score": np.concatenate([x for _, x in out]),
        })

    return run


def placed(rows: DataFrame, by: str, *order: str, name: str = "pos") -> DataFrame:
    """``rows`` plus ``name``, a row's place from 0 among those of its ``by`` in order, and ``_rn``, its place among all.

    By exact positions in the order of all rows: an entity that holds most of them spans many tasks.
    """
    ranked = positions(rows.where(F.col(by).isNotNull()), by, *order, name="_rn")
    first = ranked.groupBy(F.col(by).alias("_by")).agg(F.min("_rn").alias("_first"))
    return ranked.join(first, F.col(by) == F.col("_by")).withColumn(name, F.col("_rn") - F.col("_first")).drop("_by", "_first")


def key_windows(series: DataFrame, length: int, by: str, order: str, key: str, compat: bool = True) -> DataFrame:
    """``by, pos, keys``: sliding windows of ``length + 1`` keys; the last one is dropped (``compat``), as training always did.

    Windows are read off stretches of the order of all rows, each with the few rows after it.
    """
    rows = placed(series.select(by, order, key), by, order)
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    k = F.floor(F.col("_rn") / STRETCH)
    own = F.struct(k.alias("k"), F.lit(True).alias("own"))
    both = F.array(own, F.struct((k - 1).alias("k"), F.lit(False).alias("own")))
    spread = rows.withColumn("_s", F.explode(F.when((F.col("_rn") % STRETCH < length) & (k > 0), both).otherwise(F.array(own))))
    ahead = F.collect_list(key).over(W.partitionBy("_s.k").orderBy("_rn").rowsBetween(0, length))
    full = spread.withColumn("keys", ahead).where("_s.own").join(counts, F.col(by) == F.col("_by"))
    return full.where(F.col("pos") < F.col("_n") - length - (1 if compat else 0)).select(by, F.col("pos").cast("int").alias("pos"), "keys")


def train_flag(pos: Column, count: Column, rate: float) -> Column:
    """Whether a window is among the first ``round(rate * count)``, halves to even."""
    return pos < F.bround(count * rate)


def shuffled(rows: DataFrame, seed: int = 42, n: int | None = None) -> DataFrame:
    """The rows in random order, or ``n`` of them taken at random; the same for the same seed and partitioning."""
    mixed = rows.orderBy(F.rand(seed))
    return mixed if n is None else mixed.limit(n)


def normalised(keys: Column) -> Column:
    """Each key relative to the first, less 1; null where the first is 0."""
    return F.transform(keys, lambda x: F.try_divide(x.cast("double"), keys[0].cast("double")) - 1)


def document_frequency(rows: DataFrame, group: str, event: str) -> DataFrame:
    """``event, frequency``: in how many groups an event occurs."""
    return rows.groupBy(F.col(event).alias("event")).agg(F.countDistinct(group).alias("frequency"))


def frequency_histogram(rows: DataFrame, group: str, event: str) -> DataFrame:
    """``frequency, n_events, events``: the events of each document frequency."""
    by = document_frequency(rows, group, event).groupBy("frequency")
    return by.agg(F.count("*").alias("n_events"), F.array_join(F.array_sort(F.collect_list(F.col("event").cast("string"))), ",").alias("events"))


def first_appearances(rows: DataFrame, group: str, event: str, order: str) -> DataFrame:
    """The first row of each event in each group."""
    return rows.groupBy(F.col(group).alias("_a"), F.col(event).alias("_b")).agg(F.min_by(F.struct(*rows.columns), order).alias("_first")).select("_first.*")


def aligned(rows: DataFrame, group: str, event: str, order: str, frequencies: list[int]) -> DataFrame:
    """First appearances of the events whose document frequency is one of ``frequencies``."""
    kept = document_frequency(rows, group, event).where(F.col("frequency").isin(frequencies)).select(F.col("event").alias(event))
    return first_appearances(rows.join(kept, event), group, event, order)
