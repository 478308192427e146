"""Next-key model by back-off over key windows, anomalies by top-g, and workflow graphs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Contexts of a workflow model that are taken to the driver at most.
MAX_CONTEXTS = 200_000
#: States of walks that are visited for a workflow's edges at most.
MAX_STATES = 2_000_000


def transition_probabilities(windows: DataFrame, length: int, keys: str = "keys") -> DataFrame:
    """``context, next, n, p``: how often a key follows the ``length`` keys before it, over all windows."""
    rows = windows.select(F.slice(keys, 1, length).alias("context"), F.col(keys)[length].alias("next"))
    counts = rows.groupBy("context", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("context")))


def back_off(windows: DataFrame, length: int, keys: str = "keys") -> DataFrame:
    """Transition probabilities of the last ``length``, ``length - 1``, … 0 keys, with ``size``."""
    out = None
    for size in range(length, -1, -1):
        tail = windows.select(F.slice(keys, length - size + 1, size + 1).alias("keys"))
        part = transition_probabilities(tail, size).withColumn("size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


def save_model(model: DataFrame, path: str) -> None:
    """Write a back-off model as a Parquet table."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """Read a back-off model."""
    return spark.read.parquet(path)


def predicted(model: DataFrame, windows: DataFrame, length: int, key: list[str], keys: str = "keys") -> DataFrame:
    """Probabilities of all next keys for each window: those of the longest context that the model knows."""
    asked = windows.select(*key, F.col(keys), F.explode(F.sequence(F.lit(0), F.lit(length))).alias("size")).withColumn("context", F.slice(F.col(keys), F.lit(length + 1) - F.col("size"), F.col("size")))
    met = asked.join(model, ["size", "context"])
    longest = F.max("size").over(W.partitionBy(*key))
    return met.withColumn("_l", longest).where("size = _l").select(*key, F.col(keys)[length].alias("actual"), "next", "p")


def top_g(scores: DataFrame, key: list[str], g: int) -> DataFrame:
    """``key, label``: 1 (anomaly) if the actual key is not among the ``g`` likeliest; ties go to the smaller key."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("p"), "next"))
    hit = scores.withColumn("_r", rank).groupBy(*key).agg(F.max(F.when((F.col("_r") <= g) & (F.col("next") == F.col("actual")), 1).otherwise(0)).alias("_hit"))
    return hit.select(*key, (1 - F.col("_hit")).alias("label"))


def normal_share(labels: DataFrame) -> DataFrame:
    """``accuracy``: share of windows without anomaly."""
    return labels.agg(F.avg((F.col("label") == 0).cast("double")).alias("accuracy"))


@dataclass
class Workflow:
    """Workflow being built: the keys so far and the edges ``(context, next, p)`` taken."""

    keys: list[int]
    edges: list[tuple[tuple[int, ...], int, float]]


class WorkflowBuilder:
    """Extends a seed along likely next keys; branches where none is near certain, stops at loops.

    A next key of probability above ``sure`` extends the flow. Otherwise the context is lengthened to the
    left, up to ``longest`` keys; if it can't be, every key of at least ``least`` starts a branch. A key that
    occurred before opens a loop, which is finished when the stretch since then has come once more. Flows
    end unfinished beyond ``most`` keys. ``table`` maps contexts to ``(key, p)``, likeliest first; unknown
    contexts fall back to shorter ones.
    """

    def __init__(self, table: dict[tuple[int, ...], list[tuple[int, float]]], sure: float = 0.8, least: float = 0.2, longest: int = 15, most: int = 30, width: int = 2, max_flows: int = 1000) -> None:
        self.table, self.sure, self.least, self.longest, self.most, self.width, self.max_flows = table, sure, least, longest, most, width, max_flows
        self.finished: list[Workflow] = []

    def build(self, seed: list[int]) -> list[Workflow]:
        """All finished flows from a seed, in the order found; more than ``max_flows`` are refused."""
        todo = [(Workflow(list(seed), []), self.width, 0, 0, -1)]
        while todo:
            flow, width, start, distance, index = todo.pop()
            if len(flow.keys) > self.most:
                continue
            for wide, at, key, p in reversed(self._moves(flow.keys, width, start)):
                if (loop := self._loop(flow.keys, key, distance, index)) is None:
                    self.finished.append(flow)
                    if len(self.finished) > self.max_flows:
                        raise ValueError(f"more than {self.max_flows} workflows")
                else:
                    edge = (tuple(flow.keys[at : at + wide]), key, p)
                    todo.append((Workflow([*flow.keys, key], [*flow.edges, edge]), wide, at + 1, *loop))
        return self.finished

    def edges(self, seed: list[int]) -> set[tuple[tuple[int, ...], int, float]]:
        """Edges ``(context, next, p)`` of all finished flows from a seed, without listing the flows.

        Walks of one length that can't differ any more are one state. Those of one length are extended
        together, and a state's edges count once a flow finishes after it. That ends when no walk goes on or
        when every edge has been met that walks could take at all; more than ``MAX_STATES`` states are refused.
        """
        possible = self._possible(seed)
        found: set[tuple[tuple[int, ...], int, float]] = set()
        before: dict[tuple, list] = {}
        layer, states = {self._state(tuple(seed), self.width, 0, 0, -1): None}, 0
        for _ in range(len(seed), self.most + 1):
            after: dict[tuple, None] = {}
            ends = []
            for state in layer:
                _, keys, width, start, distance, index = state
                for wide, at, key, p in self._moves(keys, width, start):
                    if (loop := self._loop(keys, key, distance, index)) is None:
                        ends.append(state)
                        continue
                    step = self._state((*keys, key), wide, at + 1, *loop, state[0] + 1)
                    after[step] = None
                    before.setdefault(step, []).append((state, (tuple(keys[at : at + wide]), key, p)))
            while ends:
                for state, edge in before.pop(ends.pop(), ()):
                    found.add(edge)
                    ends.append(state)
            states += len(after)
            if found == possible or not after:
                break
            if states > MAX_STATES:
                raise ValueError(f"more than {MAX_STATES} states of walks, {len(found)} of at most {len(possible)} edges met")
            layer = after
        return found

    def _state(self, keys: tuple[int, ...], width: int, start: int, distance: int, index: int, n: int = 0) -> tuple:
        """What a walk's future depends on: keys since the last place of each, of the loop and of the longest context."""
        last = {k: i for i, k in enumerate(keys)}
        cut = max(0, min([*last.values(), start - self.longest - 1, *([index] if index >= 0 else [])]))
        return n, keys[cut:], width, start - cut, distance, index if index < 0 else index - cut

    def _possible(self, seed: list[int]) -> set[tuple[tuple[int, ...], int, float]]:
        """Edges of all walks from a seed if loops didn't finish them: no others can be in a flow."""
        found = set()
        layer = {(tuple(seed), self.width, 0)}
        for _ in range(len(seed), self.most + 1):
            after = set()
            for keys, width, start in layer:
                for wide, at, key, p in self._moves(keys, width, start):
                    found.add((tuple(keys[at : at + wide]), key, p))
                    cut = max(0, at + 1 - self.longest - 1)
                    after.add(((*keys, key)[cut:], wide, at + 1 - cut))
            layer = after
        return found

    def _moves(self, keys: Sequence[int], width: int, start: int) -> list[tuple[int, int, int, float]]:
        """Width and start of the context, key and probability of each next step: one near certain, or all branches."""
        while start + width <= len(keys):
            options = self._next(tuple(keys[start : start + width]))
            if not options:
                break
            if options[0][1] > self.sure:
                return [(width, start, *options[0])]
            if width > self.longest or start <= 0:
                return [(self.width, len(keys) - self.width, *o) for o in options if o[1] >= self.least]
            width, start = width + 1, start - 1
        return []

    def _next(self, context: tuple[int, ...]) -> list[tuple[int, float]]:
        while context and context not in self.table:
            context = context[1:]
        return self.table.get(context, [])

    def _loop(self, keys: Sequence[int], key: int, distance: int, index: int) -> tuple[int, int] | None:
        """Distance and index of the loop after a next key, None where it's finished."""
        if key in keys and index == -1:
            index = len(keys) - 1 - keys[::-1].index(key)
            return len(keys) - index, index + 1
        if key in keys and key == keys[index]:
            return None if distance == 1 else (distance - 1, index + 1)
        return 0, -1


def workflow_edges(windows: DataFrame, length: int, seed: list[int], keys: str = "keys") -> DataFrame:
    """``context, next, p``: each edge of the workflows from a seed once, by the back-off model over the windows.

    The model's contexts go to the driver: they are few where workflows are meant to be read, and more than
    ``MAX_CONTEXTS`` are refused. The graph itself is walked there; see ``WorkflowBuilder.edges``.
    """
    model = back_off(windows, length, keys).select("context", "next", "p")
    rows = model.limit(MAX_CONTEXTS + 1).collect()
    if len(rows) > MAX_CONTEXTS:
        raise ValueError(f"more than {MAX_CONTEXTS} contexts")
    table: dict[tuple[int, ...], list[tuple[int, float]]] = {}
    for r in sorted(rows, key=lambda r: (-r["p"], r["next"])):
        table.setdefault(tuple(r["context"]), []).append((r["next"], r["p"]))
    edges = WorkflowBuilder(table, width=min(2, length), longest=length).edges(seed)
    out = [(",".join(map(str, c)), k, p) for c, k, p in sorted(edges)]
    return windows.sparkSession.createDataFrame(out, "context string, next long, p double")
