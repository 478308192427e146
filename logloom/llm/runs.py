"""Problem 2: runs of consecutive same or nearly same events per entity, by pruned dynamic programming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.near import similar_pairs
from logloom.session import staged

#: Dissimilarities and penalties are whole numbers of millionths, so that sums are exact and ties are ties.
UNIT = 1_000_000
#: Cost of a boundary between runs of nearly the same events.
PENALTY = 0.5
#: A price so low that only events of dissimilarity 0 stay together.
STRICT = 1 / UNIT


def same_events(templates: DataFrame) -> DataFrame:
    """``(event_id, event)``: ids whose templates have the same letters in the same order share ``event``.

    ``event`` is the smallest such id. Case and all characters but letters don't matter. A null template
    is like no other; ids are unique, of repeated ones the smallest text counts.
    """
    letters = F.regexp_replace(F.lower("template"), r"\P{L}+", "")
    one = templates.where("event_id is not null").groupBy("event_id").agg(F.min(letters).alias("_letters"))
    named = one.withColumn("_min", F.min("event_id").over(W.partitionBy("_letters")))
    return named.select("event_id", F.when(F.col("_letters").isNull(), F.col("event_id")).otherwise(F.col("_min")).alias("event"))


def near_events(templates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``event_id, near``: what runs an event may be part of, ``near`` being an array of ``struct<event, d>``.

    ``event`` is the smallest id of the same or of a similar template, ``d`` the dissimilarity in millionths:
    0 for templates of the same letters, else the share of the two templates' words that they haven't in
    common, if that is at most ``1 - threshold``. Ids without template come out with themselves only.
    """
    same = same_events(templates)
    text = F.regexp_replace(F.lower("template"), r"\P{L}+", " ")
    one = templates.where("event_id is not null").groupBy("event_id").agg(F.min(text).alias("text"))
    firsts = one.join(same.select(F.col("event").alias("event_id")).distinct(), "event_id", "left_semi")
    alike = similar_pairs(firsts.select(F.lit("template").alias("grp"), F.col("event_id").alias("log_id"), "text"), threshold, 1, with_similarity=True)
    d = F.greatest(F.lit(2), F.round((1 - F.col("similarity")) * UNIT).cast("long"))  # different letters are never quite the same
    one_way = alike.select(F.col("log_id_a").alias("event"), F.col("log_id_b").alias("other"), d.alias("d"))
    both = one_way.unionByName(one_way.select(F.col("other").alias("event"), F.col("event").alias("other"), "d"))
    lists = both.groupBy("event").agg(F.collect_list(F.struct(F.col("other").alias("event"), "d")).alias("_others"))
    own = F.array(F.struct("event", F.lit(0).cast("long").alias("d")))
    return same.join(lists, "event", "left").select("event_id", F.concat(own, F.coalesce("_others", F.array().cast("array<struct<event:bigint,d:bigint>>"))).alias("near"))


def without_redelivered(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Of rows equal in all ``columns`` that with the smallest ``log_id``: ``key, log_id``.

    ``key`` must be a function of ``columns``. Rows are told apart by a 128-bit digest, so texts aren't shuffled.
    """
    text = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in sorted(columns)]
    slim = rows.select(*key, "log_id", F.unhex(F.md5(F.concat_ws("|", *text))).alias("_digest"))
    return slim.groupBy(*key, "_digest").agg(F.min("log_id").alias("log_id")).drop("_digest")


# ---- the dynamic program ------------------------------------------------------------------------

Near = dict[int, dict[int, int]]


class Segmentation:
    """Least cost of segmenting a sequence of (event, count) stretches into runs.

    A run stands for one representative, any event that all of the run's events are near; it costs the sum of
    its rows' dissimilarities to it, a boundary costs ``penalty``. The state is the cost of the best
    segmentation so far that ends in a run of each representative. It is pruned: a representative whose cost
    is at least the least one plus ``penalty`` never leads to a better segmentation than starting a run anew
    there, and one that an event isn't near to ends. So only the few that can still win are kept, whatever the
    length of the runs. Ties: no boundary, then the smaller id.
    """

    def __init__(self, near: Near, penalty: int) -> None:
        self.near, self.penalty = near, penalty

    def run(self, stretches: list[tuple[int, int]], before: dict[int, int] | None) -> tuple[dict[int, int], list[dict[int, int]]]:
        """Costs by representative after the stretches, and where each came from at each step: its predecessor.

        ``before``: costs by representative of what comes before, None at the start of a sequence.
        """
        cost, back = before, []
        for event, n in stretches:
            least = origin = None
            if cost:
                origin = min(cost, key=lambda m: (cost[m], m))
                least = cost[origin] + self.penalty
            step, new = {}, {}
            for m, d in self.near[event].items():
                stay = cost.get(m) if cost else None
                if stay is not None and stay <= least:
                    new[m], step[m] = stay + n * d, m
                elif cost is None:
                    new[m], step[m] = n * d, m
                elif least is not None:
                    new[m], step[m] = least + n * d, origin
            bound = min(new.values()) + self.penalty
            cost = {m: c for m, c in new.items() if c < bound or c == bound - self.penalty}
            back.append({m: step[m] for m in cost})
        return cost, back

    def full(self, stretches: list[tuple[int, int]], before: dict[int, int]) -> dict[int, int]:
        """Like ``run`` without a record of the way."""
        return self.run(stretches, before)[0]

    @staticmethod
    def path(back: list[dict[int, int]], last: int) -> list[int]:
        """Representative of every stretch, from that of the last one; ``[-1]`` is ``last``, one more in front is the predecessor."""
        out = [last]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def best_end(cost: dict[int, int]) -> int:
    """The representative of least cost, of equal ones the smaller."""
    return min(cost, key=lambda m: (cost[m], m))


def linked(near: Near, a: int, b: int) -> bool:
    """Whether two neighbouring events can be in one run: some representative is near both."""
    return a == b or not near[a].keys().isdisjoint(near[b])


# ---- tasks --------------------------------------------------------------------------------------

_PIECES = "part int, ord long, entity long, event long, first_us long, last_us long, first_log_id long, last_log_id long, n long, block int"


class _Part:
    """One task's rows in order, cut into blocks between which no run can go on.

    Blocks that lie within the task are segmented at once. The first and the last one may go on in other
    tasks: their stretches of equal events come out unsegmented (``block`` 0 and 1).
    """

    def __init__(self, part: int, penalty: int) -> None:
        self.part, self.near, self.ordinal = part, {}, 0
        self.dp = Segmentation(self.near, penalty)
        self.first, self.open = True, None

    def stretches(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Stretches of equal events of one entity."""
        who, code, us, log_id = (rows[c].to_numpy() for c in ("entity", "event", "us", "log_id"))
        starts = np.concatenate([[0], np.flatnonzero((who[1:] != who[:-1]) | (code[1:] != code[:-1])) + 1])
        ends = np.concatenate([starts[1:], [len(who)]]) - 1
        events, at = np.unique(code[starts], return_index=True)
        for event, i in zip(events.tolist(), starts[at].tolist(), strict=True):
            if event not in self.near:
                self.near[event] = _listed(event, rows["near"].iat[i])
        return pd.DataFrame({"entity": who[starts], "event": code[starts], "first_us": us[starts], "last_us": us[ends], "first_log_id": log_id[starts], "last_log_id": log_id[ends], "n": ends - starts + 1})

    def add(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Runs of the blocks that a batch completes."""
        if not len(rows):
            return
        new = self.stretches(rows)
        if self.open is not None:
            old = self.open
            if old["entity"].iat[-1] == new["entity"].iat[0] and old["event"].iat[-1] == new["event"].iat[0]:  # one stretch over two batches
                joined = old.iloc[[-1]].copy()
                joined[["last_us", "last_log_id", "n"]] = [[new["last_us"].iat[0], new["last_log_id"].iat[0], old["n"].iat[-1] + new["n"].iat[0]]]
                parts = [old.iloc[:-1], joined, new.iloc[1:]]
            else:
                parts = [old, new]
            new = pd.concat([p for p in parts if len(p)], ignore_index=True)
        who, code = new["entity"].to_numpy(), new["event"].to_numpy()
        events, at = np.unique(code, return_inverse=True)
        pairs, back = np.unique(at[:-1] * len(events) + at[1:], return_inverse=True)
        apart = np.array([not linked(self.near, int(events[p // len(events)]), int(events[p % len(events)])) for p in pairs.tolist()], bool)
        breaks = (who[1:] != who[:-1]) | apart[back]
        bounds = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(new)]])
        if len(bounds) == 2:
            self.open = new
            return
        if self.first:
            yield self._edge(new.iloc[: bounds[1]], 0)
            bounds, self.first = bounds[1:], False
        if len(bounds) > 2:
            yield self._runs(new, bounds[:-1])
        self.open = new.iloc[bounds[-2] :]

    def end(self) -> Iterator[pd.DataFrame]:
        """What is left: a block that other tasks may go on with."""
        if self.open is not None:
            yield self._edge(self.open, 0 if self.first else 1)

    def _edge(self, rows: pd.DataFrame, block: int) -> pd.DataFrame:
        return self._stamped(rows.assign(block=block))

    def _stamped(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(part=self.part, ord=np.arange(self.ordinal, self.ordinal + len(rows)))
        self.ordinal += len(rows)
        return rows[[c.split()[0] for c in _PIECES.split(", ")]]

    def _runs(self, rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        """Runs of whole blocks."""
        code, n = rows["event"].to_numpy(), rows["n"].to_numpy()
        alone = bounds[:-1][np.diff(bounds) == 1]  # blocks of one stretch are runs
        events, at = np.unique(code[alone], return_inverse=True)
        starts, names = [alone], [np.array([best_end(self.near[int(e)]) for e in events], np.int64)[at]]
        longer = np.flatnonzero(np.diff(bounds) > 1)
        for a, b in zip(bounds[longer].tolist(), bounds[longer + 1].tolist(), strict=True):
            path = np.array(segmented(self.dp, list(zip(code[a:b].tolist(), n[a:b].tolist(), strict=True))))
            own = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
            starts.append(a + own)
            names.append(path[own])
        order = np.argsort(np.concatenate(starts), kind="stable")
        return self._stamped(_joined(rows, np.concatenate(starts)[order], np.concatenate(names)[order], int(bounds[-1])).assign(block=None))


def _listed(event: int, text: str | None) -> dict[int, int]:
    """Representatives of an event with their dissimilarity; one without list stands for itself."""
    if not isinstance(text, str):
        return {event: 0}
    return {int(m): int(d) for m, d in (x.split(":") for x in text.split(","))}


def segmented(dp: Segmentation, stretches: list[tuple[int, int]]) -> list[int]:
    """Representative of every stretch of a whole sequence."""
    cost, back = dp.run(stretches, None)
    return dp.path(back, best_end(cost))[1:]


def _joined(rows: pd.DataFrame, starts: np.ndarray, names: np.ndarray, end: int) -> pd.DataFrame:
    """Stretches from each start to the next as one run."""
    ends = np.concatenate([starts[1:], [end]]) - 1
    total = np.concatenate([[0], np.cumsum(rows["n"].to_numpy())])
    take = lambda c, at: rows[c].to_numpy()[at]
    return pd.DataFrame({
        "entity": take("entity", starts), "event": names, "first_us": take("first_us", starts), "last_us": take("last_us", ends),
        "first_log_id": take("first_log_id", starts), "last_log_id": take("last_log_id", ends), "n": total[ends + 1] - total[starts],
    })


def segments(rows: DataFrame, entity: str, event: str, instant: str, near: DataFrame | None = None, penalty: float = PENALTY) -> DataFrame:
    """Runs of consecutive events of every entity, ordered by instant, then ``log_id``.

    Returns ``part, ord`` (the order of all runs), ``entity, event`` (the run's representative), ``first_us,
    last_us, duration_us, first_log_id, last_log_id, n``; runs of one row included. ``near`` has ``event_id`` and
    ``near``, see ``near_events``; an event it lacks is near itself only. The segmentation minimises the rows'
    dissimilarity to their run's representative plus ``penalty`` per boundary, see ``Segmentation``. Rows with a
    null entity, event or instant take no part. Ties in instant are broken by ``log_id``; equal rows are rows.

    Rows are range-partitioned by (entity, instant, log_id), so an entity that holds most rows spans many
    tasks. A block of rows that spans tasks is solved in two rounds: each task gives the least cost between any
    representative at its start and any at its end, these small tables are chained in the tasks' order, which
    fixes the representatives at every border, and each task then finds its own runs between them.
    """
    cents = round(penalty * UNIT)
    slim = rows.select(F.col(entity).cast("long").alias("entity"), F.col(event).cast("long").alias("event"), F.col(instant).cast("long").alias("us"), F.col("log_id").cast("long").alias("log_id")).dropna()
    if near is not None:
        # lists that say no more than the event itself stay behind
        some = near.where((F.size("near") > 1) | (F.col("near")[0]["event"] != F.col("event_id")))
        text = F.array_join(F.transform("near", lambda x: F.concat_ws(":", x["event"], x["d"])), ",")
        slim = slim.join(some.select(F.col("event_id").cast("long").alias("event"), text.alias("near")), "event", "left")
    else:
        slim = slim.withColumn("near", F.lit(None).cast("string"))
    ordered = slim.select("entity", "event", "us", "log_id", "near").repartitionByRange("entity", "us", "log_id").sortWithinPartitions("entity", "us", "log_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = _Part(TaskContext.get().partitionId(), cents)
        for batch in batches:
            for out in own.add(batch):
                yield _with_near(out, own.near)
        for out in own.end():
            yield _with_near(out, own.near)

    pieces = staged(ordered.mapInPandas(cut, _PIECES + ", near string"), "pieces")
    done = pieces.where("block is null").drop("block", "near")
    columns = done.columns
    solved = _solved(pieces.where("block is not null"), cents)
    merged = _merged(solved)
    return done.unionByName(merged.select(*columns)).withColumn("duration_us", F.col("last_us") - F.col("first_us"))


def _with_near(out: pd.DataFrame, near: Near) -> pd.DataFrame:
    """Near lists beside the stretches that are still to be segmented, each event's once."""
    lists: list = [None] * len(out)
    if out["block"].iat[0] is not None:
        seen = set()
        for i, e in enumerate(out["event"].tolist()):
            if e not in seen:
                seen.add(e)
                lists[i] = ",".join(f"{m}:{d}" for m, d in near[e].items())
    return out.assign(near=lists)


def _solved(edges: DataFrame, penalty: int) -> DataFrame:
    """Runs of the blocks at the tasks' borders: ``_PIECES`` with ``goes_on``, whether a run continues the one before in the order."""

    def read(rows: pd.DataFrame) -> tuple[Near, list[tuple[int, int]]]:
        near = {int(e): _listed(e, text) for e, text in zip(rows["event"], rows["near"], strict=True) if isinstance(text, str)}
        return near, list(zip(rows["event"].tolist(), rows["n"].tolist(), strict=True))

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        near, stretches = read(rows)
        dp = Segmentation(near, penalty)
        fresh = dp.run(stretches, None)[0]
        # those before that matter: representatives that the first event is near, and one that stands for all others
        enters = [(m, dp.full(stretches, {m: 0})) for m in sorted(near[stretches[0][0]])] + [(None, {m: c + penalty for m, c in fresh.items()})]
        cells = [(m, o, c) for m, costs in enters for o, c in costs.items()] + [("first", o, c) for o, c in fresh.items()]
        said = json.dumps([list(near[stretches[0][0]]), list(near[stretches[-1][0]]), cells])
        return pd.DataFrame({"part": [rows["part"].iat[0]], "block": [rows["block"].iat[0]], "entity": [rows["entity"].iat[0]], "said": [said]})

    tables = edges.groupBy("part", "block").applyInPandas(table, "part int, block int, entity long, said string")

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """Representatives at each block's borders: ``enter`` (null: the block starts afresh) and ``leave``."""
        rows = rows.sort_values(["part", "block"])
        blocks = []
        for r in rows.itertuples(index=False):
            head, tail, cells = json.loads(r.said)
            blocks.append((r.part, r.block, r.entity, set(head), set(tail), cells))
        groups: list[list] = []
        for b in blocks:
            last = groups[-1][-1] if groups else None
            # a block goes on with the one before if it is the same entity's, is its task's first, and a run can span both
            if last is not None and b[1] == 0 and last[2] == b[2] and not last[4].isdisjoint(b[3]):
                groups[-1].append(b)
            else:
                groups.append([b])
        out = []
        for group in groups:
            cost, ways = None, []
            for _, _, _, _, _, cells in group:
                by: dict[int | str | None, dict[int, int]] = {}
                for m, o, c in cells:
                    by.setdefault(m, {})[o] = c
                if cost is None:
                    cost = by["first"]
                    ways.append(dict.fromkeys(cost))
                    continue
                new, way = {}, {}
                for m in sorted(cost, key=lambda m: (cost[m], m)):
                    for o, c in by.get(m, by[None]).items():
                        if o not in new or cost[m] + c < new[o]:
                            new[o], way[o] = cost[m] + c, m
                cost = new
                ways.append(way)
            leave = best_end(cost)
            for b, way in zip(reversed(group), reversed(ways), strict=True):
                out.append((b[0], b[1], way[leave], leave))
                leave = way[leave]
        done = pd.DataFrame(out, columns=["part", "block", "enter", "leave"])
        return done.assign(enter=pd.array([x[2] for x in out], "Int64"))

    # two rows a task: the one task that chains them sees no more than the number of tasks
    borders = tables.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda rows: chain(rows), "part int, block int, enter long, leave long")

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord").reset_index(drop=True)
        near, stretches = read(rows)
        dp = Segmentation(near, penalty)
        enter, leave = rows["enter"].iat[0], int(rows["leave"].iat[0])
        before = None if pd.isna(enter) else {int(enter): 0}
        path = dp.path(dp.run(stretches, before)[1], leave)
        own = path[1:]
        goes_on = before is not None and own[0] == int(enter)
        starts = np.array([k for k, m in enumerate(own) if k == 0 or m != own[k - 1]])
        runs = _joined(rows, starts, np.array(own)[starts], len(own))
        runs = runs.assign(part=rows["part"].iat[0], ord=rows["ord"].to_numpy()[starts], block=rows["block"].iat[0], goes_on=False)
        runs.loc[0, "goes_on"] = goes_on
        return runs[[*(c.split()[0] for c in _PIECES.split(", ")), "goes_on"]]

    return staged(edges.join(borders, ["part", "block"]).groupBy("part", "block").applyInPandas(finish, _PIECES + ", goes_on boolean"), "edges")


def _merged(runs: DataFrame) -> DataFrame:
    """Runs that go on over borders as one: only a block's first run can go on, and only its last be gone on with."""
    last = F.max("ord").over(W.partitionBy("part", "block"))
    first = F.min("ord").over(W.partitionBy("part", "block"))
    marked = runs.withColumn("_border", (F.col("ord") == last) | (F.col("ord") == first))
    # at most four runs a task: this one window is as small as the number of tasks
    at = W.orderBy("part", "ord")
    grouped = marked.where("_border").withColumn("_g", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(at))
    head = F.min(F.struct("part", "ord", "entity", "event", "first_us", "first_log_id")).alias("_h")
    tail = F.max(F.struct("part", "ord", "last_us", "last_log_id")).alias("_t")
    joined = grouped.groupBy("_g").agg(head, tail, F.sum("n").alias("n"))
    columns = ["part", "ord", "entity", "event", "first_us", "first_log_id"]
    return joined.select(*[f"_h.{c}" for c in columns], "_t.last_us", "_t.last_log_id", "n").unionByName(marked.where("not _border").select(*columns, "last_us", "last_log_id", "n"))
