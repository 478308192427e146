"""Problem 5: ordered event patterns that many entities share, gaps allowed, by a position-coded prefix tree."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import staged

#: Events of one chunk of sequences.
CHUNK = 16_384
#: Bits of the filter of frequent pairs that every task gets, whatever the number of pairs.
FILTER_BITS = 1 << 22


class PrefixTree:
    """Suffixes of the sequences of many entities merged into one compressed prefix tree with counts.

    The suffixes, cut at the greatest reach of a pattern, are sorted by their events. A node of depth d is a
    block of rows equal in their first d events, whatever their entities; the block's first and last row are
    its position code: a node is an ancestor of another exactly if its block holds the other's. ``links[d]``
    are the first rows of the nodes of depth d in order, so the header links of a node's descendants are a
    slice of it. ``counts[d]`` are the entities below each node. Chains without branches cost no nodes of their
    own but one row. Patterns are mined from projections, lists of nodes of this one tree; it is never rebuilt.
    """

    def __init__(self, entity: np.ndarray, event: np.ndarray, own: int, depth: int) -> None:
        suffixes = _suffixes(entity, event, own, depth)
        order = np.lexsort((entity[:own], *suffixes.T[::-1]))
        self.events, self.entities = suffixes[order], entity[:own][order]
        differs = np.ones(self.events.shape, bool)
        if own:
            differs[1:] = np.logical_or.accumulate(self.events[1:] != self.events[:-1], axis=1)
        self.size = own
        self.links, self.ends, self.labels, self.counts, self.starts, self.members = [], [], [], [], [], []
        for d in range(depth):
            first = np.flatnonzero(differs[:, d])
            node = np.cumsum(differs[:, d]) - 1
            # entities of each node, each once, as slices of one array
            pairs = np.unique(np.stack([node, self.entities]), axis=1) if own else np.zeros((2, 0), np.int64)
            counts = np.bincount(pairs[0], minlength=len(first))
            self.links.append(first)
            self.ends.append(np.append(first[1:], own))
            self.labels.append(self.events[first, d])
            self.counts.append(counts)
            self.starts.append(np.concatenate([[0], np.cumsum(counts)]))
            self.members.append(pairs[1])

    def below(self, depth: int, nodes: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Descendants at depth ``at`` of nodes of a lesser depth: which of the nodes each is below, and its number."""
        lo = np.searchsorted(self.links[at], self.links[depth][nodes])
        hi = np.searchsorted(self.links[at], self.ends[depth][nodes])
        return np.repeat(np.arange(len(nodes)), hi - lo), _ranges(lo, hi)

    def entities_of(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entities below nodes of a depth: which of the nodes each is below, and the entity."""
        lo, hi = self.starts[depth][nodes], self.starts[depth][nodes + 1]
        return np.repeat(np.arange(len(nodes)), hi - lo), self.members[depth][_ranges(lo, hi)]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one after another."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def _suffixes(entity: np.ndarray, event: np.ndarray, own: int, length: int) -> np.ndarray:
    """The next ``length`` events of the same entity from each of the first ``own`` positions; -1: none left."""
    n = len(event)
    out = np.full((own, length), -1, np.int64)
    for k in range(length):
        m = min(own, n - k)
        if m > 0:
            out[:m, k] = np.where(entity[k : k + m] == entity[:m], event[k : k + m], -1)
    return out


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bit of a pair of events in the filter."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64) % FILTER_BITS


def _mined(tree: PrefixTree, ids: np.ndarray, sizes: tuple[int, int], max_gap: int, wanted: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Patterns of each size, their entities, each once a pattern: ``(patterns, which, entity)`` by size.

    A projection holds, for every pattern so far, the nodes its last event was found at, by depth. Each is
    extended along the header links: the nodes at most ``max_gap + 1`` below that have another event. A
    projection is grown by recursion until no node is left or the pattern is ``sizes[1]`` long.
    """
    found = []

    def grown(patterns: np.ndarray, projection: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        size = patterns.shape[1]
        if size >= sizes[0]:
            which, who = [], []
            for depth, (of, nodes) in projection.items():
                at, entity = tree.entities_of(depth, nodes)
                which.append(of[at])
                who.append(entity)
            if which:
                once = np.unique(np.stack([np.concatenate(which), np.concatenate(who)]), axis=1)
                found.append((patterns, once[0], once[1]))
        if size == sizes[1] or not projection:
            return
        steps = []
        for depth, (of, nodes) in projection.items():
            for at in range(depth + 1, min(depth + max_gap + 2, len(tree.links))):
                above, below = tree.below(depth, nodes, at)
                label, mine = tree.labels[at][below], of[above]
                ok = (label >= 0) & (patterns[mine] != label[:, None]).all(axis=1)
                if wanted is not None:
                    slot = _slot(ids[patterns[mine[ok], -1]], ids[label[ok]])
                    ok[ok] = (wanted[slot >> 3] >> (slot & 7)) & 1 > 0
                if ok.any():
                    steps.append((at, mine[ok], label[ok], below[ok]))
        if not steps:
            return
        key = np.concatenate([mine * (len(ids) + 1) + label for _, mine, label, _ in steps])
        new, back = np.unique(key, return_inverse=True)
        longer = np.concatenate([patterns[new // (len(ids) + 1)], (new % (len(ids) + 1))[:, None]], axis=1)
        into: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        offset = 0
        for at, mine, _, below in steps:
            into.setdefault(at, []).append((back[offset : offset + len(mine)], below))
            offset += len(mine)
        # a node may be reached from several nodes above it: once is enough
        slim = {}
        for at, parts in into.items():
            both = np.unique(np.stack([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])]), axis=1)
            slim[at] = (both[0], both[1])
        grown(longer, slim)

    first = np.unique(tree.labels[0]) if tree.size else np.zeros(0, np.int64)
    first = first[first >= 0]
    nodes = np.flatnonzero(tree.labels[0] >= 0) if tree.size else first
    grown(first[:, None], {0: (np.searchsorted(first, tree.labels[0][nodes]), nodes)} if len(nodes) else {})
    return found


_FOUND = "pattern binary, entity long, n long"


def _packed(patterns: np.ndarray) -> list[bytes]:
    """Each pattern as one value: 8 bytes an event, greatest first, shifted so that none is negative."""
    shifted = np.ascontiguousarray((patterns.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8"))
    return shifted.view(f"V{8 * patterns.shape[1]}").ravel().tolist() if len(patterns) else []


def _events_of(pattern: str) -> Column:
    """The events of a packed pattern as a list."""
    number = f"cast(conv(hex(substring({pattern}, i * 8 + 1, 8)), 16, 10) as decimal(20, 0)) - 9223372036854775808BD"
    return F.expr(f"transform(sequence(0, cast(octet_length({pattern}) / 8 as int) - 1), i -> cast({number} as bigint))")


def _chunk(rows: pd.DataFrame, sizes: tuple[int, int], max_gap: int, wanted: bytes | None) -> pd.DataFrame:
    """Patterns of a chunk: with the entity where the chunk may cut it, else counted."""
    rows = rows.sort_values("pos")
    code, ids = pd.factorize(rows["event"].to_numpy(), sort=True)
    who, own = rows["entity"].to_numpy(), int(rows["own"].sum())
    tree = PrefixTree(who, code.astype(np.int64), own, 1 + (max_gap + 1) * (sizes[1] - 1))
    bits = None if wanted is None else np.frombuffer(wanted, np.uint8)
    out = []
    for patterns, which, entity in _mined(tree, ids, sizes, max_gap, bits):
        cut = (entity == who[0]) | (entity == who[own - 1])
        whole, n = np.unique(which[~cut], return_counts=True)
        at = np.concatenate([whole, which[cut]])
        known = pd.arrays.IntegerArray(np.concatenate([np.zeros(len(whole), np.int64), entity[cut]]), np.arange(len(at)) < len(whole))
        out.append(pd.DataFrame({"pattern": _packed(ids[patterns[at]]), "entity": known, "n": np.concatenate([n, np.ones(int(cut.sum()), np.int64)])}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"pattern": [], "entity": pd.array([], "Int64"), "n": []})


def _supports(chunks: DataFrame, sizes: tuple[int, int], max_gap: int, wanted: bytes | None) -> DataFrame:
    found = chunks.groupBy("chunk").applyInPandas(lambda rows: _chunk(rows, sizes, max_gap, wanted), _FOUND)
    # entities within one chunk are counted there; those that chunks cut are made distinct here
    counted = found.groupBy("pattern", "entity").agg(F.sum("n").alias("n")).withColumn("n", F.when(F.col("entity").isNull(), F.col("n")).otherwise(1))
    return counted.groupBy("pattern").agg(F.sum("n").alias("support"))


def _pair_filter(pairs: DataFrame) -> bytes:
    """A filter of fixed size that lets all frequent pairs pass, and few others: ``FILTER_BITS`` bits, whatever the pairs.

    Only its bytes that aren't 0 reach the driver.
    """

    def slots(batches):
        for batch in batches:
            if len(batch):
                pair = (np.frombuffer(b"".join(batch["pattern"]), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, 2)
                slot = _slot(pair[:, 0], pair[:, 1])
                yield pd.DataFrame({"at": slot >> 3, "bits": 1 << (slot & 7)})

    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    rows = pairs.select("pattern").mapInPandas(slots, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return out.tobytes()


def frequent_patterns(runs: DataFrame, sizes: tuple[int, int] = (3, 3), max_gap: int = 3, min_share: float = 0.1, min_support: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``pattern, support``: patterns of different events that occur in this order, of ``sizes[0]`` to ``sizes[1]`` events (2 at least).

    ``runs`` has ``part, ord`` (their order), ``entity, event``. At most ``max_gap`` other events lie
    between neighbours. ``support`` counts entities; patterns with at least ``min_share`` of all entities
    and ``min_support`` come out. An empty table, or entities of too few events, give no rows. Equal rows are rows.

    Sequences are cut at exact positions into chunks that also get the few events after them, so one
    entity with most events is mined by many tasks. Every pair of neighbours in a pattern is at least as
    frequent as the pattern, so pairs are mined first and prune the longer ones by a filter of fixed size.
    """
    if not 2 <= sizes[0] <= sizes[1]:
        raise ValueError(f"patterns have 2 events at least, not {sizes}")
    counts = runs.groupBy("part").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_before", F.sum("_c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("_c")  # one row a task
    local = F.row_number().over(W.partitionBy("part").orderBy("ord")) - 1
    at = runs.withColumn("_i", local).join(offsets, "part").select("entity", "event", (F.coalesce("_before", F.lit(0)) + F.col("_i")).alias("pos"))
    ahead = (sizes[1] - 1) * (max_gap + 1)
    chunk = max(chunk, ahead)  # so that what a chunk needs lies in it and the next one
    into = F.floor(F.col("pos") / chunk)
    copies = F.when((F.col("pos") % chunk < ahead) & (into > 0), F.array(F.struct(into.alias("chunk"), F.lit(1).alias("own")), F.struct((into - 1).alias("chunk"), F.lit(0).alias("own")))).otherwise(F.array(F.struct(into.alias("chunk"), F.lit(1).alias("own"))))
    chunks = staged(at.withColumn("_c", F.explode(copies)).select("_c.chunk", "_c.own", "entity", "event", "pos"), "chunks")
    # distinct entities per chunk first: a small table even if one entity has most events
    n = chunks.where("own = 1").select("entity").distinct().count()
    least = max(min_support, int(np.ceil(min_share * n - 1e-9)))
    pairs = _supports(chunks, (2, 2), max_gap, None).where(F.col("support") >= least)
    found = pairs if sizes == (2, 2) else _supports(chunks, sizes, max_gap, _pair_filter(pairs)).where(F.col("support") >= least)
    return found.select(_events_of("pattern").alias("pattern"), "support")


def frequent_triples(runs: DataFrame, max_gap: int = 3, min_share: float = 0.1, min_support: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``event_a, event_b, event_c, support``: the patterns of three events, see ``frequent_patterns``."""
    out = frequent_patterns(runs, (3, 3), max_gap, min_share, min_support, chunk)
    return out.select(*[F.col("pattern")[i].alias(f"event_{x}") for i, x in enumerate("abc")], "support")
