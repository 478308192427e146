"""Runs and subsequences against brute force."""

import random
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.runs import STRICT, UNIT, Segmentation, near_events, same_events, segmented, segments, without_redelivered
from logloom.llm.subsequences import PrefixTree, frequent_patterns, frequent_triples


def _rows(seed, entities=40, n=3000):
    r = random.Random(seed)
    # one entity holds a third of all rows
    return [(0 if r.random() < 0.33 else r.randrange(entities), min(r.randrange(8), r.randrange(8)), r.randrange(500), i) for i in range(n)]


def _brute_runs(rows):
    by = defaultdict(list)
    for e, v, t, i in rows:
        by[e].append((t, i, v))
    out = set()
    for e, seq in by.items():
        seq.sort()
        start = 0
        for k in range(1, len(seq) + 1):
            if k == len(seq) or seq[k][2] != seq[start][2]:
                out.add((e, seq[start][2], seq[start][1], seq[k - 1][1], k - start, seq[k - 1][0] - seq[start][0]))
                start = k
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_runs(spark, parts):
    rows = _rows(1)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = segments(spark.createDataFrame(rows, "e long, v long, t long, log_id long"), "e", "v", "t").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.entity, r.event, r.first_log_id, r.last_log_id, r.n, r.duration_us) for r in got} == _brute_runs(rows)
    assert len(got) == len(_brute_runs(rows))


def _least(events, near, penalty):
    """Least cost over all segmentations, each run with its best representative."""

    def run(a, b):
        shared = set.intersection(*(set(near[e]) for e in events[a:b]))
        return min((sum(near[e][m] for e in events[a:b]) for m in shared), default=None)

    best = [0] + [None] * len(events)
    for b in range(1, len(events) + 1):
        best[b] = min(best[a] + c + (penalty if a else 0) for a in range(b) if (c := run(a, b)) is not None)
    return best[-1]


def _cost(path, events, near, penalty):
    return sum(near[e][m] for e, m in zip(events, path, strict=True)) + penalty * (len(list(groupby(path))) - 1)


def _some_near(r, n=7):
    near = {e: {e: 0} for e in range(n)}
    for a in range(n):
        for b in range(a):
            if r.random() < 0.35:
                near[a][b] = near[b][a] = r.randrange(100_000, 900_000)
    return near


def test_segmentation_is_optimal():
    r = random.Random(3)
    by_neighbours = 0
    for _ in range(300):
        near, penalty = _some_near(r), r.choice([1, 200_000, 500_000, 900_000])
        events = [r.randrange(7) for _ in range(r.randrange(1, 40))]
        path = segmented(Segmentation(near, penalty), [(e, len(list(g))) for e, g in groupby(events)])
        whole = [m for m, (_, g) in zip(path, groupby(events), strict=True) for _ in g]
        assert _cost(whole, events, near, penalty) == _least(events, near, penalty)
        cuts = [a != b for a, b in zip(whole, whole[1:], strict=False)]
        by_neighbours += cuts != [near[a].get(b, UNIT) > penalty for a, b in zip(events, events[1:], strict=False)]
    assert by_neighbours > 100  # cutting where neighbours differ by more than the penalty is another thing


def test_chain_is_cut_at_the_best_place():
    # 0 is near 1 and 1 is near 2, but 0 and 2 aren't near: a run of all three stands for 1 or it is cut
    near = {0: {0: 0, 1: 300_000}, 1: {0: 300_000, 1: 0, 2: 200_000}, 2: {1: 200_000, 2: 0}}
    dp = Segmentation(near, 500_000)
    assert segmented(dp, [(0, 1), (1, 1), (2, 1)]) == [1, 1, 1]
    assert segmented(dp, [(0, 5), (1, 1), (2, 9)]) == [0, 2, 2]
    assert segmented(dp, [(0, 5), (1, 1), (2, 1)]) == [0, 1, 1]


def _listed(spark, near):
    rows = [(e, [{"event": m, "d": d} for m, d in own.items()]) for e, own in near.items()]
    return spark.createDataFrame(rows, "event_id long, near array<struct<event:bigint,d:bigint>>")


@pytest.mark.parametrize("parts", ["1", "5", "16"])
def test_near_runs_over_tasks(spark, parts):
    r = random.Random(int(parts))
    near = _some_near(r)
    # one entity holds two thirds of the rows, and few rows make a block that spans several tasks
    rows = [(0 if r.random() < 0.67 else r.randrange(4), min(r.randrange(7), r.randrange(7)), i, i) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for penalty in (0.5, 0.2, STRICT):
        got = segments(spark.createDataFrame(rows, "e long, v long, t long, log_id long"), "e", "v", "t", _listed(spark, near), penalty).collect()
        by = defaultdict(list)
        for x in sorted(got, key=lambda x: (x.entity, x.first_us)):
            by[x.entity].append(x)
        for e, runs in by.items():
            own = [(v, i) for w, v, _, i in rows if w == e]
            assert [x.n for x in runs] == [sum(x.first_log_id <= i <= x.last_log_id for _, i in own) for x in runs] and sum(x.n for x in runs) == len(own)
            assert all(a.event != b.event for a, b in zip(runs, runs[1:], strict=False))
            path = [x.event for x in runs for _ in range(x.n)]
            cents = round(penalty * UNIT)
            assert _cost(path, [v for v, _ in own], near, cents) == _least([v for v, _ in own], near, cents)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_near_events(spark):
    t = spark.createDataFrame([(1, "Opened volume * on node * of rack"), (2, "opened VOLUME * on node 5 of rack"), (3, "opened volume on node of the rack"), (4, "nothing alike"), (5, None)], "event_id long, template string")
    got = {r.event_id: {x.event: x.d for x in r.near} for r in near_events(t).collect()}
    assert got == {1: {1: 0, 3: 142_857}, 2: {1: 0, 3: 142_857}, 3: {3: 0, 1: 142_857}, 4: {4: 0}, 5: {5: 0}}
    assert near_events(t.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, e, i, i) for i, e in enumerate([1, 2, 2, 3, 1, 4, 9])], "e long, v long, t long, log_id long")
    strict = segments(rows, "e", "v", "t", near_events(t), STRICT)
    assert [(r.event, r.n) for r in strict.orderBy("first_us").collect()] == [(1, 3), (3, 1), (1, 1), (4, 1), (9, 1)]
    assert [(r.event, r.n) for r in segments(rows, "e", "v", "t", near_events(t)).orderBy("first_us").collect()] == [(1, 5), (4, 1), (9, 1)]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 1, None, 1), (None, 1, 1, 2), (1, None, 1, 3)], "e long, v long, t long, log_id long")
    assert segments(df, "e", "v", "t").count() == 0
    runs = segments(df.limit(0), "e", "v", "t")
    assert runs.count() == 0 and frequent_triples(runs).count() == 0


def test_same_events_and_redelivered(spark):
    t = spark.createDataFrame([(5, "Ab * c"), (3, "a-BC 9"), (7, "abd"), (8, None), (9, None)], "event_id long, template string")
    assert {r.event_id: r.event for r in same_events(t).collect()} == {5: 3, 3: 3, 7: 7, 8: 8, 9: 9}
    rows = spark.createDataFrame([(1, 1, "x", None), (2, 1, "x", None), (3, 1, "x", ""), (4, 1, None, "x")], "log_id long, k long, a string, b string")
    assert sorted(r.log_id for r in without_redelivered(rows, ["k"], ["k", "a", "b"]).collect()) == [1, 3, 4]


def _brute_patterns(seqs, size, gap, share, least):
    support = Counter()
    for s in seqs.values():
        found = {((v,), i) for i, v in enumerate(s)}
        for _ in range(size - 1):
            found = {((*p, s[j]), j) for p, i in found for j in range(i + 1, min(i + gap + 2, len(s))) if s[j] not in p}
        support.update({p for p, _ in found})
    return {(t, n) for t, n in support.items() if n >= least and n >= share * len(seqs)}


def _ordered(spark, seqs, parts=3):
    flat = [(e, v) for e, s in seqs.items() for v in s]
    size = -(-len(flat) // parts)
    rows = [(i // size, 2 * i, e, v) for i, (e, v) in enumerate(flat)]
    return spark.createDataFrame(rows, "part int, ord long, entity long, event long").repartition(4)


@pytest.mark.parametrize("chunk", [16, 64, 16384])
def test_patterns_of_all_sizes(spark, chunk):
    r = random.Random(7)
    seqs = {e: [r.randrange(8) for _ in range(300 if e == 3 else r.randrange(1, 30))] for e in range(24)}
    got = defaultdict(set)
    for x in frequent_patterns(_ordered(spark, seqs), (2, 5), 1, 0.1, 3, chunk).collect():
        got[len(x.pattern)].add((tuple(x.pattern), x.support))
    assert [got[k] for k in (2, 3, 4, 5)] == [_brute_patterns(seqs, k, 1, 0.1, 3) for k in (2, 3, 4, 5)] and all(got[k] for k in (2, 3, 4, 5))


@pytest.mark.parametrize("chunk", [16, 16384])
def test_triples(spark, chunk):
    r = random.Random(8)
    seqs = {e: [r.randrange(30) for _ in range(400 if e == 3 else r.randrange(1, 40))] for e in range(30)}
    runs = _ordered(spark, seqs)
    got = {((x[0], x[1], x[2]), x[3]) for x in frequent_triples(runs, min_share=0.1, min_support=2, chunk=chunk).collect()}
    assert got == _brute_patterns(seqs, 3, 3, 0.1, 2)
    assert frequent_triples(runs.where(F.col("entity") == 1).limit(2)).count() == 0


def test_tree_is_shared_by_entities():
    seqs = {1: [5, 6, 7, 8], 2: [5, 6, 7, 9], 3: [5, 6, 4], 4: [6, 7]}
    entity = np.concatenate([np.full(len(s), e) for e, s in seqs.items()])
    tree = PrefixTree(entity, np.concatenate(list(seqs.values())), len(entity), 4)
    paths = {tuple(tree.events[i, : d + 1].tolist()): n for d in range(4) for i, n in zip(tree.links[d].tolist(), tree.counts[d].tolist(), strict=True)}
    assert (paths[5,], paths[5, 6], paths[5, 6, 7], paths[6,], paths[6, 7], paths[5, 6, 7, 8]) == (3, 3, 2, 4, 3, 1)
    # position codes: the descendants of (5, 6) two below are those of the rows of its block
    node = np.flatnonzero(tree.labels[1] == 6)[:1]
    _, below = tree.below(1, node, 3)
    assert sorted(tree.labels[3][below].tolist()) == [-1, 8, 9]
