"""Prediction by similar sequences against its definition."""

import math
import random
from collections import Counter, defaultdict

import pytest

from logloom.operators import sequences


def _defined(train, target, k, n):
    out = {}
    for name, items in target.items():
        known = {x for x in items[-k:] if any(x in s for s in train.values())}
        similar = [s for s in train.values() if known <= set(s)]
        total = defaultdict(float)
        for s in similar:
            at = max((i for i, x in enumerate(s) if x == items[-1] and i), default=None)
            after = [x for x in s[at + 1 :] if x not in items[-k:]] if at is not None else []
            for d, x in enumerate(after, 1):
                total[x] += math.log(1 + 1 / len(similar) + 0.001 / d)
        for x in sorted(total, key=lambda x: (-round(total[x], 9), x))[:n]:
            out[name, x] = round(total[x], 6)
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(name, i, x) for name, items in rows.items() for i, x in enumerate(items)], "seq string, pos int, item string")


def _written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("most", [6_000_000, 900])
def test_predicts_as_defined(spark, monkeypatch, most):
    monkeypatch.setattr(sequences, "PACK_ROWS", most, raising=False)
    monkeypatch.setattr(sequences, "_AT_ONCE", 50, raising=False)
    rng = random.Random(3)
    one = lambda: [f"i{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randrange(1, 25))]
    train = {f"s{j}": one() for j in range(150)}
    target = {f"t{j}": one() for j in range(60)} | {"new": ["i1", "never"], "newer": ["never", "i1"], "alone": ["never"]}
    got = sequences.predict_next(_frame(spark, train), _frame(spark, target), 4, 3).collect()
    assert {(r.target, r.item): round(r.log_score, 6) for r in got} == _defined(train, target, 4, 3)
    assert max(Counter(r.target for r in got).values()) == 3


def test_pairs_of_similar_sequences_are_not_shuffled(spark, monkeypatch):
    """1,000 sequences alike: a million pairs, of which none need be written."""
    rows = {f"s{j}": [f"i{(j * 7 + i) % 20}" for i in range(40)] for j in range(1000)}
    before = _written(spark)
    frame = _frame(spark, rows)
    monkeypatch.setattr(sequences, "PACK_ROWS", 6_000_000, raising=False)
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sequences.predict_next(frame, frame).count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert _written(spark) - before < 3e6
