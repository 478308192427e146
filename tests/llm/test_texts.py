"""Terms, near-duplicates, encoding and mixing against brute force."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import encode
from logloom.llm.encode import Encoder, decoded, encoded, merged, read_ranks, token_sizes
from logloom.llm.mix import mixed, shares, source_name
from logloom.llm.near import similar_classes, similar_pairs
from logloom.llm.terms import term_counts, terms, value


def test_terms():
    assert terms("Über-mut _x. a1 b_2 foo.bar -- 超时 é") == ["über-mut", "x", "foo.bar", "超时", "é"]
    assert terms("") == [] and terms("1 2 _ .") == []


def test_term_counts(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["hot"] * 5 + [f"w{chr(97 + i)}" for i in range(20)]) for _ in range(r.randrange(0, 9))) for _ in range(500)] + [None, "", "x " * 100_000]
    df = spark.createDataFrame([("m", t) for t in texts] + [("id", str(i % 3)) for i in range(9)] + [("other", "x"), (None, "y")], "field string, text string")
    got = {(x.field, x.term): (x.occurrences, x.records, x.mark) for x in term_counts(df, {"m": terms, "id": value}, heavy_share=0.02).collect()}
    uses, rows = Counter(), Counter()
    n = {"m": sum(t is not None for t in texts), "id": 9}
    for f, t in [("m", t) for t in texts] + [("id", str(i % 3)) for i in range(9)]:
        if t is not None:
            own = terms(t) if f == "m" else [t]
            uses.update((f, x) for x in own)
            rows.update((f, x) for x in set(own))
    assert got == {k: (uses[k], rows[k], "rare" if rows[k] < 5 else "common" if rows[k] > 0.05 * n[k[0]] else None) for k in uses}
    assert term_counts(df.limit(0), {"m": terms}).count() == 0


def test_heavy_terms_with_few_counters(spark):
    r = random.Random(4)
    texts = [" ".join([f"rare{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", *r.choices(["hot", "warm"], [3, 1], k=3)]) for i in range(6000)]
    df = spark.createDataFrame([("m", t) for t in texts], "field string, text string")
    got = {x.term: (x.occurrences, x.records) for x in term_counts(df, {"m": terms}, heavy_share=0.1).collect()}
    uses, rows = Counter(t for x in texts for t in terms(x)), Counter(t for x in texts for t in set(terms(x)))
    assert got == {t: (uses[t], rows[t]) for t in uses}


def _similar(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) >= 0.75 * sum((x | y).values())


def test_near_pairs(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    rows = []
    for _ in range(24):
        base = [r.choice(words) for _ in range(r.randrange(40, 120))]
        for _ in range(r.randrange(1, 7)):
            text = list(base)
            for _ in range(r.randrange(0, 14)):
                k = r.randrange(len(text))
                text[k : k + r.randrange(2)] = [r.choice(words)]
            rows.append((r.choice("ab"), len(rows), " ".join(text) if r.random() < 0.7 else "\n".join(text).upper()))
    rows += [("a", len(rows) + i, rows[0][2]) for i in range(3)] + [("a", 900, None), ("a", 901, ""), ("b", 902, "short text"), ("b", 903, "z " * 70), ("b", 904, "Z " * 80)]
    df = spark.createDataFrame(rows, "grp string, log_id long, text string")
    long = [x for x in rows if x[2] and len(x[2].split()) >= 60]
    want = {(a[0], *sorted((a[1], b[1]))) for i, a in enumerate(long) for b in long[i + 1 :] if a[0] == b[0] and _similar(a[2], b[2])}
    got = [tuple(x) for x in similar_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    assert similar_pairs(df.limit(0)).count() == 0
    members, near = similar_classes(df)
    assert members.count() == len(long) and near.where("a >= b").count() == 0


RANKS = read_ranks()


@pytest.fixture(scope="module")
def reference():
    import base64  # noqa: F401

    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab s'tredlvm12 \n\t\u00a0\u3000é中'’.,ßİ<|>🧪"), max_size=40), max_size=12))
def test_encoding(reference, texts):
    ids, ends = Encoder(RANKS).ids(texts)
    starts = [0, *ends.tolist()][: len(texts)]
    assert [ids[a:b].tolist() for a, b in zip(starts, ends.tolist(), strict=True)] == [reference.encode_ordinary(t) for t in texts]


def test_decodes_and_offsets():
    e = Encoder(RANKS)
    texts = ["It's  naïve\n\n  don't<|endoftext|>", "", "x" * 5000 + " end"]
    ids, ends = e.ids(texts)
    back = {v: k for k, v in RANKS.items()}
    assert b"".join(back[i] for i in ids[: ends[0]].tolist()).decode() == texts[0]
    numbers, piece_ends, offsets = e.pieces(texts)
    assert offsets[0] == 0 and offsets[piece_ends[1]] == 0 and len(offsets) == len(numbers)
    assert e.sizes(texts).tolist() == [ends[0], 0, ends[2] - ends[1]]
    assert merged("hello world".encode(), RANKS) is not None


def test_scan_is_cut_into_parts(monkeypatch, reference):
    monkeypatch.setattr(encode, "SCAN", 50)
    texts = ["some text's here"] * 20
    e = Encoder(RANKS)
    assert sum(len(e.ids(texts[a:b])[0]) for a, b in encode._parts(texts)) == 20 * len(reference.encode_ordinary(texts[0]))


def test_encoded_table(spark, reference):
    df = spark.createDataFrame([(1, "don't stop", 0), (2, "", 0), (3, None, 0), (3, None, 0)], "doc_id long, text string, key int")
    got = sorted((r.doc_id, list(r.ids)) for r in encoded(df).collect())
    assert got == [(1, reference.encode_ordinary("don't stop")), (2, []), (3, []), (3, [])]
    assert encoded(df.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in token_sizes(df, ["doc_id"]).collect()) == [(1, 3), (2, 0), (3, 0), (3, 0)]


def test_offsets_and_decoding(spark):
    texts = ["It's  naïve\n\n  don't<|endoftext|> 超时 🧪", "", None, "x" * 3000 + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in encoded(df, with_offsets=True).collect()}
    for i, t in enumerate(texts):
        starts = list(rows[i].offsets)
        assert starts == sorted(set(starts)) and (not t or (starts[0] == 0 and starts[-1] < len(t)))
        assert [n for n in rows[i].piece_ids] == sorted(rows[i].piece_ids) and len(starts) == len(rows[i].piece_ids) and (not t or rows[i].piece_ids[-1] == len(rows[i].ids))
        # every piece decodes to its stretch of the text
        cuts = [*starts, len(t or "")]
        ends = [0, *rows[i].piece_ids]
        back = {v: k for k, v in RANKS.items()}
        assert [b"".join(back[x] for x in rows[i].ids[a:b]).decode() for a, b in zip(ends, ends[1:], strict=False)] == [t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if t else True
    assert {r.doc_id: r.text for r in decoded(encoded(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, "a" if i % 3 else "b", r.randrange(1, 200)) for i in range(3000)] + [(5000, "c", 0), (5001, None, 50), (5002, "free", 50)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(" A ", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 5), ("none", 0.1, 5), (None, 0.1, 1)], "source string, weight double, max_repeats long")
    mix, plans = mixed(sizes, targets)
    got = {x.doc_id: x.copies for x in mix.collect()}
    assert len(got) == len(rows) and got[5000] == got[5001] == got[5002] == 0
    by = Counter()
    for i, s, n in rows:
        by[s] += got[i] * n
        assert got[i] <= {"a": 1, "b": 3}.get(s, 0)
    for s, w in (("a", 0.5 / 0.8), ("b", 0.3 / 0.8)):
        assert abs(by[s] - plans[s].goal) <= 100 and abs(by[s] / (by["a"] + by["b"]) - w) < 0.002
    report = {x.source: x for x in shares(mix, targets).collect()}
    assert set(report) == {"a", "b", "c", "none"} and report["none"].reached_share == 0 and abs(sum(x.reached_share for x in report.values()) - 1) < 1e-9
    capped, plans = mixed(sizes, targets, total_tokens=10_000_000)
    assert plans["a"].whole == 1 and plans["b"].whole == 3
    assert all(x.copies == {"a": 1, "b": 3}.get(x.source, 0) for x in capped.collect() if x.n_tokens)
    assert mixed(sizes.limit(0), targets)[0].count() == 0
    assert mixed(sizes, targets.limit(0))[0].where("copies > 0").count() == 0


def test_mix_of_thousands_of_sources(spark):
    n = 5000
    sizes = spark.range(0, 6 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source"), (F.col("id") * 7919 % 200 + 1).alias("n_tokens"))
    targets = spark.range(0, n).select(F.concat(F.lit("S"), F.col("id")).alias("source"), F.lit(1 / n).alias("weight"), F.lit(2).alias("max_repeats"))
    mix, plans = mixed(sizes, targets)
    assert len(plans) == n
    by = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("m")).collect()
    assert len(by) == n and all(abs(r.t - plans[r.source].goal) <= 100 and r.m <= 2 for r in by)


def test_inclusion_odds(spark):
    """Over many seeds a document of odds p is taken in about p of the mixes."""
    sizes = spark.createDataFrame([(i, "a", 10 if i % 2 else 30) for i in range(60)], "doc_id long, source string, n_tokens long").cache()
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats long")
    taken = Counter()
    for seed in range(12):
        taken.update(x.n_tokens for x in mixed(sizes, targets, total_tokens=600, seed=seed)[0].where("copies > 0").collect())
    p30, p10 = taken[30] / (30 * 12), taken[10] / (30 * 12)
    assert abs(p30 - 0.6) < 0.1 and abs(p10 - 0.2) < 0.1


def test_source_names(spark):
    df = spark.createDataFrame([(" Tech-Reports ",), ("tech_reports",), (None,)], "s string")
    assert [r.x for r in df.select(source_name(F.col("s")).alias("x")).collect()] == ["tech_reports", "tech_reports", None]
