"""Miners against the hand-traced corpus."""

import pickle
import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.functions.tokens import key_layer, mask, stripped_words, tokenize
from logloom.operators import miners

MESSAGES = [
    "blk 124219214 asa Receive from node 4", "blk 124219214 ffwqwq 1241241 Done to node 4", "blk 124219214 ffwqwq Done to node 4",
    "blk 782174184 Instance raer1421MManf142v Receive from node 356", "Tcp net down daafa aswf qe 1241", "Tcp net down daafa 12 qe 1241",
    "Tcp qws down daafa 214 qe 1241", "Tcp qws down daafa 421 qe 1241", "Tcp qws down daafa 14 qe 1241", "delete block_1", "delete block_3 block_4", "delete block_6",
]


@pytest.fixture(scope="module")
def logs(spark):
    df = spark.createDataFrame(list(enumerate(MESSAGES, 1)), "log_id long, message string")
    return df.withColumn("tokens", tokenize(mask(F.col("message"), "generic"))).withColumn("words", stripped_words(F.col("message")))


def result(mined):
    texts = {r.event: r.template for r in mined.templates.collect()}
    ids = {}
    for r in mined.assignments.orderBy("log_id").collect():
        ids.setdefault(r.event, []).append(r.log_id)
    return [(texts[e], ids[e]) for e in sorted(texts)]


def test_bsg(logs):
    assert result(miners.mine_bsg(logs)) == [
        ("blk digit_* * * * node digit_*", [1, 3]), ("Tcp * down daafa * qe digit_*", [5, 6, 7, 8, 9]), ("blk digit_* ffwqwq digit_* Done to node digit_*", [2]),
        ("blk digit_* Instance raerdigit_*MManfdigit_*v Receive from node digit_*", [4]), ("delete block_digit_*", [10, 12]), ("delete block_digit_* block_digit_*", [11]),
    ]


def test_bsgi(logs):
    assert result(miners.mine_bsgi(logs)) == [
        ("blk digit_* from node digit_*", [1]), ("blk digit_* to node digit_*", [3]), ("Tcp * down daafa aswf qe digit_*", [5]), ("Tcp * down daafa digit_* qe digit_*", [6, 7, 8, 9]),
        ("blk digit_* ffwqwq digit_* Done to node digit_*", [2]), ("blk digit_* Instance raerdigit_*MManfdigit_*v Receive from node digit_*", [4]),
        ("delete block_digit_*", [10, 12]), ("delete block_digit_* block_digit_*", [11]),
    ]


def test_classify(logs):
    got = {r.log_id: (r.template, r.event) for r in miners.classify(logs, logs).collect()}
    assert got[12] == ("delete block_digit_*", 7)
    assert len(got) == 12


def test_drain(logs):
    assert result(miners.mine_drain(logs)) == [
        ("blk digit_* * * * node digit_*", [1, 3]), ("blk digit_* * * * * node digit_*", [2, 4]), ("Tcp net down daafa * qe digit_*", [5, 6]),
        ("Tcp qws down daafa digit_* qe digit_*", [7, 8, 9]), ("delete block_digit_*", [10]), ("delete block_digit_* block_digit_*", [11]), ("delete block_digit_*", [12]),
    ]


def test_draga(logs):
    assert sorted(i for _, i in result(miners.mine_draga(logs))) == [[1, 3], [2, 4], [5, 6], [7, 8, 9], [10, 12], [11]]


def test_spell(logs):
    assert result(miners.mine_spell(logs)) == [
        ("blk digit_* * Receive from node digit_*", [1, 4]), ("blk digit_* ffwqwq * Done to node digit_*", [2, 3]), ("Tcp * down daafa * qe digit_*", [5, 6, 7, 8, 9]), ("delete block_digit_*", [10, 11, 12]),
    ]


def test_first_fit(logs):
    mined = miners.mine_first_fit(logs, threshold=0.5)
    assert sum(r.n for r in mined.templates.collect()) == 12
    sweep = miners.first_fit_sweep(logs).collect()
    assert len(sweep) == 9 and sum(r.best for r in sweep) == 1


def test_null_and_empty(spark, logs):
    odd = logs.unionByName(spark.createDataFrame([(13, None)], "log_id long, message string").withColumn("tokens", tokenize(mask(F.col("message"), "generic"))).withColumn("words", stripped_words(F.col("message"))))
    for mine in (miners.mine_bsg, miners.mine_bsgi, miners.mine_drain, miners.mine_draga, miners.mine_spell):
        assert mine(odd).assignments.count() == 12
        assert mine(odd.limit(0)).templates.count() == 0


def _logs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "log_id long, message string")
    return df.withColumn("tokens", tokenize(F.col("message"))).withColumn("words", stripped_words(F.col("message")))


def test_leading_blank_is_a_clean_key(spark):
    keys = _logs(spark, [" a 1"]).select(key_layer(F.col("tokens")).alias("k")).first().k
    assert (keys.pos, keys.key) == (9, "")


def _groups(mined):
    return sorted(ids for _, ids in result(mined))


def test_index_is_skipped_in_another_key(spark):
    # keys b and a interleave in one length: after a's first cluster was used, b's first one is passed over
    logs = _logs(spark, ["a x y z", "b x y z", "a x y z", "b x y z"])
    assert len(_groups(miners.mine_bsgi(logs, compat=True))) == 2  # one text is one event, however many clusters
    state = {c: miners.GiniBuckets(0.7, 20, c) for c in (True, False)}
    into = {c: [s.step(t[0], t) for t in (m.split() for m in ("a x y z", "b x y z", "a x y z", "b x y z"))] for c, s in state.items()}
    assert into == {True: [0, 0, 1, 0], False: [0, 0, 0, 0]}


def test_unclean_ends_are_never_classified(spark):
    logs = _logs(spark, ["1 up 2", "1 up 2"])
    assert [(r.event, r.template) for r in miners.classify(logs, logs, compat=True).collect()] == [(-1, "")] * 2
    assert [r.event for r in miners.classify(logs, logs, compat=False).collect()] == [1, 1]


def test_short_messages_stay_apart_in_the_tree(spark):
    logs = _logs(spark, ["go on", "go on", "go on", "stay here now", "stay here now"])
    assert _groups(miners.mine_drain(logs)) == [[1], [2], [3], [4, 5]]
    assert _groups(miners.mine_drain(logs, compat=False)) == [[1, 2, 3], [4, 5]]


def test_full_layer_hides_messages(spark):
    logs = _logs(spark, ["a p", "b q", "d s", "a p", "d s"])
    # two nodes and the catch-all make three: d goes to the catch-all and isn't found there again
    assert _groups(miners.mine_draga(logs, children=3)) == [[1, 4], [2], [3], [5]]
    assert _groups(miners.mine_draga(logs, children=3, compat=False)) == [[1, 4], [2], [3, 5]]


def test_tree_walk_passes_tokens_over(spark):
    logs = _logs(spark, ["delete block", "delete other block"])
    assert _groups(miners.mine_spell(logs, threshold=0.9)) == [[1, 2]]
    logs = _logs(spark, ["delete block", "delete a b c d block"])
    assert _groups(miners.mine_spell(logs, threshold=0.9)) == [[1, 2]]
    assert _groups(miners.mine_spell(logs, threshold=0.9, compat=False)) == [[1], [2]]


def test_entropies_of_the_last_cluster(spark):
    texts = ["k a b c d", "k a b c e", "k q w c d", "k q w c f", "k a w c g", "k q b c d", "k a b x d", "k a w c d", "k q w c e"] * 3
    for compat in (True, False):
        state = miners.EntropyBucket(0.7, 20, compat)
        plain = _PlainBucket(0.7, 20, compat)
        assert [state.step(t.split()) for t in texts] == [plain.step(t.split()) for t in texts]
        assert [c["entropy"] for c in state.clusters] == [c["entropy"] for c in plain.clusters]


class _PlainBucket(miners.EntropyBucket):
    """One cluster after another, as the miner is defined."""

    def step(self, tokens):
        best, change = None, {}
        for k, c in enumerate(self.clusters):
            differ = sum(a != b for a, b in zip(c["template"], tokens, strict=True))
            got = self._change(c, tokens) if differ <= miners._limit(c) else None
            change = got[1] if got else {}
            if got and (best is None or got[0] < best[1]):
                best = (k, *got)
        if best is None:
            return super().step(tokens)
        c = self.clusters[best[0]]
        new = miners.merged(c["template"], tokens)
        c["nc"], c["template"], c["n"] = sum(a == b for a, b in zip(c["template"], tokens, strict=True)), new, c["n"] + 1
        for seen, t in zip(c["seen"], tokens, strict=True):
            seen[t] += 1
        for i, e in (change if self.compat else best[2]).items():
            c["entropy"][i] = e
        self.codes.put(best[0], new, miners._limit(c))
        return best[0]


def _scored(texts, threshold):
    """Quality of one threshold, every pair of templates compared."""
    by_length = {}
    for t in texts:
        by_length.setdefault(len(t), miners.FirstFit(threshold)).step(t)
    groups, by_text = {}, {}
    for t in sorted((t for s in by_length.values() for _, _, t in s.end()), key=lambda t: (len(t), t)):
        if miners.constants_text(t):
            by_text.setdefault(miners.constants_text(t).lower(), []).append(t)
    for ts in by_text.values():
        groups.setdefault(miners.term_pairs(ts[0]), ts)
    kept = [1 - t.count("*") / len(t) for ts in groups.values() for t in ts]
    sets = [set(g) for g in groups]
    least = [min([1.0, *[1 - len(a & b) / len(a | b) for j, b in enumerate(sets) if i != j]]) for i, a in enumerate(sets)]
    c, d = sum(kept) / len(kept), sum(least) / len(least)
    return round(c, 9), round(d, 9), round(c * d**2, 9)


def test_sweep_against_all_pairs(spark, logs):
    more = ["Delete Block now", "delete block now", "go a b c", "go a x c", "go y x c", "one", "One", "two words", "words two", "go go a"]
    both = logs.select("log_id", "words").unionByName(_logs(spark, more).select((F.col("log_id") + 100).alias("log_id"), "words"))
    texts = [list(r.words) for r in both.orderBy("log_id").collect()]
    got = {r.threshold: (round(r.compactness, 9), round(r.distance, 9), round(r.quality, 9)) for r in miners.first_fit_sweep(both).collect()}
    assert got == {t / 10: _scored(texts, t / 10) for t in range(1, 10)}


def _lcs(a, b):
    """Length and walk by the whole table, as defined."""
    c = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            c[i][j] = c[i - 1][j - 1] + 1 if x == y else max(c[i][j - 1], c[i - 1][j])
    i, j, back = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            back.append(a[i - 1])
            i, j = i - 1, j - 1
        elif c[i][j - 1] > c[i - 1][j]:
            j -= 1
        else:
            back.append(None)
            i -= 1
    out = []
    for t in reversed(back):
        if t is not None or (out and out[-1] != "*"):
            out.append(t or "*")
    return c[-1][-1], out


class _AllSignatures(miners.Signatures):
    """Looks at every signature for every message."""

    def step(self, tokens):
        if (k := self._walk(tokens)) == -1 and (k := self._held(tokens)) == -1:
            return self._best(tokens)
        return k

    def _held(self, tokens):
        for k, s in sorted(self.signatures.items()):
            rest = iter(tokens)
            if s and set(s) <= set(tokens) and len(s) / len(tokens) >= 0.5 and all(t in rest for t in s):
                return k
        return -1

    def _best(self, tokens):
        best, result, size, length = -1, [], -1, 0
        for k, s in sorted(self.signatures.items()):
            if len(set(s) & set(tokens)) / max(1, len(set(s) | set(tokens))) > 0.5:
                n, template = _lcs(s, tokens)
                if n > size:
                    best, result, size, length = k, template, n, len(s)
                elif n == size and len(s) < length:
                    best, result = k, template
                    if self.compat:
                        size = len(template)
                    else:
                        length = len(s)
        if size / len(tokens) >= self.threshold:
            self._remove(self.signatures[best])
        else:
            best, result = len(self.signatures) + 1, tokens
        self.signatures[best] = result
        self._add(result, best)
        return best


@pytest.mark.parametrize("compat", [True, False])
def test_spell_looks_at_all_signatures(compat, monkeypatch):
    monkeypatch.setattr(miners.Shares, "BLOCK", 16)
    rng = random.Random(5)
    for vocabulary in (6, 14, 60):
        quick, slow = miners.Signatures(0.5, compat), _AllSignatures(0.5, compat)
        for _ in range(900):
            message = [rng.choice([f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}", "a", "*"]) for _ in range(rng.randrange(1, 12))]
            assert quick.step(message) == slow.step(message)
        assert quick.signatures == slow.signatures and len(quick.signatures) > 3


@pytest.mark.parametrize("compat", [True, False])
def test_spell_keeps_forms_exact(compat, monkeypatch):
    for name, value in (("RARE", 2), ("FEW", 5), ("FORMS", 40), ("ONCE", 200)):
        monkeypatch.setattr(miners.Signatures, name, value)
    rng = random.Random(9)
    for values in (4, 40, 400):
        quick, slow = miners.Signatures(0.5, compat), _AllSignatures(0.5, compat)
        for i in range(1200):
            kind = min(rng.randrange(12), rng.randrange(12))
            message = [f"verb{kind % 3}", f"object{kind}", "of", f"v{rng.randrange(values)}", *["in", f"v{rng.randrange(values)}"] * rng.randrange(2), *rng.choice([[], ["tail", "a", f"v{rng.randrange(values)}"], ["*", "b", "of"]])]
            if i == 600:
                quick = pickle.loads(pickle.dumps(quick))
            assert quick.step(message) == slow.step(message)
        assert quick.signatures == slow.signatures and quick.tree == slow.tree


def test_spell_time_of_known_forms(monkeypatch):
    """Messages alike but for their values, among many signatures: those are looked through once in a while, not once a message."""
    state = miners.Signatures(0.5)
    for i in range(2000):
        state.step([f"module{i % 40}", *(f"word{i}_{j}" for j in range(8)), f"end{i % 50}"])
    calls, counted = [], miners.Shares.counted
    monkeypatch.setattr(miners.Shares, "counted", lambda *x: calls.append(1) or counted(*x))
    for i in range(1000):
        state.step([f"module{i % 40}", "step", "took", str(-i), "seconds", "in", "end"])
    assert len(state.signatures) == 2001 and len(calls) < 200


def test_spell_time_of_many_signatures():
    """Each message has words of all signatures, without being like any."""
    state = miners.Signatures(0.5)
    began = time.process_time()
    for i in range(5000):
        state.step([*(f"common{j}" for j in range(6)), *(f"own{i}_{j}" for j in range(8))])
    assert len(state.signatures) == 5000
    assert time.process_time() - began < 5
