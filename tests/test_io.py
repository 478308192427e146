"""Sources, sinks, assembly and streams."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import similarity
from logloom.functions.formal import formal_fields, valid_date
from logloom.functions.tokens import mask, read_rules, register_rules, tokenize
from logloom.operators import miners
from logloom.operators.assembly import assembled, starts_with_date, starts_with_two, stream_records
from logloom.operators.graph import dot, observation_matrix, successors
from logloom.operators.nextkey import WorkflowBuilder, workflow_edges
from logloom.operators.sequences import shuffled
from logloom.sources import readers, sinks
from logloom.sources.formalize import formalize
from logloom.streaming.online import STREAMED, assemble_stream, mine_bsg_stream, mine_stream, parse_stream, records_of, windowed_counts

RAW = ["2018-10-15 10:00:00.123 99 INFO one", "  two", "", "2018-10-15 10:00:01 ERROR three", "2018-10-15 10:00:02 done"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_text("\n".join(RAW) + "\n")
    with gzip.open(tmp_path / "in" / "sub" / "b.gz", "wt") as f:
        f.write("\n".join(RAW[3:]))
    (tmp_path / "in" / ".DS_Store").write_text("x")
    return tmp_path


def test_lines_and_records(spark, folder):
    assert [p.rsplit("/", 1)[1] for p in readers.list_files(str(folder / "in"))] == ["a.log", "b.gz"]
    lines = readers.read_lines(spark, str(folder / "in"))
    assert lines.count() == 7 and readers.read_lines(spark, str(folder / "in"), drop_blank=True).count() == 6
    assert readers.read_line_splits(spark, str(folder / "in")).count() == 7
    whole = assembled(lines, "file", "line_no", "line", starts_with_two(F.col("line"))).orderBy("file", "record").collect()
    assert [r.text for r in whole][:2] == ["2018-10-15 10:00:00.123 99 INFO one   two ", "2018-10-15 10:00:01 ERROR three"]
    open_ = assembled(lines, "file", "line_no", "line", starts_with_date(F.col("line")), flush_last=False)
    assert open_.count() == 3  # three records of one file and two of the other, without the last of each
    one = spark.createDataFrame([(RAW[0],)], "line string").select(*formal_fields(F.col("line"))).first()
    assert (one.time, one.level, one.ms_id, one.message) == ("2018-10-15 10:00:00.123", "INFO", None, " one")


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app.log").write_text("".join(f"line {i}\n" for i in range(4000)))
    (tmp_path / "in" / "b.log").write_text("one\ntwo")
    (tmp_path / "in" / ".hidden").write_text("x")
    assert [x.rsplit("/", 1)[1] for x in readers.list_files(str(tmp_path / "in"))] == [x.rsplit("/", 1)[1] for x in readers.list_files(str(tmp_path / "in"), spark)] == ["app.log", "b.log"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "in"))
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("app.log", i, f"line {i}") for i in range(4000)] + [("b.log", 0, "one"), ("b.log", 1, "two")]
    (tmp_path / "none").mkdir()
    assert readers.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_matrix_and_shuffle(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 1.0), ("b", "b", 3.0)], "src string, dst string, weight double")
    assert [tuple(r) for r in observation_matrix(edges).collect()] == [("a", -1.0, 2.0), ("b", 1.0, 3.0)]
    rows = spark.range(50)
    mixed = [r.id for r in shuffled(rows).collect()]
    assert sorted(mixed) == list(range(50)) and mixed != list(range(50)) and len(set(r.id for r in shuffled(rows, n=5).collect())) == 5


def test_successors_on_dense_and_tied_rows(spark):
    r = random.Random(3)
    rows, t = [], 0.0
    for i in range(400):
        t += r.choice([0, 0, 1, 5, 30])
        rows.append((i, r.choice("abcde"), t))
    want = set()
    for i, e, t0 in rows[:-1]:
        seen = set()
        for _, x, t1 in rows[i + 1 :]:
            if t1 - t0 < 20 and x != e and x not in seen:
                seen.add(x)
                want.add((i, e, x, t1 - t0))
    got = successors(spark.createDataFrame(rows, "rn long, event string, time double").repartition(5), 20).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_named_rules(spark):
    register_rules("own", [(r"x+", "<x>")])
    assert spark.createDataFrame([("a xx b",)], "m string").select(mask(F.col("m"), "own").alias("m")).first().m == "a <x> b"


def test_own_machine(spark):
    class First(miners.Machine):
        """All messages that start with the same token are one."""

        def __init__(self):
            self.firsts = {}

        def step(self, tokens, key):
            return "", self.firsts.setdefault(tokens[0], len(self.firsts)), None, None

        def end(self):
            return [("", k, t, [t], None) for t, k in self.firsts.items()]

    rows = spark.createDataFrame([(i, i, t.split()) for i, t in enumerate(["a x", "b y", "a z"])], "log_id long, ord long, tokens array<string>").withColumn("all", F.lit(0))
    found = miners.mined(rows, ["all"], lambda _: First()).where("log_id is null").orderBy("c").collect()
    assert [(r.text, r.n, r.ord) for r in found] == [("a", 2, 0), ("b", 1, 1)]


def test_formalize(spark, folder):
    formalize(spark, {str(folder / "in"): str(folder / "out")})
    rows = readers.read_csv(spark, str(folder / "out"), readers.FORMALIZED).orderBy("log_id").collect()
    assert [r.log_id for r in rows] == [0, 1, 2, 3, 4] and [r.level for r in rows] == ["INFO", "ERROR", None, "ERROR", None]


def test_stamp_order_beats_place(spark):
    row = spark.createDataFrame([("2018-10-15 10:00:00,123 then 2018/10/15 10:00:00",)], "line string").select(*formal_fields(F.col("line"))).first()
    assert row.time == "2018/10/15 10:00:00"


def test_dates(spark):
    texts = {"2018-10-15 10:00:00": True, "2018-10-15": True, "2018-13-15": False, "2018-10-15 10:00": False, "x": False, "": False, "2018-02-30 10:00:00": False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", valid_date(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == texts


def test_rule_files():
    assert read_rules(["\\d+ <n>\n", "\n", "a b c"]) == [("\\d+", "<n>"), ("a", "b")]
    with pytest.raises(ValueError):
        read_rules(["alone"])


def test_csv_and_tabs(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\thello world\nbad\nx\ty\n")
    assert [tuple(r) for r in readers.read_tabbed(spark, str(tmp_path / "t.txt")).collect()] == [(1, "hello world")]
    (tmp_path / "d.txt").write_text("[7, 1, 2]\n8,3\n\n")
    assert [(r.deploy_id, list(r.events)) for r in readers.read_deploy_sequences(spark, str(tmp_path / "d.txt")).collect()] == [("7", [1, 2]), ("8", [3])]
    (tmp_path / "a.csv").write_text("h1,h2,h3\na,b,\nc,d,e\n")
    (tmp_path / "b.csv").write_text("h1\nz\n")
    train, test = readers.read_sequences(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), merge=True)
    assert sorted(map(tuple, train.collect())) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d"), (1, 2, "e"), (2, 0, "z")] and test.count() == 1
    logs = spark.createDataFrame([(0, "2018-10-15 10:00:00,5", "INFO", None, 'say "x",\ny')], readers.FORMALIZED)
    sinks.write_formalized(logs, str(tmp_path / "f"))
    assert readers.read_csv(spark, str(tmp_path / "f"), readers.FORMALIZED, rows=5).first().message == 'say "x",\ny'


def test_results(spark, tmp_path):
    logs = spark.createDataFrame([(i, f"2018-10-15 10:00:0{9 - i},5", f"delete block {i}") for i in range(5)], "log_id long, time string, message string")
    logs = logs.withColumn("tokens", tokenize(mask(F.col("message"), "generic")))
    mined = miners.mine_bsg(logs)
    rows, templates = sinks.parse_result(mined, logs)
    assert [r.log_id for r in rows.collect()] == [4, 3, 2, 1, 0] and templates.count() == 1
    sinks.write_parse_result(mined, logs, str(tmp_path), "Bsg")
    sinks.write_assignment_lists(mined, logs, str(tmp_path / "lists"))
    assert readers.read_csv(spark, str(tmp_path / "Bsg"), readers.PARSED).count() == 5
    assert spark.read.text(str(tmp_path / "lists/templates")).first().value == "1\t5 delete block digit_*"
    tree = sinks.template_tree(mined.templates)
    assert sorted((r.src, r.dst, r.weight) for r in tree.collect())[-1] == ("root / length 3 / delete / block", "root / length 3 / delete / block / digit_*", 5)
    assert 'digraph flow' in dot(tree)


def test_trees(spark):
    templates = spark.createDataFrame([(1, "a b *", 3), (2, "a c *", 2), (3, "1 x\n1 x y", 4)], "event long, template string, n long")
    edges = lambda df: {(r.src, r.dst): r.weight for r in df.collect()}
    assert edges(sinks.signature_tree(templates.where("event < 3")))["root", "root / a"] == 5
    assert edges(sinks.bucket_tree(templates.where("event < 3")))["root / length 3 / first", "root / length 3 / first / a"] == 5
    assert edges(sinks.template_tree(templates.where("event < 3"), 1))["root / length 3", "root / length 3 / a"] == 5
    cells = edges(sinks.cell_graph(templates.where("event = 3")))
    assert cells == {("length 2", "1 x"): 4, ("1 x", "cell 3"): 4, ("length 3", "1 x y"): 4, ("1 x y", "cell 3"): 4}


def test_lcs():
    assert similarity.lcs_walk(list("abcd"), list("xbd"), mark=False) == (2, ["b", "d"])
    assert similarity.lcs_walk(list("abcd"), list("xbd"), mark=True) == (2, ["b", "*", "d"])


def test_similarity(spark):
    row = spark.createDataFrame([(["a", "*", "c"], ["a", "b", "x"])], "t array<string>, l array<string>")
    t, x = F.col("t"), F.col("l")
    got = row.select(similarity.share_of_length(t, x), similarity.share_of_constants(t, x), similarity.differing_positions(t, x), similarity.is_subsequence(F.array(F.lit("a"), F.lit("x")), x), similarity.within_distance(t, x, F.lit(3), F.lit(0.5))).first()
    assert tuple(got) == (1 / 3, 0.5, 2, True, True)


def test_workflow_loop():
    table = {(1,): [(2, 0.9)], (1, 2): [(3, 0.95)], (2, 3): [(1, 0.9)], (3, 1): [(2, 0.9)]}
    flows = WorkflowBuilder(table).build([1, 2])
    assert [f.keys for f in flows] == [[1, 2, 3, 1, 2, 3]]
    assert WorkflowBuilder({}).build([1, 2]) == []


def test_workflow_edges_are_whole():
    r = random.Random(7)
    for _ in range(200):
        keys = r.randint(2, 4)
        table = {}
        for context in [(), *((a,) for a in range(keys)), *((a, b) for a in range(keys) for b in range(keys))]:
            weights = {k: r.random() ** 2 for k in r.sample(range(keys), 2)}
            table[context] = sorted(((k, w / sum(weights.values())) for k, w in weights.items()), key=lambda o: -o[1])
        flows = WorkflowBuilder(table, longest=2, most=9, max_flows=10**6).build([0, 1])
        assert WorkflowBuilder(table, longest=2, most=9).edges([0, 1]) == {e for f in flows for e in f.edges}


def test_workflows_are_not_cut_silently(spark):
    table = {(a, b): [(c, 1 / 3) for c in range(3)] for a in range(3) for b in range(3)}
    with pytest.raises(ValueError, match="more than 1000 workflows"):
        WorkflowBuilder(table).build([0, 1])
    walk = [[a, b, c] for a in range(3) for b in range(3) for c in range(3)]
    windows = spark.createDataFrame([(w,) for w in walk], "keys array<long>")
    got = workflow_edges(windows, 2, [0, 1]).collect()
    assert sorted((r.context, r.next) for r in got) == sorted((f"{a},{b}", c) for a, b, c in walk)


def _run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    logs = spark.createDataFrame(list(enumerate(["blk 1 a to x", "blk 2 b to x", "net down 5", "net up 6"] * 3)), "log_id long, message string")
    logs = logs.withColumn("tokens", tokenize(mask(F.col("message"), "generic")))
    for i in range(3):
        logs.where(f"log_id div 4 = {i}").coalesce(1).write.parquet(str(tmp_path / "m"), mode="append")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    _run(mine_bsg_stream(stream), "mined")
    last = spark.sql("select grp, cluster, max_by(template, log_id) as template, count(*) as n from mined group by all")
    want = miners.mine_bsg(logs).templates
    assert sorted((r.template, r.n) for r in last.collect()) == sorted((r.template, r.n) for r in want.collect())

    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(RAW)], "source string, line_no long, line string")
    lines.coalesce(1).write.parquet(str(tmp_path / "l"))
    _run(assemble_stream(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "l"))), "assembled")
    assert [r.record for r in spark.sql("select record from assembled order by record").collect()] == [1, 2]

    events = spark.createDataFrame([(f"2018-10-15 10:0{i}:00", "a") for i in range(5)] + [("2018-10-16 10:00:00", "b")], "t string, e string").withColumn("t", F.col("t").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    _run(windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "t", "e"), "counted")
    assert [r.n for r in spark.sql("select n from counted").collect()] == [5]


STREAM = "opens without a date\n2018-10-15 10:00:00 {a} one (x) two\n  more\n2018-10-15 10:00:01\n2018-10-15 10:00\n2018-13-15 10:00:02 no date\n2018-10-15 10:00:61 leap\n2018-10-15 10:00:03"


def test_stream_records(spark):
    want = ["opens without a date", "2018-10-15 10:00:00  one  two  more", "2018-10-15 10:00:012018-10-15 10:002018-13-15 10:00:02 no date", "2018-10-15 10:00:61 leap2018-10-15 10:00:03"]
    assert records_of(STREAM, compat=False) == want and records_of(STREAM) == want[:-1] and records_of("") == []
    pieces = STREAM.split("\n")
    lines = spark.createDataFrame([("f", i, t, i < len(pieces) - 1) for i, t in enumerate(pieces)], "source string, i int, line string, ended boolean")
    for compat in (True, False):
        got = stream_records(lines, "source", "i", "line", F.col("ended"), compat).orderBy("record").collect()
        assert [r.text for r in got] == records_of(STREAM, compat)


@pytest.mark.parametrize("miner", sorted(STREAMED))
def test_streams_of_all_miners(spark, tmp_path, miner):
    texts = ["blk 1 a to x", "blk 2 b to x", "net down 5", "net up 6", "blk 3 c to y", "tcp 5 lost 7 of 9", "tcp lost"] * 6
    logs = spark.createDataFrame(list(enumerate(texts)), "log_id long, message string").withColumn("tokens", tokenize(mask(F.col("message"), "generic")))
    for i in range(3):
        logs.where(f"log_id div 14 = {i}").coalesce(1).write.parquet(str(tmp_path / "m"), mode="append")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    _run(mine_stream(stream, miner), f"mined_{miner}")
    rows = spark.sql(f"select * from mined_{miner} order by log_id").collect()
    got = {r.log_id: (r.grp, r.key if miner == "bsgi" else "", r.cluster) for r in rows}
    if miner in ("bsg", "bsgi", "first_fit"):  # in a batch clusters of one text are one event
        last = {got[r.log_id]: r.template for r in rows}
        form = {"bsg": str, "bsgi": lambda t: miners.collapsed(t.split(" ")), "first_fit": lambda t: miners.constants_text(t.split(" "))}[miner]
        got = {i: form(last[c]) for i, c in got.items()}
    one = {"bsg": miners.mine_bsg, "drain": miners.mine_drain, "spell": miners.mine_spell, "draga": lambda x: miners.mine_draga(x, threshold=1.0), "bsgi": lambda x: miners.mine_bsgi(x, few=0), "first_fit": lambda x: miners.mine_first_fit(x, words="tokens")}[miner]
    want = {r.log_id: r.event for r in one(logs).assignments.collect()}
    same = lambda of: {frozenset(i for i in of if of[i] == v) for v in set(of.values())}
    assert got.keys() == want.keys() and same(got) == same(want)


def test_parse_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.log").write_text("".join(f"2018-10-15 10:00:0{i} INFO connect to node {i}\n  tail\n" for i in range(5)))
    q = parse_stream(spark, str(tmp_path / "in"), "drain", "generic").writeStream.format("memory").queryName("parsed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from parsed").collect()
    assert len(rows) == 8 and {r.record for r in rows} == {1, 2, 3, 4} and len({(r.grp, r.cluster) for r in rows}) == 1
