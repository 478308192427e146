"""Entries of mixed layouts."""

from pyspark.sql import functions as F

from logloom.operators.loglines import MOST_LAYOUTS, Layouts, common, entries, layout_support, mined_layouts, pattern, request_id, tokens

LINES = [
    "2018-10-08 12:45:11,845 24972 DEBUG ferrite.volume.worker [req-E729521F-6BF3-AF91-06E8-34F5A9334F49] Rendering secret 145\n    at a.b.Call(Call.java:5)\n\nts=2018-10-08T12:45:24.655Z level=crit comp=tidepool.deploy.sync msg=\"Synced unit 9\"",
    "2018-10-08 12:45:12,845 24973 INFO ferrite.volume.api [-] Dropping secret mount 5",
    "ts=2018-10-08T12:45:24.655Z level=info comp=tidepool.deploy.watch msg=\"Dropped unit\"",
    "I1009 05:15:18.303166 26570 tidepool.volume.api:135] Dropping node pool",
    "E1009 05:15:18.303166 26571 tidepool.volume.sync:7] Evicting (last ERROR at 2018-10-08 12:40:13)",
    '{"msg": "Rolled back (last WARN at 2018-10-08 12:40:13)", "name": "quarry.deploy.watch", "lvl": "Warning", "ts": "2018-10-08T13:32:21.987530Z"}',
    '{"msg": "Rolled back quota now", "name": "quarry.deploy.api", "lvl": "INFO", "ts": "2018-10-08T13:32:21.987530Z"}\r\nplain tail',
    "no header at all", "", None,
]
MESSAGES = [
    ("10679 cirrus.meter.rpc  Refreshing address ts=Z level=info comp=tidepool.deploy.sync msg=\"Pulling lease 4\" I 23420 quarry.deploy.watch:213] req_b2f2af19451cbfd020d4a0f918bb638f Queued", " warn ", "{5E298EA3-3D97-302E-E4B0-4D88B00805BE}"),
    ("10680 cirrus.meter.api Refreshing X-Request-Id: {5E298EA33D97302EE4B04D88B00805BE} console", None, None),
    ("Polling device", "ERR", None),
]


def _fields(spark):
    rows = [("event_type_ansible", i, t, True, None, None) for i, t in enumerate(LINES)] + [("iaas_filtered", i, t, False, lv, ms) for i, (t, lv, ms) in enumerate(MESSAGES)]
    return spark.createDataFrame(rows, "log_source string, log_id long, text string, lines boolean, level string, ms_id string")


def test_entries(spark):
    got = [(r.log_source[0], r.log_id, r.entry_no, r.level, r.component, r.ms_id) for r in entries(_fields(spark)).orderBy("log_source", "log_id", "entry_no").collect()]
    u, v = "e729521f-6bf3-af91-06e8-34f5a9334f49", "5e298ea3-3d97-302e-e4b0-4d88b00805be"
    assert got == [
        ("e", 0, 1, "DEBUG", "ferrite.volume.worker", u), ("e", 0, 2, "FATAL", "tidepool.deploy.sync", ""), ("e", 1, 1, "INFO", "ferrite.volume.api", ""), ("e", 2, 1, "INFO", "tidepool.deploy.watch", ""),
        ("e", 3, 1, "INFO", "tidepool.volume.api", ""), ("e", 4, 1, "ERROR", "tidepool.volume.sync", ""), ("e", 5, 1, "WARN", "quarry.deploy.watch", ""), ("e", 6, 1, "INFO", "quarry.deploy.api", ""),
        ("e", 7, 1, "", "", ""), ("e", 8, 1, "", "", ""), ("i", 0, 1, "WARN", "cirrus.meter.rpc", v), ("i", 0, 2, "INFO", "tidepool.deploy.sync", ""),
        ("i", 0, 3, "INFO", "quarry.deploy.watch", "b2f2af19-451c-bfd0-20d4-a0f918bb638f"), ("i", 1, 1, "", "cirrus.meter.api", v), ("i", 2, 1, "ERROR", "", ""),
    ]


def test_empty(spark):
    assert entries(_fields(spark).limit(0)).count() == 0
    assert entries(_fields(spark).where("text is null")).count() == 0


def test_common_subsequence():
    a, b = tokens("<info> x.y.z: 5 apples"), tokens("<warn> u.v.w: 77 pears")
    assert common(a, b) == ["<", "<level>", ">", " ", "<module>", ":", " ", "<num>", " ", "*"]
    assert "(?P<level>" in pattern(common(a, b))
    assert request_id(None) == "" and request_id("id 5") == ""


def _noisy(n, shape):
    head = "2018-10-08 12:45:11,845 24972 DEBUG ferrite.volume.worker [-] Rendering secret %d"
    return [head % i + "\n" + shape(i) for i in range(n)]


def _word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def _of(spark, texts):
    return spark.createDataFrame([("event_type_ansible", i, t, True, None, None) for i, t in enumerate(texts)], "log_source string, log_id long, text string, lines boolean, level string, ms_id string")


def test_continuation_lines_with_stamp_and_name_are_no_layouts(spark):
    texts = _noisy(600, lambda i: f"{_word(i)} {_word(7 * i)} 2018-10-08 12:45:11 {_word(3 * i)}.worker done")
    fields = _of(spark, texts)
    assert [t[:1] for t, _ in mined_layouts(fields)] == [["<stamp>"]]
    got = entries(fields).collect()
    assert len(got) == 600 and {(r.level, r.component) for r in got} == {("DEBUG", "ferrite.volume.worker")}


def test_one_odd_line_makes_no_layout(spark):
    texts = _noisy(500, lambda i: "odd words 2018-10-08 12:45:11 some.where done" if i == 77 else "plain")
    fields = _of(spark, texts)
    assert entries(fields).count() == 500
    kept = {r.kept: r.n for r in layout_support(fields).collect()}
    assert kept == {True: 500, False: 1}  # what fell below is reported


def test_layouts_are_bounded_whatever_the_noise(spark):
    def shape(i):
        words = " ".join(_word(i * k) for k in range(1, 2 + i % 30))
        return words + ["=", ": ", " (", " <", "|"][i % 5] + "2018-10-08 12:45:11 " + " ".join(_word(i * k + 1) for k in range(1 + i % 7)) + f" {_word(i)}.x.y" + [" ", ":", "]", ")"][i % 4]

    fields = _of(spark, _noisy(10_000, shape)).repartition(8)
    found = layout_support(fields)
    assert found.groupBy("kind").count().agg(F.max("count")).first()[0] <= MOST_LAYOUTS
    assert [t[:1] for t, _ in mined_layouts(fields)] == [["<stamp>"]]
    assert entries(fields).count() == 10_000


def test_header_end_has_any_number_of_marks(spark):
    texts = [f"<<<<2018-10-08 12:45:1{i % 10}> INFO> a.b.c>>>>>> message {i}" for i in range(20)]
    got = entries(_of(spark, texts)).collect()
    assert len(got) == 20 and got[0].component == "a.b.c" and got[0].message.startswith("message")


def test_layouts_among_much_noise_keep_their_support():
    """Two headers of a layout, with more unlike ones between them than a line is tried on."""
    layouts = Layouts()
    kind = ("word", "/", "<stamp>", "<module>", "<module>")
    for i in range(1500):
        if i % 500 == 100:
            layouts.add(kind, ["seldom", " ", "but", " ", "steady", "<stamp>", "<module>"], f"example {i}")
        layouts.add(kind, [*(f"{_word(i)}{k}" for k in range(9)), "<stamp>", "<module>"], "noise")
    cells = layouts.found[kind]
    assert len(cells) == 1501 and sum(n for _, n, _ in cells) == 1503
    assert [n for template, n, _ in cells if template[0] == "seldom"] == [3]


def test_what_is_not_listed_is_counted(spark):
    texts = [" ".join(f"{_word(i)}{_word(k + 7)}{_word(i)}" for k in range(9)) + f": 2018-10-08 12:45:11 {_word(i)}.worker done" for i in range(300)]
    texts += ["alpha beta gamma 2018-10-08 12:45:11 some.where done"] * 2
    rows = layout_support(_of(spark, texts[:200] + texts[-1:] + texts[200:-1]).repartition(3)).collect()
    assert sum(r.n for r in rows) == 302 and len(rows) <= MOST_LAYOUTS + 1
