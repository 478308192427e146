"""Queries of the log-analytics operators over the test tables, each beside its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import formal, similarity, tokens
from logloom.operators import assembly, graph, miners, nextkey, quality, sequences
from logloom.operators.ordering import positions
from logloom.session import staged, table

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL counterpart if there is one."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return take


# ---- messages -----------------------------------------------------------------------------------

_MESSAGE = "concat(event_type, ' user ', cast(user_id as varchar), ' value:', cast(cast(floor(value) as bigint) as varchar), ' props ', props)"


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_id, user_id, event_type, message, tokens, words`` of the events table."""
    e = table(spark, sf_dir, "events")
    message = F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" value:"), F.floor("value").cast("long").cast("string"), F.lit(" props "), "props")
    rows = e.select(F.col("event_id").alias("log_id"), "user_id", "event_type", message.alias("message"))
    return rows.withColumns({"tokens": tokens.tokenize(tokens.mask(F.col("message"), "generic")), "words": tokens.stripped_words(F.col("message"))})


def _masked_sql(rules: str, column: str) -> str:
    for pattern, by in [(r"\s+", " "), *tokens.RULES[rules]]:
        quoted = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '(?s){quoted}', '{by}', 'g')"
    return column


_LISTS = f"lists as (select event_id as log_id, event_type, user_id, string_split_regex({_masked_sql('generic', _MESSAGE)}, ' |\\.') as l from events)"
_CLEAN = r"not regexp_matches({0}, '\p{{Nd}}') and not regexp_matches({0}, '[#$&''*+,/<=>@^_`|~)]')"
_KEYED = f"""{_LISTS}, keyed as (select *,
    len(l) * 3 + case when {_CLEAN.format("l[1]")} then 0 when {_CLEAN.format("l[-1]")} then 1 else 2 end as pos,
    case when {_CLEAN.format("l[1]")} then l[1] when {_CLEAN.format("l[-1]")} then l[-1] else '' end as key from lists)"""
_PLACES = f"{_KEYED}, places as (select pos, key, generate_subscripts(l, 1) - 1 as i, unnest(l) as token from keyed)"
_FOLDED = f"""{_PLACES}, folded as (select pos, key, string_agg(case when lo = hi then lo else '*' end, ' ' order by i) as template, max(n) as n
    from (select pos, key, i, min(token) as lo, max(token) as hi, count(*) as n from places group by all) group by pos, key)"""


def _mask_query(rules: str, source: str) -> None:
    if source == "events":
        sql = f"select event_id as log_id, {_masked_sql(rules, _MESSAGE)} as masked from events"
    else:
        sql = f"select log_id, {_masked_sql(rules, 'message')} as masked from iaas_filtered"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = rendered(spark, sf_dir) if source == "events" else table(spark, sf_dir, "iaas_filtered")
        return rows.select("log_id", tokens.mask(F.col("message"), rules).alias("masked"))

    QUERIES[f"mask_{rules}"], ORACLE[f"mask_{rules}"] = run, sql


for _rules, _source in (("iaas", "iaas_filtered"), ("paas", "iaas_filtered"), ("hdfs", "events"), ("generic", "events")):
    _mask_query(_rules, _source)


@query(f"with {_LISTS} select log_id, len(l) as n_tokens, array_to_string(l, '|') as tokens from lists")
def tokenize(spark, sf_dir):
    return rendered(spark, sf_dir).select("log_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


@query(f"with {_LISTS} select cast(len(l) as bigint) as n_tokens, count(*) as n from lists group by 1")
def token_length_hist(spark, sf_dir):
    return rendered(spark, sf_dir).groupBy(F.size("tokens").cast("long").alias("n_tokens")).agg(F.count("*").alias("n"))


@query(rf"select log_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(message, '[0-9]+', '', 'g'), '\s+'), lambda x: x <> ''), ' ') as words from iaas_filtered where message is not null")
def stripped_words(spark, sf_dir):
    rows = table(spark, sf_dir, "iaas_filtered").where("message is not null")
    return rows.select("log_id", F.array_join(tokens.stripped_words(F.col("message")), " ").alias("words"))


@query(f"with {_KEYED} select log_id, cast(pos as integer) as pos, key from keyed")
def key_layer(spark, sf_dir):
    return rendered(spark, sf_dir).select("log_id", tokens.key_layer(F.col("tokens")).alias("k")).select("log_id", "k.pos", "k.key")


_TESTED = r"""
    with t as (select distinct unnest(string_split(message, ' ')) as token from iaas_filtered where message is not null)
    select token, regexp_matches(token, '\p{Nd}') as digit, regexp_matches(token, '[#$&''*+,/<=>@^_`|~)]') as special,
        regexp_matches(token, '[#$&''*+,/<=>@^_`|~)]') and not regexp_matches(token, '^[\w]+[#$&''*+,\/<=>@^_`|~.]+$') as special_tail from t"""


@query(_TESTED)
def token_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "iaas_filtered").where("message is not null").select(F.explode(F.split("message", " ", -1)).alias("token")).distinct()
    t = F.col("token")
    return rows.select("token", tokens.has_digit(t).alias("digit"), tokens.has_special(t).alias("special"), tokens.has_special_tail(t).alias("special_tail"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_id, b, a``: tokens of each message but the first and of the one before it, whatever ids are missing."""
    rows = positions(rendered(spark, sf_dir).select("log_id", F.col("tokens").alias("b")), "log_id")
    return rows.join(rows.select((F.col("rn") + 1).alias("rn"), F.col("b").alias("a")), "rn").drop("rn")


@query(f"""with {_LISTS}, pairs as (select log_id, l as b, lag(l) over (order by log_id) as a from lists)
    select log_id, case when len(list_distinct(list_concat(a, b))) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) end as jaccard,
        case when len(a) = len(b) then cast(len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> '*' and a[i] = b[i])) as integer) end as equal_positions,
        case when len(a) = len(b) then cast(len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) as integer) end as differing,
        case when len(a) = len(b) then array_to_string(list_transform(range(1, len(a) + 1), lambda i: case when a[i] = b[i] then a[i] else '*' end), ' ') end as merged
    from pairs where a is not null""")
def similarity_of_neighbours(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    same = lambda c: F.when(F.size("a") == F.size("b"), c)
    return _neighbours(spark, sf_dir).select(
        "log_id", F.round(similarity.jaccard(a, b), 9).alias("jaccard"), same(similarity.equal_positions(a, b)).alias("equal_positions"),
        same(similarity.differing_positions(a, b)).alias("differing"), same(F.array_join(similarity.merged_template(a, b), " ")).alias("merged"),
    )


@query(f"""with {_LISTS}, folded as (select len(l) as n, list(l order by log_id) as ls from lists group by 1),
        merged as (select n, list_transform(range(1, n + 1), lambda i: case when len(list_distinct(list_transform(ls, lambda x: x[i]))) = 1 then ls[1][i] else '*' end) as t from folded),
        pairs as (select log_id, l, t from lists join merged on len(l) = n),
        counted as (select *, len(list_filter(range(1, len(t) + 1), lambda i: t[i] <> '*' and t[i] = l[i])) as same, len(list_filter(t, lambda x: x <> '*')) as constants,
            len(list_filter(range(1, len(t) + 1), lambda i: t[i] <> l[i])) as differ from pairs)
    select log_id, round(same / len(t), 9) as of_length, round(case when constants > 0 then same / constants when len(t) = 1 and regexp_matches(l[1], '\\p{{Nd}}') then 1.0 else 0.0 end, 9) as of_constants,
        differ <= ceil(0.3 * constants) as within, array_to_string(t, ' ') as template from counted""")
def likeness_to_length(spark, sf_dir):
    """Each message beside the template of all messages of its length."""
    rows = rendered(spark, sf_dir).select("log_id", F.size("tokens").alias("length"), "tokens")
    folded = quality.folded_templates(rows, ["length"]).select("length", F.split("template", " ", -1).alias("t"), "template")
    t, own = F.col("t"), F.col("tokens")
    constants = F.size(F.filter("t", lambda x: x != "*"))
    return rows.join(folded, "length").select(
        "log_id", F.round(similarity.share_of_length(t, own), 9).alias("of_length"), F.round(similarity.share_of_constants(t, own), 9).alias("of_constants"),
        similarity.within_distance(t, own, constants, F.lit(0.7)).alias("within"), "template",
    )


@query(r"""with t as (select event_id, template, string_split(template, ' ') as w from labelled_templates where template is not null)
    select event_id, trim(regexp_replace(template || ' ', '(\* )+', '* ', 'g')) as collapsed, cast(len(list_filter(w, lambda x: try_cast(x as double) is not null)) as integer) as numbers,
        len(list_filter(w, lambda x: x = 'for')) > 0 and list_position(w, 'for') < coalesce(list_position(list_reverse(w), '*') * -1 + len(w) + 1, 0) as for_then_any from t""")
def template_forms(spark, sf_dir):
    """Collapsed templates, how many of their words are numbers, and whether ``for`` comes before a ``*``."""
    words = F.split("template", " ", -1)
    contained = similarity.is_subsequence(F.array(F.lit("for"), F.lit("*")), words)
    return _known(spark, sf_dir).select("event_id", tokens.collapse_stars(F.col("template")).alias("collapsed"), F.size(F.filter(words, tokens.is_float)).alias("numbers"), contained.alias("for_then_any"))


#: Tables of longest common subsequences row by row, and the walk back through them, as recursion.
_LCS = r"""pairs as (select log_id, l as b, lag(l) over (order by log_id) as a from lists),
    grown(log_id, a, b, i, last, t) as (
        select log_id, a, b, 0, list_transform(range(len(b) + 1), lambda x: 0), [list_transform(range(len(b) + 1), lambda x: 0)] from pairs where a is not null
        union all
        select log_id, a, b, i + 1, n, list_append(t, n) from (select *, list_reduce(list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: [cast(j as integer)])),
            lambda acc, j: list_append(acc, case when b[j[1]] = a[i + 1] then last[j[1]] + 1 else greatest(acc[len(acc)], last[j[1] + 1]) end)) as n from grown where i < len(a))),
    back(log_id, a, b, t, i, j, said) as (
        select log_id, a, b, t, len(a), len(b), cast([] as varchar[]) from grown where i = len(a)
        union all
        select log_id, a, b, t, case when a[i] = b[j] or t[i + 1][j] <= t[i][j + 1] then i - 1 else i end, case when a[i] = b[j] or t[i + 1][j] > t[i][j + 1] then j - 1 else j end,
            case when a[i] = b[j] then list_prepend(a[i], said) when t[i + 1][j] > t[i][j + 1] then said else list_prepend(chr(1), said) end from back where i > 0 and j > 0),
    walked as (select log_id, t[len(t)][len(t[1])] as length, said from back where i = 0 or j = 0)
    select log_id, cast(length as integer) as length, array_to_string(list_filter(said, lambda x: x <> chr(1) and x <> '*'), ' ') as common,
        array_to_string(list_reduce(list_prepend(cast([] as varchar[]), list_transform(said, lambda x: [x])), lambda acc, x:
            case when x[1] <> chr(1) then list_append(acc, x[1]) when len(acc) > 0 and acc[len(acc)] <> '*' then list_append(acc, '*') else acc end), ' ') as template from walked"""


@query(f"with recursive {_LISTS}, {_LCS}")
def lcs_of_neighbours(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf_dir).select("log_id", similarity.lcs_length(a, b).alias("length"), F.array_join(similarity.lcs_tokens(a, b), " ").alias("common"), F.array_join(similarity.lcs_template(a, b), " ").alias("template"))


# ---- formalizer ---------------------------------------------------------------------------------


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _removed_sql(column: str, removed: list[str]) -> str:
    for p in [*removed, *formal.STAMPS]:
        column = f"regexp_replace({column}, '{_quoted(p)}', '', 'g')"
    return column


def _found_sql(p: str) -> str:
    return f"nullif(regexp_extract(log_txt, '{_quoted(p)}'), '')"


@query(f"""select log_id, coalesce({", ".join(map(_found_sql, formal.STAMPS))}) as "time", {_found_sql(formal.LEVEL)} as level, {_found_sql(formal.MS_ID)} as ms_id,
    {_removed_sql("log_txt", formal.REMOVED_BATCH)} as message from event_type_ansible""")
def formalize_fields(spark, sf_dir):
    return table(spark, sf_dir, "event_type_ansible").select("log_id", *formal.formal_fields(F.col("log_txt")))


@query(f"""select log_id, {_removed_sql("log_txt", formal.REMOVED_STREAM)} as message from event_type_ansible where log_txt is not null""")
def formalize_stream_message(spark, sf_dir):
    return table(spark, sf_dir, "event_type_ansible").where("log_txt is not null").select("log_id", formal.line_message(F.col("log_txt"), formal.REMOVED_STREAM).alias("message"))


@query(r"""with p as (select log_id, regexp_split_to_array(replace("time", '/', '-'), '[,.]') as p from iaas_filtered where "time" is not null)
    select log_id, round(epoch(try_strptime(p[1], '%Y-%m-%d %H:%M:%S')) + case when len(p) > 1 then round(cast('0.' || p[2] as double), 3) else 0 end, 3) as seconds from p""")
def epoch_seconds(spark, sf_dir):
    rows = table(spark, sf_dir, "iaas_filtered").where("time is not null")
    return rows.select("log_id", F.round(formal.epoch_seconds(F.replace("time", F.lit("/"), F.lit("-"))), 3).alias("seconds"))


def _lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def _assembled_sql(source: str, key: str, text: str, start: str, last: bool) -> str:
    return f"""with s as (select {key}, string_split({text}, chr(10)) as a from {source} where {text} is not null),
        n as (select {key}, unnest(a) as line, generate_subscripts(a, 1) as line_no from s),
        m as (select *, sum(case when {start} then 1 else 0 end) over (partition by {key} order by line_no) as record from n),
        r as (select {key}, cast(record as bigint) as record, string_agg(line, ' ' order by line_no) as text from m where record > 0 group by all)
        select {key}, record, text from r""" + ("" if last else f" qualify record < max(record) over (partition by {key})")


@query(_assembled_sql("documents", "doc_id", "text", r"line[1] = chr(92)", True))
def record_assembly(spark, sf_dir):
    lines = _lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return assembly.assembled(lines, "doc_id", "line_no", "line", F.substring("line", 1, 1) == "\\")


@query(_assembled_sql("event_type_ansible", "log_id", "log_txt", "line[1] = '2'", True))
def record_assembly_digit(spark, sf_dir):
    lines = _lines(table(spark, sf_dir, "event_type_ansible"), "log_id", "log_txt")
    return assembly.assembled(lines, "log_id", "line_no", "line", assembly.starts_with_two(F.col("line")))


# written from how a file is read: a line but the last keeps its line end, the first one opens, nothing is put between
_STREAMED = r"""
    with pieces as (select log_id, string_split(log_txt, chr(10)) as a from event_type_ansible where log_txt is not null),
    lines as (select log_id, generate_subscripts(a, 1) as i, unnest(a) as bare, len(a) as n from pieces),
    ended as (select log_id, i, bare, case when i < n then bare || chr(10) else bare end as line from lines),
    judged as (select *, i = 1 or (not (length(line) between 1 and 19) and regexp_matches(left(line, 19), '^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$')
        and try_strptime(regexp_replace(left(line, 19), ':6[01]$', ':00'), '%Y-%m-%d %H:%M:%S') is not null) as opens from ended),
    counted as (select *, count(*) filter (where opens) over (partition by log_id order by i rows unbounded preceding) as record from judged),
    joined as (select log_id, record, replace(string_agg(line, '' order by i), chr(10), '') as text from counted group by all)"""


def _streamed(spark: SparkSession, sf_dir: str, compat: bool) -> DataFrame:
    rows = table(spark, sf_dir, "event_type_ansible").where("log_txt is not null")
    lines = rows.select("log_id", F.posexplode(F.split("log_txt", "\n", -1)).alias("line_no", "line"))
    ended = lines.withColumn("ended", F.lead("line_no").over(W.partitionBy("log_id").orderBy("line_no")).isNotNull())
    return assembly.stream_records(ended, "log_id", "line_no", "line", F.col("ended"), compat)


@query(_STREAMED + r""" select log_id, record, regexp_replace(regexp_replace(text, '(?s)\{.*\}', ''), '(?s)\(.*\)', '') as text from joined qualify record < max(record) over (partition by log_id)""")
def record_assembly_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, True)


@query(_STREAMED + r""" select log_id, record, regexp_replace(regexp_replace(text, '(?s)\{.*\}', ''), '(?s)\(.*\)', '') as text from joined""")
def record_assembly_whole_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, False)


@query(f"""select log_id, {_found_sql(formal.PID)} as pid, {_found_sql(formal.IP)} as ip, {_found_sql(formal.POD_ID)} as pod_id from event_type_ansible where log_txt is not null""")
def line_ids(spark, sf_dir):
    rows, text = table(spark, sf_dir, "event_type_ansible").where("log_txt is not null"), F.col("log_txt")
    return rows.select("log_id", formal.line_pid(text).alias("pid"), formal.line_ip(text).alias("ip"), formal.line_pod_id(text).alias("pod_id"))


# ---- templates ----------------------------------------------------------------------------------


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered(spark, sf_dir).select(tokens.key_layer(F.col("tokens")).alias("k"), "tokens").select("k.pos", "k.key", "tokens")
    return quality.folded_templates(rows, ["pos", "key"])


@query(f"with {_FOLDED} select cast(pos as integer) as pos, key, template, n from folded")
def template_fold(spark, sf_dir):
    return _folded(spark, sf_dir)


def _position_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered(spark, sf_dir).select(tokens.key_layer(F.col("tokens")).alias("k"), "tokens").select("k.pos", "k.key", "tokens")
    return quality.position_counts(rows, ["pos", "key"])


_COUNTED = f"{_PLACES}, counted as (select pos, key, i, token, cast(count(*) as double) as f from places group by all)"


@query(f"with {_COUNTED} select cast(pos as integer) as pos, key, cast(i as integer) as i, round(1 - sum(f * f) / (sum(f) * sum(f)), 9) + 0.0 as gini from counted group by all")
def position_gini(spark, sf_dir):
    return quality.position_gini(_position_counts(spark, sf_dir), ["pos", "key"]).withColumn("gini", F.round("gini", 9) + 0.0)


@query(f"with {_COUNTED} select cast(pos as integer) as pos, key, cast(i as integer) as i, round(ln(sum(f)) - sum(f * ln(f)) / sum(f), 9) + 0.0 as entropy from counted group by all")
def position_entropy(spark, sf_dir):
    return quality.position_entropy(_position_counts(spark, sf_dir), ["pos", "key"]).withColumn("entropy", F.round("entropy", 9) + 0.0)


_KNOWN = "known as (select event_id, string_split(template, ' ') as l from labelled_templates where template is not null)"
_PAIRS = f"""{_KNOWN}, kept as (select event_id, list_filter(l, lambda x: x <> '*' and not contains(x, 'PATTERN_')) as k from known),
    spots as (select event_id, unnest(k) as token, generate_subscripts(k, 1) as i from kept),
    pairs as (select distinct x.event_id, x.token as a, y.token as b from spots x join spots y on x.event_id = y.event_id and x.i < y.i)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labelled_templates").where("template is not null")


@query(f"with {_PAIRS} select event_id, a, b from pairs")
def token_pairs(spark, sf_dir):
    return quality.token_pairs(_known(spark, sf_dir), "event_id", F.split("template", " ", -1))


@query(f"""with {_PAIRS}, size as (select event_id, count(*) as s from pairs group by 1),
    near as (select x.event_id, y.event_id as o, count(*) as n from pairs x join pairs y on x.a = y.a and x.b = y.b and x.event_id <> y.event_id group by all),
    least as (select n.event_id, min(1 - n.n / (s.s + t.s - n.n)) as d from near n join size s on n.event_id = s.event_id join size t on n.o = t.event_id group by 1),
    each as (select k.event_id, len(list_filter(l, lambda x: x <> '*')) / len(l) as c, least(1.0, coalesce(d, 1.0)) as d from known k left join least l2 on k.event_id = l2.event_id)
    select round(avg(c), 9) as compactness, round(avg(d), 9) as distance, round(avg(c) * avg(d), 9) as quality from each""")
def template_quality(spark, sf_dir):
    out = quality.quality(_known(spark, sf_dir), "event_id", F.split("template", " ", -1))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def _mined(name: str, mine, source: str = "events") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if source == "events":
            return mine(rendered(spark, sf_dir)).templates
        rows = table(spark, sf_dir, source).select("log_id", tokens.tokenize(tokens.mask(F.col("message"), "iaas")).alias("tokens"))
        return mine(rows).templates

    QUERIES[name] = run


for _name in ("bsg", "bsgi", "drain", "draga", "spell", "first_fit"):
    _mined(_name, getattr(miners, f"mine_{_name}"))
# Rendered events differ within a bucket in no more than each of these miners tolerates, so their templates are the buckets' folds,
# in the order of their first messages; spell and first fit join all events into what they have in common.
_FOLD_EVENTS = f"""with {_FOLDED}, firsts as (select pos, key, min(log_id) as lo from keyed group by all),
    numbered as (select row_number() over (order by lo) as event, pos, key, template, n from folded join firsts using (pos, key))"""
for _name in ("bsg", "bsgi", "drain", "draga"):
    ORACLE[_name] = _FOLD_EVENTS + " select event, template, n from numbered"
_COMMON = """spots as (select generate_subscripts({0}, 1) as i, unnest({0}) as token from {1}), same as (select i, min(token) as token, count(*) as n from spots group by i having min(token) = max(token))
    select cast(1 as bigint) as event, string_agg(token, ' ' order by i) as template, max(n) as n from same"""
ORACLE["spell"] = f"with {_LISTS}, " + _COMMON.format("l", "lists")
ORACLE["first_fit"] = f"with texts as (select list_filter(regexp_split_to_array(regexp_replace({_MESSAGE}, '[0-9]+', '', 'g'), '\\s+'), lambda x: x <> '') as w from events), " + _COMMON.format("w", "texts")
_mined("bsg_messages", miners.mine_bsg, "iaas_filtered")
_mined("bsgi_messages", miners.mine_bsgi, "iaas_filtered")
_mined("drain_messages", miners.mine_drain, "iaas_filtered")


# A small fixed corpus, with the events its messages were traced to by hand from the definitions of the miners.
CORPUS = [
    "blk 124219214 asa Receive from node 4", "blk 124219214 ffwqwq 1241241 Done to node 4", "blk 124219214 ffwqwq Done to node 4",
    "blk 782174184 Instance raer1421MManf142v Receive from node 356", "Tcp net down daafa aswf qe 1241", "Tcp net down daafa 12 qe 1241",
    "Tcp qws down daafa 214 qe 1241", "Tcp qws down daafa 421 qe 1241", "Tcp qws down daafa 14 qe 1241", "delete block_1", "delete block_3 block_4", "delete block_6",
]
_TRACED = {
    "bsg": [("blk digit_* * * * node digit_*", [1, 3]), ("Tcp * down daafa * qe digit_*", [5, 6, 7, 8, 9]), ("blk digit_* ffwqwq digit_* Done to node digit_*", [2]),
        ("blk digit_* Instance raerdigit_*MManfdigit_*v Receive from node digit_*", [4]), ("delete block_digit_*", [10, 12]), ("delete block_digit_* block_digit_*", [11])],
    "bsgi": [("blk digit_* from node digit_*", [1]), ("blk digit_* to node digit_*", [3]), ("Tcp * down daafa aswf qe digit_*", [5]), ("Tcp * down daafa digit_* qe digit_*", [6, 7, 8, 9]),
        ("blk digit_* ffwqwq digit_* Done to node digit_*", [2]), ("blk digit_* Instance raerdigit_*MManfdigit_*v Receive from node digit_*", [4]), ("delete block_digit_*", [10, 12]), ("delete block_digit_* block_digit_*", [11])],
    "drain": [("blk digit_* * * * node digit_*", [1, 3]), ("blk digit_* * * * * node digit_*", [2, 4]), ("Tcp net down daafa * qe digit_*", [5, 6]), ("Tcp qws down daafa digit_* qe digit_*", [7, 8, 9]),
        ("delete block_digit_*", [10]), ("delete block_digit_* block_digit_*", [11]), ("delete block_digit_*", [12])],
    "draga": [("blk digit_* * * * node digit_*", [1, 3]), ("blk digit_* * * * * node digit_*", [2, 4]), ("Tcp net down daafa * qe digit_*", [5, 6]), ("Tcp qws down daafa digit_* qe digit_*", [7, 8, 9]),
        ("delete block_digit_*", [10, 12]), ("delete block_digit_* block_digit_*", [11])],
    "spell": [("blk digit_* * Receive from node digit_*", [1, 4]), ("blk digit_* ffwqwq * Done to node digit_*", [2, 3]), ("Tcp * down daafa * qe digit_*", [5, 6, 7, 8, 9]), ("delete block_digit_*", [10, 11, 12])],
    "first_fit": [("blk asa Receive from node", [1]), ("blk ffwqwq Done to node", [2, 3]), ("blk Instance raerMManfv Receive from node", [4]), ("Tcp net down daafa aswf qe", [5]), ("Tcp down daafa qe", [6, 7, 8, 9]), ("delete block_", [10, 12]), ("delete block_ block_", [11])],
}
_MINERS = {"bsg": miners.mine_bsg, "bsgi": miners.mine_bsgi, "drain": miners.mine_drain, "draga": miners.mine_draga, "spell": miners.mine_spell, "first_fit": miners.mine_first_fit}


def corpus(spark: SparkSession) -> DataFrame:
    """The fixed corpus, tokenised for all miners."""
    rows = spark.createDataFrame(list(enumerate(CORPUS, 1)), "log_id long, message string")
    return rows.withColumns({"tokens": tokens.tokenize(tokens.mask(F.col("message"), "generic")), "words": tokens.stripped_words(F.col("message"))})


def _golden(name: str) -> None:
    rows = ", ".join(f"({i}, '{t}')" for t, ids in _TRACED[name] for i in ids)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mined = _MINERS[name](corpus(spark))
        return mined.assignments.join(mined.templates, "event").select("log_id", "template")

    QUERIES[f"{name}_golden"], ORACLE[f"{name}_golden"] = run, f"select cast(log_id as bigint) as log_id, template from (values {rows}) v(log_id, template)"


for _name in _TRACED:
    _golden(_name)


@query("select cast(12 as bigint) as log_id, cast(7 as bigint) as event, 'delete block_digit_*' as template")
def classify_golden(spark, sf_dir):
    rows = corpus(spark)
    return miners.classify(rows, rows.where("log_id = 12"))


def _invariants(name: str, same_length: bool) -> None:
    """What any assignment must fulfil, message by message: one event, and each constant of its template at its place."""
    sql = f"""with t as (select log_id, string_split_regex({_masked_sql('iaas', 'message')}, ' |\\.') as l from iaas_filtered where message is not null)
        select log_id, cast(1 as bigint) as events, true as fits from t where len(l) > 0"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "iaas_filtered").select("log_id", tokens.tokenize(tokens.mask(F.col("message"), "iaas")).alias("tokens"))
        mined = _MINERS[name](rows)
        both = mined.assignments.join(mined.templates, "event").join(rows, "log_id")
        t = F.split("template", " ", -1)
        at_place = (F.size(t) == F.size("tokens")) & ~F.exists(F.zip_with(t, "tokens", lambda a, b: (a != "*") & (a != b)), lambda x: x)
        in_order = similarity.is_subsequence(F.filter(t, lambda x: x != "*"), F.col("tokens"))
        return both.groupBy("log_id").agg(F.count("*").alias("events"), F.bool_and(at_place if same_length else in_order).alias("fits"))

    QUERIES[f"{name}_assignments"], ORACLE[f"{name}_assignments"] = run, sql


for _name, _same in (("bsg", True), ("drain", True), ("bsgi", False), ("spell", False)):
    _invariants(_name, _same)


@query()
def first_fit_sweep(spark, sf_dir):
    return miners.first_fit_sweep(rendered(spark, sf_dir))


@query(_FOLD_EVENTS + " select keyed.log_id, event, template from keyed join numbered using (pos, key)")
def classify(spark, sf_dir):
    rows = rendered(spark, sf_dir)
    return miners.classify(rows, rows)


# ---- graphs -------------------------------------------------------------------------------------


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of id, which is that of time here."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("rn"), F.col("event_type").alias("event"), (us / 1e6).alias("time"))


_SERIES = 'series as (select event_id as rn, event_type as event, epoch_us(ts) / 1e6 as "time" from events)'
_VICINITY = f"""{_SERIES}, numbered as (select row_number() over (order by rn) as r, event from series),
    near as (select a.event, b.event as neighbour from numbered a join numbered b on b.r between a.r + 1 and a.r + 3),
    vicinity as (select event, neighbour, count(*) as n from (select event, neighbour from near union all select neighbour, event from near) group by all)"""


@query(f"with {_VICINITY} select event, neighbour, n from vicinity")
def vicinity_counts(spark, sf_dir):
    return graph.vicinity_counts(_series(spark, sf_dir))


@query(f"with {_VICINITY}, gone as (select event from vicinity group by 1 having max(n) <= 2445) select rn, event from series where event not in (select event from gone)")
def operational_filter(spark, sf_dir):
    return graph.without_operational(_series(spark, sf_dir), threshold=2445).select("rn", "event")


_FOUND = f"""{_SERIES}, win as (select a.rn as start, a.event, b.event as successor, arg_min(b."time" - a."time", b.rn) as dt
    from series a join series b on b.rn > a.rn and b."time" >= a."time" and b."time" < a."time" + 1801 and b."time" - a."time" < 1800 and b.event <> a.event
    where a.rn < (select max(rn) from series) group by all)"""


@query(f"""with {_FOUND}, w as (select event, count(*) as w from series where rn < (select max(rn) from series) group by 1),
    kept as (select x.event, x.successor from (select event, successor, count(*) as n from win group by all) x join w on w.event = x.event where x.n / w.w > 0.75)
    select win.event as src, win.successor as dst, round(max(dt), 6) as weight from win join kept on win.event = kept.event and win.successor = kept.successor group by all""")
def cfg_edges(spark, sf_dir):
    series = _series(spark, sf_dir)
    found = graph.supported(graph.successors(series, 1800), series, 0.75)
    return graph.cfg_edges(found).withColumn("weight", F.round("weight", 6))


@query(f"""with {_FOUND}, near as (select a.event, a.successor, a.dt, count(*) as n
        from (select distinct event, successor, dt from win) a join win b on a.event = b.event and a.successor = b.successor and b.dt > a.dt - 60 and b.dt < a.dt + 60 group by all),
    best as (select event, successor, arg_max(dt, (n, dt)) as dt from near group by all)
    select event as src, successor as dst, round(dt, 6) as weight from best where dt > -1 and dt < 150""")
def tfg_edges(spark, sf_dir):
    return graph.tfg_edges(graph.successors(_series(spark, sf_dir), 1800), 60, 150).withColumn("weight", F.round("weight", 6))


# ---- sequences ----------------------------------------------------------------------------------

_BRANDS = "brands as (select l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey)"


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey")


@query(f"with {_BRANDS} select p_brand as event, count(distinct l_orderkey) as frequency from brands group by 1")
def doc_frequency(spark, sf_dir):
    return sequences.document_frequency(_brands(spark, sf_dir), "l_orderkey", "p_brand")


@query(f"""with {_BRANDS}, f as (select p_brand, count(distinct l_orderkey) as frequency from brands group by 1)
    select frequency, count(*) as n_events, string_agg(p_brand, ',' order by p_brand) as events from f group by 1""")
def freq_histogram(spark, sf_dir):
    return sequences.frequency_histogram(_brands(spark, sf_dir), "l_orderkey", "p_brand")


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def first_appearance(spark, sf_dir):
    return sequences.first_appearances(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("""with f as (select event_id, count(distinct deploy_id) as frequency from event_type_ansible where deploy_id is not null group by 1),
    k as (select * from event_type_ansible semi join f on event_type_ansible.event_id = f.event_id and frequency in (3, 4))
    select deploy_id, event_id, log_id from k where deploy_id is not null qualify row_number() over (partition by deploy_id, event_id order by log_id) = 1""")
def window_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "event_type_ansible").where("deploy_id is not null").select("deploy_id", "event_id", "log_id")
    return sequences.aligned(rows, "deploy_id", "event_id", "log_id", [3, 4]).select("deploy_id", "event_id", "log_id")


@query("""with c as (select user_id, event_type, count(*) as n from events group by all)
    select user_id, round(var_pop(n), 6) as variance, max(n) - min(n) as spread from c group by 1""")
def user_count_spread(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.round(F.var_pop("n"), 6).alias("variance"), (F.max("n") - F.min("n")).alias("spread"))


@query("select deploy_id, string_agg(cast(event_id as varchar), ' ' order by log_id) as events from event_type_ansible where deploy_id is not null and event_id is not null group by 1")
def deploy_sequences(spark, sf_dir):
    # a deploy's sequence in one value is what is asked for
    rows = table(spark, sf_dir, "event_type_ansible").where("deploy_id is not null and event_id is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("log_id", "event_id"))), lambda x: x["event_id"].cast("string"))
    return rows.groupBy("deploy_id").agg(F.array_join(parts, " ").alias("events"))


_LENGTHS = "lengths as (select log_id, len(string_split(substr(log_txt, 34), ' ')) as n from event_type_ansible where log_txt is not null)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "event_type_ansible").where("log_txt is not null")
    return rows.select("log_id", "level", F.size(F.split(F.expr("substring(log_txt, 34)"), " ", -1)).cast("long").alias("n"))


@query(f"""with {_LENGTHS} select count(*) as count, round(avg(n), 6) as mean, min(n) as least, max(n) as most, round(stddev_samp(n), 6) as deviation,
    quantile_cont(n, 0.25) as q25, quantile_cont(n, 0.5) as q50, quantile_cont(n, 0.75) as q75 from lengths""")
def length_describe(spark, sf_dir):
    q = [F.percentile("n", p).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return _lengths(spark, sf_dir).agg(F.count("*").alias("count"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.stddev_samp("n"), 6).alias("deviation"), *q)


@query(f"with {_LENGTHS} select round(avg(case when n <= 30 then 1.0 else 0.0 end), 9) as to_30, round(avg(case when n < 1000 then 1.0 else 0.0 end), 9) as below_1000 from lengths")
def length_ratio(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return _lengths(spark, sf_dir).agg(share(F.col("n") <= 30).alias("to_30"), share(F.col("n") < 1000).alias("below_1000"))


@query(f"""with {_LENGTHS}, b as (select min(n) as lo, max(n) as hi from lengths)
    select cast(least(30, 1 + floor((n - lo) * 30.0 / (hi - lo))) as bigint) as bin, count(*) as n from lengths, b group by 1""")
def length_histogram(spark, sf_dir):
    rows = _lengths(spark, sf_dir)
    bounds = rows.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    bin_ = F.least(F.lit(30), 1 + F.floor((F.col("n") - F.col("lo")) * 30.0 / (F.col("hi") - F.col("lo")))).cast("long")
    return rows.join(F.broadcast(bounds)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"with {_LENGTHS} select lengths.log_id, n from lengths join event_type_ansible e on lengths.log_id = e.log_id where e.level = 'INFO' and n < 40")
def short_info(spark, sf_dir):
    return _lengths(spark, sf_dir).where("level = 'INFO' and n < 40").select("log_id", "n")


@query("select distinct event_id from event_type_ansible where event_id is not null except select event_id from labelled_templates")
def setdiff(spark, sf_dir):
    return table(spark, sf_dir, "event_type_ansible").where("event_id is not null").select("event_id").subtract(table(spark, sf_dir, "labelled_templates").select("event_id"))


@query("select log_id, message from iaas_filtered where contains(message, 'Refreshing')")
def contains_filter(spark, sf_dir):
    return table(spark, sf_dir, "iaas_filtered").where(F.col("message").contains("Refreshing")).select("log_id", "message")


@query("select event_id, event_type from events where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-04'")
def day_slice(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-03' and ts < timestamp_ntz'2024-01-04'").select("event_id", "event_type")


@query("select component, count(distinct service) as services, count(*) as n from event_type_ansible where component in ('hubd', 'keeper') group by 1")
def component_values(spark, sf_dir):
    rows = table(spark, sf_dir, "event_type_ansible").where(F.col("component").isin("hubd", "keeper"))
    return rows.groupBy("component").agg(F.countDistinct("service").alias("services"), F.count("*").alias("n"))


@query("select distinct service, component from event_type_ansible")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "event_type_ansible").select("service", "component").distinct()


# ---- next keys ----------------------------------------------------------------------------------

_CODE = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lit(9).cast("long")
    for name, n in _CODE.items():
        code = F.when(F.col("event_type") == name, F.lit(n).cast("long")).otherwise(code)
    return table(spark, sf_dir, "events").select("user_id", "event_id", code.alias("key"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.key_windows(_coded(spark, sf_dir), 2, "user_id", "event_id", "key")


_WINDOWS = f"""coded as (select user_id, event_id, case event_type {" ".join(f"when '{k}' then {v}" for k, v in _CODE.items())} else 9 end as key from events),
    placed as (select user_id, row_number() over w - 1 as pos, count(*) over (partition by user_id) as n, key as k0, lead(key, 1) over w as k1, lead(key, 2) over w as k2
        from coded window w as (partition by user_id order by event_id)),
    windows as (select user_id, pos, k0, k1, k2 from placed where pos < n - 3)"""
_MODEL = f"{_WINDOWS}, counted as (select k0, k1, k2, count(*) as n from windows group by all), model as (select *, n / sum(n) over (partition by k0, k1) as p from counted)"
_RANKED = f"""{_MODEL}, ranked as (select k0, k1, k2, row_number() over (partition by k0, k1 order by p desc, k2) as r from model),
    labels as (select w.user_id, w.pos, case when r.r <= 2 then 0 else 1 end as label from windows w join ranked r on w.k0 = r.k0 and w.k1 = r.k1 and w.k2 = r.k2)"""


@query(f"with {_WINDOWS} select user_id, cast(pos as integer) as pos, concat(k0, ',', k1, ',', k2) as keys from windows")
def key_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", "pos", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"))


@query(f"""with {_WINDOWS}, c as (select *, count(*) over (partition by user_id) as n from windows)
    select user_id, cast(sum(case when pos < round_even(n * 0.9, 0) then 1 else 0 end) as bigint) as n_train, cast(sum(case when pos < round_even(n * 0.9, 0) then 0 else 1 end) as bigint) as n_test from c group by 1""")
def train_test_split(spark, sf_dir):
    rows = _windows(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    flag = sequences.train_flag(F.col("pos"), F.col("n"), 0.9)
    return rows.groupBy("user_id").agg(F.sum(flag.cast("int")).alias("n_train"), F.sum((~flag).cast("int")).alias("n_test"))


@query(f"with {_WINDOWS} select user_id, cast(pos as integer) as pos, round(k1 / k0 - 1, 9) as second, round(k2 / k0 - 1, 9) as third from windows")
def window_normalise(spark, sf_dir):
    v = sequences.normalised(F.col("keys"))
    return _windows(spark, sf_dir).select("user_id", "pos", F.round(v[1], 9).alias("second"), F.round(v[2], 9).alias("third"))


@query(f"with {_MODEL} select concat(k0, ',', k1) as context, cast(k2 as bigint) as next, n, round(p, 9) as p from model")
def ngram_next_key(spark, sf_dir):
    model = nextkey.transition_probabilities(_windows(spark, sf_dir), 2)
    return model.select(F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"), "next", "n", F.round("p", 9).alias("p"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir)
    return nextkey.top_g(nextkey.predicted(nextkey.back_off(windows, 2), windows, 2, ["user_id", "pos"]), ["user_id", "pos"], 2)


@query(f"with {_RANKED} select user_id, cast(pos as integer) as pos, label from labels")
def topg_anomaly(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(f"with {_RANKED} select round(avg(case when label = 0 then 1.0 else 0.0 end), 9) as accuracy from labels")
def accuracy(spark, sf_dir):
    return nextkey.normal_share(_labels(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query()
def workflow_edges(spark, sf_dir):
    return nextkey.workflow_edges(_windows(spark, sf_dir), 2, [1, 5])


def _deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each deploy in order of arrival."""
    rows = table(spark, sf_dir, "event_type_ansible").where("deploy_id is not null and event_id is not null")
    return sequences.placed(rows.select("deploy_id", "log_id", "event_id"), "deploy_id", "log_id").select(F.col("deploy_id").alias("seq"), "pos", F.col("event_id").alias("item"))


@query("""with s as (select deploy_id as seq, row_number() over (partition by deploy_id order by log_id) - 1 as pos, event_id as item
        from event_type_ansible where deploy_id is not null and event_id is not null),
    t as (select *, row_number() over (partition by seq order by pos desc) as b from s qualify b <= 5),
    aims as (select seq as target, list(distinct item) as own, arg_max(item, pos) as last from t group by 1),
    items as (select distinct seq as target, item from t), need as (select target, count(*) as k from items group by 1),
    alike as (select i.target, h.seq from items i join (select distinct seq, item from s) h on i.item = h.item join need on need.target = i.target group by all having count(*) = max(need.k)),
    many as (select target, count(*) as m from alike group by 1),
    ends as (select seq, item, max(pos) as spot from s where pos >= 1 group by all),
    follow as (select x.target, x.seq, s.pos, s.item from alike x join aims a on x.target = a.target join ends e on e.seq = x.seq and e.item = a.last
        join s on s.seq = x.seq and s.pos > e.spot where not list_contains(a.own, s.item)),
    after as (select *, row_number() over (partition by target, seq order by pos) as d from follow),
    total as (select a.target, a.item, sum(ln(1 + 1 / m + 0.001 / d)) as log_score from after a join many on a.target = many.target group by all)
    select target, item, round(log_score, 6) as log_score from total qualify row_number() over (partition by target order by round(log_score, 9) desc, item) <= 3""")
def cpt_predict(spark, sf_dir):
    rows = staged(_deploys(spark, sf_dir), "deploys")
    return sequences.predict_next(rows, rows, k=5, n=3).withColumn("log_score", F.round("log_score", 6))


# ---- labels -------------------------------------------------------------------------------------

_LABELS = """std as (select log_id, min(event) as ey from standard_labels group by 1), own as (select l.log_id, coalesce(i.level, '') as ex from std l join iaas_filtered i on l.log_id = i.log_id),
    cells as (select ex, ey, count(*) as i from own join std on own.log_id = std.log_id group by all),
    f as (select *, sum(i) over (partition by ex) as g, sum(i) over (partition by ey) as f from cells)"""


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "standard_labels").groupBy("log_id").agg(F.min("event").alias("event"))


@query(f"""with {_LABELS} select round(sum(((i / g) * (i / g) + sqrt(i / f)) / 2 * i) / sum(i), 9) as squared_fit, round(sum((i / g + i / f) / 2 * i) / sum(i), 9) as mean_fit from f""")
def label_agreement(spark, sf_dir):
    standard = _standard(spark, sf_dir)
    own = table(spark, sf_dir, "iaas_filtered").join(standard.select("log_id"), "log_id").select("log_id", F.coalesce("level", F.lit("")).alias("event"))
    return quality.agreement(own, standard).select(F.round("squared_fit", 9).alias("squared_fit"), F.round("mean_fit", 9).alias("mean_fit"))


@query("""with std as (select log_id, min(event) as event from standard_labels group by 1),
    rows as (select i.log_id, i.message, std.event from iaas_filtered i left join std on i.log_id = std.log_id),
    ex as (select event, arg_min_null(message, log_id) as example from rows group by 1)
    select rows.log_id, rows.event, t.template, ex.example from rows left join labelled_templates t on rows.event = t.event_id left join ex on rows.event = ex.event""")
def label_writeback(spark, sf_dir):
    templates = table(spark, sf_dir, "labelled_templates").select(F.col("event_id").alias("event"), "template")
    return quality.written_back(table(spark, sf_dir, "iaas_filtered").select("log_id", "message"), _standard(spark, sf_dir), templates, "message").select("log_id", "event", "template", "example")
