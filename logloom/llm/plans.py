"""Queries of this subpackage over the test tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.encode import encoded, token_sizes
from logloom.llm.mix import mixed, shares, source_name
from logloom.llm.near import similar_pairs
from logloom.llm.runs import PENALTY, STRICT, near_events, segments, without_redelivered
from logloom.llm.subsequences import frequent_triples
from logloom.llm.subjects import makeup, subjects_of
from logloom.llm.terms import term_counts, terms, value
from logloom.operators.instants import instants
from logloom.plans.dealt import INSTANTS
from logloom.session import staged, table


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "event_type_ansible").where("deploy_id is not null and event_id is not null")
    rows = instants(log, table(spark, sf_dir, "node_zones"), estimate=False).where("utc_us is not null")
    return without_redelivered(rows, ["deploy_id", "event_id", "utc_us"], [c for c in log.columns if c != "log_id"])


def _runs(spark: SparkSession, sf_dir: str, penalty: float) -> DataFrame:
    near = near_events(table(spark, sf_dir, "labelled_templates"))
    return segments(_event_rows(spark, sf_dir), "deploy_id", "event_id", "utc_us", near, penalty)


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of the same event as one event with its count and duration, runs of one row included."""
    return _runs(spark, sf_dir, STRICT).withColumnRenamed("entity", "deploy_id").drop("part", "ord")


def p2_near_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of nearly the same events as one event with its count and duration."""
    return _runs(spark, sf_dir, PENALTY).withColumnRenamed("entity", "deploy_id").drop("part", "ord")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more rows."""
    return p2_runs(spark, sf_dir).where("n >= 2").select("deploy_id", "first_log_id", "last_log_id")


def p5_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent triples of events with their support."""
    return frequent_triples(_runs(spark, sf_dir, STRICT))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent triples."""
    return p5_triples(spark, sf_dir).select("event_a", "event_b", "event_c")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, rows and mark of every event id and every term of the messages."""
    ids = table(spark, sf_dir, "event_type_ansible").select(F.lit("event_id").alias("field"), F.col("event_id").cast("string").alias("text"))
    messages = table(spark, sf_dir, "iaas_filtered").select(F.lit("message").alias("field"), F.col("message").alias("text"))
    return term_counts(ids.unionByName(messages), {"event_id": value, "message": terms})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p1_terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "event_type_ansible").select(F.lit("event_type_ansible").alias("grp"), "log_id", F.col("log_txt").alias("text"))
    return log.unionByName(table(spark, sf_dir, "iaas_filtered").select(F.lit("iaas_filtered").alias("grp"), "log_id", F.col("message").alias("text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows with nearly the same long text."""
    return similar_pairs(_texts(spark, sf_dir)).withColumnRenamed("grp", "log_source")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix; documents that aren't used have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    sizes = staged(token_sizes(docs, ["doc_id", "source"]), "sizes")
    return mixed(sizes, table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the mix by source."""
    return shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return subjects_of(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p10_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject."""
    return makeup(p10_found(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"))


QUERIES = {"p10_found": p10_found, "p10_makeup": p10_makeup, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p1_found": p1_found, "p1_terms": p1_terms, "p4_found": p4_found, "p2_found": p2_found, "p2_runs": p2_runs, "p2_near_runs": p2_near_runs, "p5_found": p5_found, "p5_triples": p5_triples}
_TERMS = r"""
    with words as (
        select 'event_id' as field, log_id, cast(event_id as varchar) as term from event_type_ansible where event_id is not null
        union all
        select 'message', log_id, trim(unnest(regexp_extract_all(lower(message), '[\p{L}\p{Nd}_.\-]+')), '_-.') from iaas_filtered where message is not null),
    totals as (select 'event_id' as field, count(event_id) as n from event_type_ansible union all select 'message', count(message) from iaas_filtered),
    counted as (
        select w.field, w.term, count(*) as occurrences, count(distinct w.log_id) as records, min(t.n) as n
        from words w join totals t on w.field = t.field where w.field = 'event_id' or (w.term <> '' and not regexp_matches(w.term, '\p{Nd}')) group by 1, 2),
    marked as (select field, term, occurrences, records, case when records < 5 then 'rare' when records > 0.05 * n then 'common' end as mark from counted)
    """

_RUNS = INSTANTS + r""",
    said as (select e.*, i.utc_us from event_type_ansible e join instants i on e.log_id = i.log_id where deploy_id is not null and event_id is not null),
    once as (select deploy_id, event_id, utc_us, min(log_id) as log_id from said group by "time", deploy_id, service, component, event_id, level, ip, log_txt, utc_us),
    letters as (select event_id, min(regexp_replace(lower(template), '\P{L}+', '', 'g')) as l from labelled_templates group by 1),
    same as (select event_id, min(event_id) over (partition by l) as event from letters where l is not null),
    placed as (select o.deploy_id, o.utc_us, o.log_id, coalesce(s.event, o.event_id) as event from once o left join same s on o.event_id = s.event_id),
    marked as (select *, case when lag(event) over w = event then 0 else 1 end as starts from placed window w as (partition by deploy_id order by utc_us, log_id)),
    grouped as (select *, sum(starts) over (partition by deploy_id order by utc_us, log_id rows unbounded preceding) as run from marked),
    runs as (select deploy_id, run, min(event) as event, count(*) as n, min(utc_us) as first_us, max(utc_us) as last_us, arg_min(log_id, (utc_us, log_id)) as first_log_id, arg_max(log_id, (utc_us, log_id)) as last_log_id
        from grouped group by deploy_id, run)"""
_TRIPLES = f"""with {_RUNS}, total as (select count(distinct deploy_id) as n from runs),
    found as (select distinct a.deploy_id, a.event as event_a, b.event as event_b, c.event as event_c from runs a
        join runs b on a.deploy_id = b.deploy_id and b.run between a.run + 1 and a.run + 4 and b.event <> a.event
        join runs c on b.deploy_id = c.deploy_id and c.run between b.run + 1 and b.run + 4 and c.event <> a.event and c.event <> b.event),
    counted as (select event_a, event_b, event_c, count(*) as support from found group by all)
    select event_a, event_b, event_c, support from counted, total where support >= 4 and support >= 0.1 * n"""
# all pairs of long texts that share a word, with the words they share
_NEAR = r"""with texts as (select 'event_type_ansible' as log_source, log_id, log_txt as t from event_type_ansible union all select 'iaas_filtered', log_id, message from iaas_filtered),
    words as (select log_source, log_id, unnest(list_filter(regexp_split_to_array(lower(t), '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), lambda x: x <> '')) as w from texts),
    counts as (select log_source, log_id, w, count(*) as k from words group by all),
    long as (select log_source, log_id, sum(k) as n from counts group by all having sum(k) >= 60),
    held as (select c.*, l.n from counts c join long l on c.log_source = l.log_source and c.log_id = l.log_id),
    shared as (select a.log_source, a.log_id as log_id_a, b.log_id as log_id_b, sum(least(a.k, b.k)) as common, any_value(a.n + b.n) as n
        from held a join held b on a.log_source = b.log_source and a.w = b.w and a.log_id < b.log_id group by all)
    select log_source, log_id_a, log_id_b from shared where common >= 0.75 * (n - common)"""

# No SQL: mixing (random), near runs, encoding and subjects; tests hold them against brute force, round trips and held-out labels.
ORACLE: dict[str, str] = {
    "p2_found": f"with {_RUNS} select deploy_id, first_log_id, last_log_id from runs where n >= 2",
    "p2_runs": f"with {_RUNS} select deploy_id, event, n, first_us, last_us, first_log_id, last_log_id, last_us - first_us as duration_us from runs",
    "p4_found": _NEAR,
    "p5_found": f"select event_a, event_b, event_c from ({_TRIPLES})",
    "p5_triples": _TRIPLES,
    "p1_terms": _TERMS + "select field, term, occurrences, records, mark from marked",
    "p1_found": _TERMS + "select field, term, mark from marked where mark is not null",
}
