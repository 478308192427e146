"""Queries of the general problems 3, 6 and 7 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.instants import LEVELS, level_name
from logloom.operators.instants import estimated_zones, held_out_zones, instants, listed_zones, read_once
from logloom.operators.loglines import entries
from logloom.operators.skew import CHUNK_ROWS, by_field, key_figures
from logloom.session import table

#: Columns of the business log that its instants are read from.
STAMP_COLUMNS = ["log_id", "time", "ip", "log_txt"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants that the stamps denote; those of nodes without known zone are no cases (see p6_instants)."""
    log = table(spark, sf_dir, "event_type_ansible").select(*STAMP_COLUMNS)
    rows = instants(log, table(spark, sf_dir, "node_zones"), keep=["log_id"])
    return rows.where(F.col("basis").isin("absolute", "catalog")).select("log_id", "utc_us")


def p6_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with their basis, those by estimated zones included."""
    log = table(spark, sf_dir, "event_type_ansible").select(*STAMP_COLUMNS)
    return instants(log, table(spark, sf_dir, "node_zones"), keep=["log_id"])


def p6_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones estimated for the nodes that node_zones lacks."""
    log, zones = table(spark, sf_dir, "event_type_ansible").select(*STAMP_COLUMNS), table(spark, sf_dir, "node_zones")
    return estimated_zones(read_once(log, zones, ["log_id"]), listed_zones(zones)).select(F.col("__node").alias("ip"), F.col("__tz").alias("tz"), "n", "violations")


def p6_zones_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well zones are estimated: those of all listed nodes, hidden and estimated."""
    log = table(spark, sf_dir, "event_type_ansible").select(*STAMP_COLUMNS)
    return held_out_zones(log, table(spark, sf_dir, "node_zones"))


def p7_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last instant and distinct levels of every event and every deploy."""
    log = table(spark, sf_dir, "event_type_ansible").select(*STAMP_COLUMNS, "deploy_id", "event_id", "level")
    rows = instants(log, table(spark, sf_dir, "node_zones"), estimate=False)
    slim = by_field(rows, ["deploy_id", "event_id"], F.col("utc_us"), level_name(F.col("level")).alias("level"))
    return key_figures(slim, ["field", "key_value"], "utc_us", "level").withColumnRenamed("n_labels", "n_levels")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least 3 % of all rows."""
    total = table(spark, sf_dir, "event_type_ansible").agg(F.count("*").alias("_total"))
    figures = p7_figures(spark, sf_dir).where("key_value is not null")
    return figures.join(F.broadcast(total)).where(F.col("n_rows") / F.col("_total") >= 0.03).select("field", "key_value")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log fields of both tables for the entry parser."""
    log = table(spark, sf_dir, "event_type_ansible").select(F.lit("event_type_ansible").alias("log_source"), "log_id", F.col("log_txt").alias("text"), F.lit(True).alias("lines"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("ms_id"))
    return log.unionByName(table(spark, sf_dir, "iaas_filtered").select(F.lit("iaas_filtered").alias("log_source"), "log_id", F.col("message").alias("text"), F.lit(False).alias("lines"), "level", "ms_id"))


def p3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its stamp and message as well."""
    return entries(_fields(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, component and request id of every entry."""
    return p3_entries(spark, sf_dir).select("log_source", "log_id", "entry_no", "level", "component", "ms_id")


QUERIES = {"p3_found": p3_found, "p3_entries": p3_entries, "p6_found": p6_found, "p6_instants": p6_instants, "p6_zones": p6_zones, "p6_zones_held_out": p6_zones_held_out, "p7_found": p7_found, "p7_figures": p7_figures}

#: SQL of the instants, written for itself: other patterns, other functions, zones by the database's own history.
INSTANTS = r"""
    nodes as (select ip, min(tz) as tz from node_zones where ip is not null and tz is not null group by ip having count(distinct tz) = 1),
    texts as (select e.log_id, n.tz, unnest([1, 2]) as pick, unnest(["time", regexp_extract(log_txt,
            '^\s*(?:\{(?:.*?,)?\s*"(?:@timestamp|timestamp|time|ts)"\s*:\s*"|\[|(?:\w+=\w+ )?ts=|\w+\|)?(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|\s?[+-]\d{2}:?\d{2})?)(?:[\s\]|",]|$)', 1)]) as x
        from event_type_ansible e left join nodes n on e.ip = n.ip),
    ends as (select log_id, tz, pick, trim(x) as x, regexp_extract(trim(x), ':\d\d(?:[.,]\d+)?(?:\s*[A-Za-z]+)?\s*([+-]\d\d:?\d\d)$', 1) as o from texts),
    bare as (select *, trim(left(x, length(x) - length(o))) as y from ends),
    named as (select *, upper(regexp_extract(y, '(?:\d|\s)([A-Za-z]+)$', 1)) as z0 from bare),
    zoned as (select *, case when z0 in ('AM', 'PM') then '' else z0 end as z from named),
    timed as (select *, trim(left(y, length(y) - length(z))) as w, regexp_extract(y, ':\d\d[.,](\d+)', 1) as f from zoned),
    clock as (select *, try_strptime(regexp_replace(w, '(:\d\d)[.,]\d+', '\1'), ['%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%d.%m.%Y %H:%M:%S', '%Y%m%dT%H%M%S', '%b %d, %Y %I:%M:%S %p', '%a, %d %b %Y %H:%M:%S']) as shown,
        regexp_replace(x, '[.,].*', '') as whole, regexp_extract(x, '^\d+[.,](\d+)$', 1) as rest from timed),
    stamps as (select log_id, tz, pick,
        case when regexp_matches(x, '^(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})([.,]\d+)?$') then
                cast(left(whole, 9 + case when length(whole) % 3 = 1 then 1 else 0 end) as bigint) * 1000000 + cast(rpad(substr(whole || rest, 10 + case when length(whole) % 3 = 1 then 1 else 0 end, 6), 6, '0') as bigint)
            when z in ('', 'Z', 'UTC', 'GMT', 'CET', 'CEST', 'EST', 'EDT') then epoch_us(shown) + cast(rpad(left(f, 6), 6, '0') as bigint) end as local,
        case when regexp_matches(x, '^\d+([.,]\d+)?$') then 0
            when o <> '' then (case when left(o, 1) = '-' then -1 else 1 end) * (cast(substr(o, 2, 2) as bigint) * 60 + cast(right(o, 2) as bigint)) * 60000000
            when z in ('Z', 'UTC', 'GMT') then 0 when z = 'CET' then 3600000000 when z = 'CEST' then 7200000000 when z = 'EST' then -18000000000 when z = 'EDT' then -14400000000 end as off from clock),
    walls as (select *, make_timestamp(local) as wall, case when off is null and local is not null and tz is not null then timezone(tz, make_timestamp(local)) end as u from stamps),
    read as (select log_id, pick, case when off is not null then local - off
        when timezone(tz, u) = wall and timezone(tz, u + interval 1 hour) <> wall and timezone(tz, u - interval 1 hour) <> wall then epoch_us(u) end as utc_us from walls),
    instants as (select log_id, arg_min(utc_us, pick) filter (where utc_us is not null) as utc_us from read group by log_id having count(utc_us) > 0)"""
_LEVELS = " ".join(f"when upper(trim(level)) in ({', '.join(repr(w) for w in words)}) then '{name}'" for name, words in LEVELS.items())

# Entries (problem 3) and estimated zones have no SQL; tests hold them against brute force and hidden zones.
ORACLE = {
    "p6_found": f"with {INSTANTS} select log_id, utc_us from instants",
    "p7_figures": f"""with {INSTANTS}, e as (select e.*, i.utc_us, case {_LEVELS} end as named from event_type_ansible e left join instants i on e.log_id = i.log_id),
        fields as (select 'deploy_id' as field, deploy_id as key_value, utc_us, named from e union all select 'event_id', event_id, utc_us, named from e)
        select field, key_value, count(*) as n_rows, min(utc_us) as first_us, max(utc_us) as last_us, count(distinct named) as n_levels, (count(*) + {CHUNK_ROWS - 1}) // {CHUNK_ROWS} as n_chunks from fields group by all""",
    "p7_found": """
        with n as (select count(*) total from event_type_ansible)
        select 'deploy_id' as field, deploy_id as key_value from event_type_ansible, n where deploy_id is not null group by deploy_id, total having count(*) >= 0.03 * total
        union all
        select 'event_id' as field, event_id as key_value from event_type_ansible, n where event_id is not null group by event_id, total having count(*) >= 0.03 * total""",
}
