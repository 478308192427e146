"""Every query with a SQL counterpart against DuckDB; the others must run."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def _plain(rows):
    return sorted(tuple("~" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_oracle(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    want = duck.sql(contract.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = duck.sql(f"select {quoted} from ({contract.oracle_sql()[name]})").fetchall()
    assert _plain(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == _plain(rows)


#: Rows that the queries without SQL must give at this scale: one per message, field, document or option.
SIZES = {
    "classify": "select count(*) from events", "lcs_of_neighbours": "select count(*) - 1 from events", "first_fit_sweep": "select 9",
    "p3_found": None, "p3_entries": None, "p6_instants": "select count(*) from event_type_ansible", "p6_zones_held_out": "select count(distinct ip) from node_zones",
    "p8_ids": "select count(*) from documents", "p9_mix": "select count(*) from documents", "p9_shares": "select count(distinct replace(lower(trim(source)), '-', '_')) from mix_targets",
    "p10_makeup": "select count(distinct subject) from subject_areas",
}


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.count()
    if SIZES.get(name):
        assert rows == duck.sql(SIZES[name]).fetchall()[0][0]
    else:
        assert rows > 0 or name == "p10_found"
    assert got.distinct().count() == rows if not any(f.dataType.typeName() in ("array", "map") for f in got.schema) else True


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_neighbours_across_missing_ids(spark, tmp_path):
    duck = duckdb.connect()
    duck.sql(f"copy (select * from '{SF}/events.parquet' where event_id % 7 <> 3 and event_id < 100) to '{tmp_path}/events.parquet' (format parquet)")
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = duck.sql(f"select log_id, jaccard, equal_positions, differing, merged from ({contract.oracle_sql()['similarity_of_neighbours']})").fetchall()
    got = contract.queries()["similarity_of_neighbours"](spark, str(tmp_path)).select("log_id", "jaccard", "equal_positions", "differing", "merged").collect()
    assert len(want) == 85 and _plain(got) == _plain(want)
    assert sorted(r.log_id for r in contract.queries()["lcs_of_neighbours"](spark, str(tmp_path)).collect()) == sorted(r[0] for r in want)
