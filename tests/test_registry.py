import glob
import os

import duckdb
import pytest

from quayside.plans import dialect, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(values):
    return sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_render_fills_nested_calls():
    sql = "select @div(@micros(ts), 4) from @table(events)"
    assert dialect.render(sql, dialect.Duck()) == "select ((epoch_us(ts)) // (4)) from events"


def test_structure_queries(spark):
    known = registry.queries()
    got = known["structure_nodes"](spark, FOLDER)
    members = got.selectExpr("inst", "generation", "explode(split(members, ',')) as level_id")
    assert members.count() == members.distinct().count() > 0
    assert got.where("low > high or center < low or center > high").isEmpty()
    assert known["price_in_structure"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()
