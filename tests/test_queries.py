"""Every named query against its DuckDB twin, on the smallest tables."""

import duckdb
import pytest

from leadline import queries as q

TABLES = ["customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(q.SQL))
def test_query_is_its_twin(spark, sf, duck, name):
    df = q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(q.SQL[name]).columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({q.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.SQL])
def test_query_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_known_states_of_the_fixture(spark):
    """Numbers that a direct model of the cell algorithm gives for sf0.01."""
    sf = "/root/testdata/sf0.01"
    once = {r.change_state: r["count"] for r in q.QUERIES["surface_cells"](spark, sf).groupBy("change_state").count().collect()}
    assert once == {"stable": 557, "suspected_shoaling": 421, "candidate_deepening": 22}
    twice = {r.change_state: r["count"] for r in q.QUERIES["incremental_cells"](spark, sf).groupBy("change_state").count().collect()}
    assert twice == {"stable": 543, "suspected_shoaling": 349, "confirmed": 88, "candidate_deepening": 20}
