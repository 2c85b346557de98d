import datetime as dt

import duckdb
import pytest

from tidemark import ingest_queries, queries
from tidemark.plans.planner import Request

USERS = 1100


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Events of more users than the default ceiling has series."""
    folder = str(tmp_path_factory.mktemp("many"))
    at = dt.datetime(2024, 1, 7)
    rows = [(i, at + dt.timedelta(seconds=37 * i), i % USERS, "click", float(i % 90)) for i in range(3 * USERS)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def users(rows):
    return rows.select("user_id").distinct().count()


def test_default_ceiling_leaves_no_series_out(spark, sf_dir):
    assert users(queries.queries()["series_isolated"](spark, sf_dir)) == USERS


def test_named_ceilings_hold(spark, sf_dir):
    p, request = queries.planner(spark, sf_dir), Request(0, queries.LAST_MS)
    text = "FROM events SELECT value BY user_id EVERY 1d"
    assert [n.code for n in p.run(text, request).late_notes()] == ["W401"]
    assert users(p.run(f"{text} LIMIT SERIES 1000", request).rows) == 1000
    assert users(p.run(text, Request(0, queries.LAST_MS, max_series=7)).rows) == 7


def test_negated_series_are_all_drawn(spark, sf_dir):
    assert users(queries.queries()["series_negate"](spark, sf_dir)) == USERS


def test_filtered_series_are_all_drawn(spark, sf_dir):
    assert users(queries.queries()["where_equal"](spark, sf_dir)) == USERS


def test_output_bound_counts_all_series(spark, sf_dir):
    assert [tuple(r) for r in ingest_queries.queries()["output_bound"](spark, sf_dir).collect()] == [(USERS, 0)]


def test_output_bound_is_of_points_before_padding(spark, tmp_path):
    at = dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(milliseconds=ingest_queries.FROM)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    # Every sample stands alone between breaks; of user 2 none has a value, one sample has no user.
    dense = [(i, at + dt.timedelta(seconds=400 * i), 1, "click", float(i * 7919 % 101)) for i in range(2400)]
    rows = [*dense, (2400, at, 2, "click", None), (2401, at, None, "click", 1.0)]
    for name, some, wanted in (("dense", rows, (2, 0)), ("empty", [], (0, 0))):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert [tuple(r) for r in ingest_queries.queries()["output_bound"](spark, f"{tmp_path}/{name}").collect()] == [wanted]


def same_as_sql(spark, sf_dir, name):
    """Rows that only the query or only its SQL has: none."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    wanted = con.execute(queries.oracle_sql()[name]).fetchall()
    found = [tuple(r) for r in queries.queries()[name](spark, sf_dir).collect()]
    assert wanted and sorted(found, key=repr) == sorted(wanted, key=repr)


def test_negated_series_are_those_of_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "series_negate")


def test_filtered_series_are_those_of_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "where_equal")
