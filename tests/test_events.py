"""Events a few microseconds around the bars' boundaries: every query rounds their moments as its SQL does."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.plans import catalogue, fixtures

AROUND = (-1000, -501, -500, -499, -1, 0, 1, 499, 500, 501, 1000)
TYPES = ("click", "error", "purchase", "signup", "view")


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Every sixth hour from 4 January to 2 February, with its month's, weeks' and the request's bounds; all types."""
    folder = tmp_path_factory.mktemp("edges")
    at = [datetime(2024, 1, 4) + timedelta(hours=h, microseconds=us) for h in range(0, 30 * 24, 6) for us in AROUND]
    ids = list(range(len(at)))
    rows = {
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([i % 7 for i in ids], pa.int64()),
        "event_type": [TYPES[i % 5] for i in ids], "value": [1.0 + i % 97 for i in ids], "props": [""] * len(ids),
    }
    pq.write_table(pa.table(rows), folder / "events.parquet")
    return str(folder)


def test_milliseconds_are_the_nearest_or_the_one_begun(spark):
    us = [-1500, -1499, -501, -500, -499, -1, 0, 499, 500, 1499, 1500, None]
    rows = spark.createDataFrame([(u,) for u in us], "us long").withColumn("ts", F.expr("cast(timestamp_micros(us) AS timestamp_ntz)"))
    told = {r["us"]: (r["near"], r["begun"]) for r in rows.select("us", fixtures.event_ms().alias("near"), fixtures.begun_ms().alias("begun")).collect()}
    near, begun = [-2, -1, -1, -1, 0, 0, 0, 0, 1, 1, 2, None], [-2, -2, -1, -1, -1, -1, 0, 0, 0, 1, 1, None]
    assert told == dict(zip(us, zip(near, begun, strict=True), strict=True))


@pytest.mark.parametrize("name", [
    "tb_floor_week", "tb_floor_month", "tb_next_boundary_week", "tb_next_boundary_month",
    "bars_canonical", "bars_hourly", "live_backwards", "merge_upsert",
    "q_findings", "q_gap_warnings", "q_ordering", "store_merge",
    "tb_at_or_after", "tb_floor_5m", "tb_previous_boundary", "window_evidence",
])
def test_boundaries_fall_as_in_the_sql(spark, edges, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW events AS SELECT * FROM '{edges}/events.parquet'")
        wanted = connection.execute(catalogue.SQL[name])
        columns, wanted = [c[0] for c in wanted.description], wanted.fetchall()
    found = [tuple(r) for r in catalogue.QUERIES[name](spark, edges).select(*[f"`{c}`" for c in columns]).collect()]
    assert wanted and sorted(found, key=repr) == sorted(wanted, key=repr)
