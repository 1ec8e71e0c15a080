from datetime import UTC, datetime, timedelta

import pytest
from conftest import SF
from pyspark.sql import functions as F

from barloom.functions.timebar import TimeBar
from barloom.model import CoverageError, ProviderError
from barloom.operators import coverage, quality, reading
from barloom.schema import BARS
from barloom.streaming import live

H = 3_600_000
T0 = datetime(2024, 1, 1, tzinfo=UTC)
FIELDS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BARS) + ", seq long"


def bars(spark, offsets, timeframe="1m", **columns):
    rows = []
    for i, minutes in enumerate(offsets):
        base = {"open": 100.0, "high": 101.0, "low": 99.0, "close": 100.5, "volume": 10.0} | {k: v[i] for k, v in columns.items()}
        rows.append(("sim", "A/B", "spot", None, timeframe, T0 + timedelta(minutes=minutes), *base.values(), i))
    return spark.createDataFrame(rows, FIELDS)


def codes(df, **bounds):
    return {(r["code"], r["row_count"]) for r in quality.findings(df, "1m", ["symbol"], **bounds).collect()}


def test_quality_codes(spark):
    assert codes(bars(spark, [0, 1, 2])) == set()
    inf = float("inf")
    assert codes(bars(spark, [0, 1], open=[-inf, 100.0], low=[-inf, 99.0])) == {("price.non_finite:open", 1), ("price.non_positive:open", 1), ("price.non_finite:low", 1), ("price.non_positive:low", 1)}
    assert codes(bars(spark, [0, 1], low=[102.0, 99.0])) == {("ohlc.invariant_violation", 1)}
    assert codes(bars(spark, [0, 1], volume=[None, -1.0])) == {("null.disallowed:volume", 1), ("volume.negative", 1)}
    assert codes(bars(spark, [0, 0])) == {("identity.duplicate", 1), ("timestamp.non_monotonic", 1)}
    assert codes(bars(spark, [1, 0])) == {("timestamp.unordered", 1)}
    assert codes(bars(spark, [0, 1, 5])) == {("coverage.timeframe_gap", 3)}
    assert codes(bars(spark, [0, 0.5])) == {("timestamp.off_timeframe_boundary", 1)}
    assert codes(bars(spark, [0, 1], close=[100.5, 100.9], high=[101.0, 101.0]), start=0, end=int(T0.timestamp() * 1000) + 60_000) == {("range.out_of_request", 1)}
    assert codes(bars(spark, [0, 1], close=[100.0, 500.0], high=[101.0, 500.0])) == {("statistics.outlier_return", 1)}
    assert {c for _, c, _ in quality.schema_findings(bars(spark, [0]).drop("open").withColumn("x", F.lit(1)).schema)} == {"schema.missing_columns", "schema.unexpected_columns"}
    with pytest.raises(ProviderError, match="volume.negative"):
        quality.enforce(bars(spark, [0], volume=[-1.0]), "1m", ["symbol"])


def segments(spark, *rows):
    return spark.createDataFrame([("k", a * H, b * H, s) for a, b, s in rows], "symbol string, start long, end long, status string")


def told(df):
    return sorted((r["start"] // H, r["end"] // H, r["status"][0]) for r in df.collect())


def test_coverage_algebra(spark):
    k = ["symbol"]
    both = [(0, 4, "unavailable"), (1, 3, "available")]
    expected = [(0, 1, "u"), (1, 3, "a"), (3, 4, "u")]
    assert told(coverage.normalize(segments(spark, *both), k)) == told(coverage.normalize(segments(spark, *both[::-1]), k)) == expected
    assert told(coverage.normalize(segments(spark, (0, 1, "available"), (1, 2, "available"), (2, 3, "available")), k)) == [(0, 3, "a")]
    assert told(coverage.apply_update(segments(spark, (0, 2, "available")), segments(spark, (1, 3, "unavailable"), (3, 5, "available")), k)) == [(0, 2, "a"), (2, 3, "u"), (3, 5, "a")]
    request = spark.createDataFrame([("k", 0, 3 * H)], "symbol string, start long, end long")
    assert told(coverage.covered_and_gaps(segments(spark, (1, 2, "unavailable")), request, k)) == [(0, 1, "m"), (1, 2, "u"), (2, 3, "m")]
    assert told(coverage.covered_and_gaps(segments(spark, (9, 10, "available")), request, k)) == [(0, 3, "m")]


@pytest.mark.parametrize("gaps, budget, expected", [
    ([], 10, []), ([(1, 2), (3, 4), (5, 6)], 10, [(1, 6, 3)]), ([(0, 1), (5, 6), (10, 11)], 6, [(0, 6, 2), (10, 11, 1)]), ([(0, 1), (5, 6)], 6, [(0, 6, 2)]), ([(0, 100)], 10, [(0, 100, 1)]),
])
def test_fetch_windows(spark, gaps, budget, expected):
    found = coverage.fetch_windows(segments(spark, *[(a, b, "missing") for a, b in gaps]), "1h", ["symbol"], budget).collect()
    assert sorted((r["start"] // H, r["end"] // H, r["members"]) for r in found) == expected
    with pytest.raises(ValueError):
        coverage.fetch_windows(segments(spark), "1h", ["symbol"], 0)


@pytest.mark.parametrize("timeframe, start, end, months", [
    ("1h", (2024, 1, 31, 23), (2024, 2, 1, 1), [1, 2]), ("1M", (2023, 11, 1), (2024, 3, 1), [1, 2, 11, 12]), ("1w", (2024, 1, 1), (2024, 2, 5), [1]), ("1w", (2024, 1, 1), (2024, 3, 4), [1, 2]),
])
def test_required_months(spark, timeframe, start, end, months):
    ms = [int(datetime(*t, tzinfo=UTC).timestamp() * 1000) for t in (start, end)]
    covered = spark.createDataFrame([("k", *ms)], "symbol string, start long, end long")
    assert sorted(r["month"] for r in coverage.required_months(covered, timeframe, ["symbol"]).collect()) == months


def test_reads_hide_rows_outside_coverage(spark):
    df = bars(spark, [0, 60, 120, 180], "1h")
    base = int(T0.timestamp() * 1000)
    seg = spark.createDataFrame([("A/B", base, base + H, "available"), ("A/B", base + 2 * H, base + 3 * H, "available")], "symbol string, start long, end long, status string")
    ask = spark.createDataFrame([("A/B", base, base + 4 * H)], "symbol string, start long, end long")
    rows, gaps = reading.scan_partial(df, seg, ask, ["symbol"])
    assert sorted(r["seq"] for r in rows.collect()) == [0, 2]
    assert gaps.count() == 2
    assert "BroadcastNestedLoopJoin" not in rows._jdf.queryExecution().toString()
    with pytest.raises(CoverageError):
        reading.scan(df, seg, ask, ["symbol"])


def test_upsert_keeps_the_batch_and_nulls_equal(spark):
    old, new = bars(spark, [0, 1]), bars(spark, [1, 1, 2], close=[100.1, 100.2, 100.3])
    got = reading.upsert(old, new, ["exchange", "symbol", "market", "settle", "timeframe", "timestamp"])
    assert sorted(r["close"] for r in got.collect()) == [100.2, 100.3, 100.5]


def test_finality_edges(spark):
    start = int(datetime(2026, 8, 7, tzinfo=UTC).timestamp() * 1000)
    rows = spark.createDataFrame([(start, start + d) for d in (59_999, 60_000, 64_999, 65_000)], "s long, r long")
    got = rows.orderBy("r").select(live.finality(F.col("s"), F.col("r"), "1m")).collect()
    assert [r[0] for r in got] == ["forming", "provisional", "provisional", "final"]


def test_stream_fails_when_time_goes_back(spark, tmp_path):
    schema = "symbol string, timestamp timestamp, seq long"
    for k, minutes in enumerate(([0, 1, 1], [0])):
        spark.createDataFrame([("A/B", T0 + timedelta(minutes=m), 10 * k + i) for i, m in enumerate(minutes)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = live.ordered(stream, ["symbol"]).writeStream.format("memory").queryName("ordered").outputMode("append").start()
    try:
        with pytest.raises(Exception, match="came after"):
            query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("ordered").count() == 3


def test_entry_and_registered_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert TimeBar.parse("1h").intervals(0, H + 1) == [(0, H), (H, 2 * H)]
    assert SF
