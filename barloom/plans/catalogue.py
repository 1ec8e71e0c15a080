"""Registered queries over the derived bars, with DuckDB SQL for each.

Moments leave the queries as whole milliseconds, so no session's time zone shows in a result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import MarketDataConfig
from barloom.functions.timebar import TimeBar, month_slices
from barloom.market_data import MarketData
from barloom.model import BarRequest, Dataset
from barloom.operators import coverage, quality, reading
from barloom.plans import fixtures
from barloom.plans.fixtures import bars_sql
from barloom.session import shared_folder
from barloom.schema import BARS as BAR_SCHEMA
from barloom.sources import markets, provider, recovery, store
from barloom.sources.catalog import Catalog, events_of_runs, files_of_datasets
from barloom.streaming import live, venue
from barloom.streaming.adapter import LiveAdapter

HOUR, DAY, WEEK = 3_600_000, 86_400_000, 604_800_000
MS = F.unix_millis
KEYS = ["symbol"]


def ms(*when: int) -> int:
    return int(datetime(*when, tzinfo=UTC).timestamp() * 1000)


FROM, TO = ms(2024, 1, 5), ms(2024, 1, 12)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def told(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", MS("timestamp").alias("ts"), "open", "high", "low", "close", "volume")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.bars(spark, sf_dir, "1h")


def requests(bars: DataFrame, start: int = FROM, end: int = TO) -> DataFrame:
    return bars.select(*KEYS).distinct().select(*KEYS, F.lit(start).alias("start"), F.lit(end).alias("end"))


def islands(bars: DataFrame) -> DataFrame:
    return coverage.available_islands(bars, "1h", KEYS)


BARS = bars_sql()
ISLANDS = f"""{BARS},
marks AS (SELECT symbol, ts, sum(CASE WHEN ts = prev + {HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS island
  FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars)),
islands AS (SELECT symbol, min(ts) AS s, max(ts) + {HOUR} AS e FROM marks GROUP BY symbol, island)"""
#: Covered parts of the request, and its holes.
CUT = f"""{ISLANDS},
covered AS (SELECT symbol, greatest(s, {FROM}) AS s, least(e, {TO}) AS e FROM islands WHERE greatest(s, {FROM}) < least(e, {TO})),
syms AS (SELECT DISTINCT symbol FROM bars),
edges AS (SELECT symbol, s, e FROM covered UNION ALL SELECT symbol, {TO}, {TO} FROM syms),
holes AS (SELECT symbol, coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY s, e), {FROM}) AS s, s AS e FROM edges),
cut AS (SELECT symbol, s, e, 'available' AS status FROM covered UNION ALL SELECT symbol, s, e, 'missing' FROM holes WHERE s < e)"""
TOLD = 'symbol, ts, open, high, low, "close", volume'


@query(f"WITH {BARS} SELECT {TOLD} FROM bars")
def bars_hourly(spark, sf_dir):
    """The derived hourly bars."""
    return told(hours(spark, sf_dir))


def _floor_sql(expression: str) -> str:
    return f"SELECT event_id, {expression} AS start FROM (SELECT event_id, epoch_ms(ts) AS ms, ts FROM events)"


def _floor(timeframe: str, what: str):
    def f(spark, sf_dir):
        bar = TimeBar.parse(timeframe)
        ms = fixtures.begun_ms() if bar.is_calendar else fixtures.event_ms()
        return fixtures.events(spark, sf_dir, ms).select("event_id", getattr(bar, what)(F.col("ms")).alias("start"))

    return f


for name, timeframe, what, sql in (
    ("tb_floor_5m", "5m", "floor_col", "ms - ms % 300000"),
    ("tb_floor_week", "1w", "floor_col", "epoch_ms(date_trunc('week', ts)::TIMESTAMP)"),
    ("tb_floor_month", "1M", "floor_col", "epoch_ms(date_trunc('month', ts)::TIMESTAMP)"),
    ("tb_next_boundary_4h", "4h", "next_col", f"ms - ms % {4 * HOUR} + {4 * HOUR}"),
    ("tb_next_boundary_week", "1w", "next_col", "epoch_ms((date_trunc('week', ts) + INTERVAL 7 DAY)::TIMESTAMP)"),
    ("tb_next_boundary_month", "1M", "next_col", "epoch_ms((date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP)"),
    ("tb_previous_boundary", "1h", "previous_col", f"ms - 1 - (ms - 1) % {HOUR}"),
    ("tb_at_or_after", "1h", "at_or_after_col", f"CASE WHEN ms % {HOUR} = 0 THEN ms ELSE ms - ms % {HOUR} + {HOUR} END"),
):
    QUERIES[name], SQL[name] = _floor(timeframe, what), _floor_sql(sql)


@query(f"""WITH {BARS}, r AS (SELECT symbol, min(ts) AS s, max(ts) AS e FROM bars GROUP BY symbol HAVING min(ts) < max(ts))
SELECT symbol, unnest(range(s, e, {HOUR})) AS start, unnest(range(s, e, {HOUR})) + {HOUR} AS "end" FROM r""")
def tb_intervals(spark, sf_dir):
    """All bar intervals between a symbol's first and last bar."""
    bar = TimeBar.parse("1h")
    r = hours(spark, sf_dir).groupBy("symbol").agg(F.min(MS("timestamp")).alias("s"), F.max(MS("timestamp")).alias("e")).where("s < e")
    starts = r.select("symbol", F.explode(bar.starts_col(F.col("s"), F.col("e"))).alias("start"))
    return starts.select("symbol", "start", bar.next_col(F.col("start")).alias("end"))


@query("""WITH r AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS s, o_orderdate::TIMESTAMP + INTERVAL 75 DAY AS e FROM orders),
m AS (SELECT *, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, e - INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)) AS m FROM r)
SELECT o_orderkey, epoch_ms(greatest(s, m)) AS start, epoch_ms(least(e, m + INTERVAL 1 MONTH)) AS "end" FROM m""")
def tb_month_slices(spark, sf_dir):
    """75 days from each order's date, cut at the months' ends."""
    start = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * DAY
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(month_slices(start, start + 75 * DAY)).alias("s"))
    return rows.select("o_orderkey", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


EVIDENCE = ms(2024, 1, 20, 10, 0, 3)


@query(f"WITH {BARS} SELECT {TOLD} FROM bars WHERE ts < least({ms(2024, 2, 1)}, {EVIDENCE - 5000} - {EVIDENCE - 5000} % {HOUR})")
def bars_finalized(spark, sf_dir):
    """Bars final by evidence three seconds after the hour."""
    end = reading.finalizable_end(F.lit(ms(2024, 2, 1)), F.lit(EVIDENCE), "1h")
    return told(reading.finalized(hours(spark, sf_dir), end))


@query(f"WITH {BARS} SELECT {TOLD} FROM bars WHERE (ts >= {FROM} AND ts < {FROM + DAY}) OR (ts >= {TO} AND ts < {TO + DAY})")
def bars_in_ranges(spark, sf_dir):
    return told(reading.in_ranges(hours(spark, sf_dir), [(FROM, FROM + DAY), (TO, TO + DAY)]))


@query(f"""WITH {BARS} SELECT 'sim' AS exchange, symbol, 'spot' AS market, NULL::VARCHAR AS settle, '1h' AS timeframe, ts, open, high, low, "close", volume FROM bars""")
def bars_canonical(spark, sf_dir):
    """All canonical columns, in order."""
    c = ["exchange", "symbol", "market", "settle", "timeframe"]
    return hours(spark, sf_dir).select(*c, MS("timestamp").alias("ts"), "open", "high", "low", "close", "volume")


# A batch with planted faults: rows are events, so they come in the order of event_id and need not be sorted.
DIRTY = """dirty AS (SELECT event_type || '/USD' AS symbol, event_id AS seq, epoch_ms(ts) - epoch_ms(ts) % 60000 + CASE WHEN event_id % 53 = 0 THEN 30000 ELSE 0 END AS ts,
  CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN -value WHEN event_id % 89 = 0 THEN 'nan'::DOUBLE ELSE value END AS open,
  value + 1 AS high, CASE WHEN event_id % 83 = 0 THEN value + 2 ELSE value - 0.5 END AS low, CASE WHEN event_id % 79 = 0 THEN 'inf'::DOUBLE ELSE value END AS "close",
  CASE WHEN event_id % 73 = 0 THEN -1.0 WHEN event_id % 71 = 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS volume FROM events)"""


def dirty(spark, sf_dir) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    m = F.col("ms") - F.col("ms") % 60000 + F.when(i % 53 == 0, 30000).otherwise(0)
    return fixtures.events(spark, sf_dir).select(
        F.lit("sim").alias("exchange"), F.concat("event_type", F.lit("/USD")).alias("symbol"), F.lit("spot").alias("market"), F.lit(None).cast("string").alias("settle"), F.lit("1m").alias("timeframe"),
        F.timestamp_millis(m).alias("timestamp"),
        F.when(i % 101 == 0, None).when(i % 97 == 0, -v).when(i % 89 == 0, nan).otherwise(v).alias("open"),
        (v + 1).alias("high"), F.when(i % 83 == 0, v + 2).otherwise(v - 0.5).alias("low"), F.when(i % 79 == 0, inf).otherwise(v).alias("close"),
        F.when(i % 73 == 0, -1.0).when(i % 71 == 0, inf).otherwise(1.0).alias("volume"), i.alias("seq"),
    )


def one_finding(code: str):
    def f(spark, sf_dir):
        found = quality.findings(dirty(spark, sf_dir), "1m", KEYS, FROM, TO)
        return found.where(F.col("code").startswith(code)).select("symbol", "code", "row_count")

    return f


def finding_sql(*parts: tuple[str, str]) -> str:
    counts = " UNION ALL ".join(f"SELECT symbol, '{code}' AS code, ({count})::BIGINT AS row_count FROM steps GROUP BY symbol" for code, count in parts)
    steps = 'steps AS (SELECT *, lag(ts) OVER w AS p, lag("close") OVER w AS pc FROM dirty WINDOW w AS (PARTITION BY symbol ORDER BY seq))'
    return f"WITH {DIRTY}, {steps}, counts AS ({counts}) SELECT * FROM counts WHERE row_count > 0"


_LATE = "ts > p + 60000 - (p % 60000)"
_RULES = {
    "q_null_counts": [(f"null.disallowed:{c}", f'count_if("{c}" IS NULL)') for c in ("open", "high", "low", "close", "volume")],
    "q_ohlc_invariant": [("ohlc.invariant_violation", 'count_if(NOT (low <= open AND low <= "close" AND open <= high AND "close" <= high AND low <= high))')],
    "q_price_counts": [x for c in ("open", "high", "low", "close") for x in ((f"price.non_finite:{c}", f'count_if(NOT isfinite("{c}"))'), (f"price.non_positive:{c}", f'count_if("{c}" <= 0)'))],
    "q_volume_counts": [("volume.non_finite", "count_if(NOT isfinite(volume))"), ("volume.negative", "count_if(volume < 0)")],
    "q_duplicates": [("identity.duplicate", "count(*) - count(DISTINCT ts)")],
    "q_ordering": [("timestamp.unordered", "count_if(p > ts)"), ("timestamp.non_monotonic", "CASE WHEN count_if(p > ts) = 0 THEN count(*) - count(DISTINCT ts) ELSE 0 END")],
    "q_misaligned": [("timestamp.off_timeframe_boundary", "count_if(ts % 60000 <> 0)")],
    "q_out_of_range": [("range.out_of_request", f"count_if(ts < {FROM} OR ts >= {TO})")],
    "q_gap_warnings": [("coverage.timeframe_gap", f"coalesce(sum(CASE WHEN {_LATE} THEN ceil((ts - (p - p % 60000 + 60000)) / 60000.0)::BIGINT ELSE 0 END), 0)")],
    "q_outlier_returns": [("statistics.outlier_return", 'count_if(abs("close" / nullif(pc, 0) - 1) > 0.25 OR (pc = 0 AND "close" IS NOT NULL))')],
}
_CODES = {
    "q_null_counts": "null.", "q_ohlc_invariant": "ohlc.", "q_price_counts": "price.", "q_volume_counts": "volume.", "q_duplicates": "identity.", "q_ordering": "timestamp.",
    "q_misaligned": "timestamp.off", "q_out_of_range": "range.", "q_gap_warnings": "coverage.", "q_outlier_returns": "statistics.",
}
for name, rules in _RULES.items():
    QUERIES[name], SQL[name] = one_finding(_CODES[name]), finding_sql(*rules)
SQL["q_ordering"] = finding_sql(*_RULES["q_ordering"], *_RULES["q_misaligned"])
QUERIES["q_findings"], SQL["q_findings"] = one_finding(""), finding_sql(*[r for rules in _RULES.values() for r in rules])


def _gaps(timeframe: str):
    return lambda spark, sf_dir: quality.gaps(fixtures.bars(spark, sf_dir, timeframe), timeframe, KEYS)


def _gaps_sql(step: int) -> str:
    return f"""WITH {bars_sql(step)}, s AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars)
SELECT symbol, coalesce(count_if(ts > p + {step}), 0) AS gaps, coalesce(sum((ts - p) // {step} - 1), 0)::BIGINT AS missing FROM s GROUP BY symbol"""


for name, timeframe, step in (("q_gaps_1h", "1h", HOUR), ("q_gaps_5m", "5m", 300_000), ("q_gaps_1m", "1m", 60_000)):
    QUERIES[name], SQL[name] = _gaps(timeframe), _gaps_sql(step)


def _order_bars(spark, sf_dir, timeframe: str) -> DataFrame:
    """One moment per customer and bar with an order: sparse calendar bars over years."""
    start = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * DAY
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("symbol"), TimeBar.parse(timeframe).floor_col(start).alias("seq")).distinct()
    return rows.withColumn("timestamp", F.timestamp_millis("seq"))


@query("""WITH b AS (SELECT DISTINCT o_custkey::VARCHAR AS symbol, date_trunc('week', o_orderdate)::DATE AS d FROM orders),
s AS (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY d) AS p FROM b)
SELECT symbol, coalesce(count_if(d - p > 7), 0) AS gaps, coalesce(sum((d - p) // 7 - 1), 0)::BIGINT AS missing FROM s GROUP BY symbol""")
def q_gaps_week(spark, sf_dir):
    return quality.gaps(_order_bars(spark, sf_dir, "1w"), "1w", KEYS)


@query("""WITH b AS (SELECT DISTINCT o_custkey::VARCHAR AS symbol, 12 * year(o_orderdate) + month(o_orderdate) AS d FROM orders),
s AS (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY d) AS p FROM b)
SELECT symbol, coalesce(count_if(d - p > 1), 0) AS gaps, coalesce(sum(d - p - 1), 0)::BIGINT AS missing FROM s GROUP BY symbol""")
def q_gaps_month(spark, sf_dir):
    return quality.gaps(_order_bars(spark, sf_dir, "1M"), "1M", KEYS)


@query(f"WITH {ISLANDS} SELECT symbol, s AS start, e AS \"end\", 'available' AS status FROM islands")
def cov_islands(spark, sf_dir):
    return islands(hours(spark, sf_dir))


def _updates(spark, sf_dir) -> DataFrame:
    """Overlapping segments: from each event, as many hours as its user's number modulo 7 says; one in three unavailable."""
    start = F.col("ms") - F.col("ms") % HOUR
    return fixtures.events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), start.alias("start"), (start + HOUR * (F.col("user_id") % 7)).alias("end"), F.when(F.col("event_id") % 3 == 0, "unavailable").otherwise("available").alias("status")
    )


_NORMAL = f"""seg AS (SELECT event_type AS symbol, epoch_ms(ts) - epoch_ms(ts) % {HOUR} AS s, user_id % 7 AS n, event_id % 3 = 0 AS un FROM events),
hrs AS (SELECT symbol, unnest(range(s, s + n * {HOUR}, {HOUR})) AS h, un FROM seg),
best AS (SELECT symbol, h, CASE WHEN bool_and(un) THEN 'unavailable' ELSE 'available' END AS status FROM hrs GROUP BY symbol, h),
runs AS (SELECT *, h - {HOUR} * row_number() OVER (PARTITION BY symbol, status ORDER BY h) AS run FROM best),
normal AS (SELECT symbol, min(h) AS s, max(h) + {HOUR} AS e, status FROM runs GROUP BY symbol, status, run)"""


@query(f'WITH {_NORMAL} SELECT symbol, s AS start, e AS "end", status FROM normal')
def cov_normalize(spark, sf_dir):
    return coverage.normalize(_updates(spark, sf_dir), KEYS)


@query(f'WITH {_NORMAL} SELECT symbol, s AS start, e AS "end", status FROM normal')
def cov_apply_batch(spark, sf_dir):
    """Half the updates onto what the other half left: the same as all at once."""
    updates = _updates(spark, sf_dir)
    stored = coverage.normalize(updates.where(F.col("start") % (2 * HOUR) == 0), KEYS)
    return coverage.apply_update(stored, updates.where(F.col("start") % (2 * HOUR) != 0), KEYS)


@query(f'WITH {CUT} SELECT symbol, s AS start, e AS "end", status FROM cut')
def cov_covered_gaps(spark, sf_dir):
    bars = hours(spark, sf_dir)
    return coverage.covered_and_gaps(islands(bars), requests(bars), KEYS)


@query(f"""WITH {BARS}, syms AS (SELECT DISTINCT symbol FROM bars), h AS (SELECT symbol, unnest(range({FROM}, {TO}, {HOUR})) AS ts FROM syms),
j AS (SELECT h.symbol, h.ts, b.ts IS NOT NULL AS there FROM h LEFT JOIN bars b ON h.symbol = b.symbol AND h.ts = b.ts),
r AS (SELECT *, ts - {HOUR} * row_number() OVER (PARTITION BY symbol, there ORDER BY ts) AS run FROM j)
SELECT symbol, min(ts) AS start, max(ts) + {HOUR} AS "end", CASE WHEN there THEN 'available' ELSE 'unavailable' END AS status FROM r GROUP BY symbol, there, run""")
def cov_bar_segments(spark, sf_dir):
    bars = hours(spark, sf_dir)
    return coverage.bar_segments(bars, requests(bars), "1h", KEYS)


@query("""WITH r AS (SELECT DISTINCT o_custkey::VARCHAR AS symbol, date_trunc('week', o_orderdate)::TIMESTAMP AS w FROM orders)
SELECT DISTINCT symbol, year(w)::INTEGER AS year, month(w)::INTEGER AS month FROM r""")
def cov_required_months(spark, sf_dir):
    """Months in which a covered weekly bar starts: not those that it only runs into."""
    covered = coverage.available_islands(_order_bars(spark, sf_dir, "1w"), "1w", KEYS)
    return coverage.required_months(covered, "1w", KEYS)


@query(f"WITH {CUT} SELECT symbol, s AS start, e AS \"end\" FROM cut WHERE status = 'missing'")
def plan_missing(spark, sf_dir):
    return coverage.missing_only(cov_covered_gaps(spark, sf_dir)).select("symbol", "start", "end")


@query(f"""WITH RECURSIVE {CUT}, g AS (SELECT symbol, s, e, row_number() OVER (PARTITION BY symbol ORDER BY s) AS i FROM cut WHERE status = 'missing'),
fold(symbol, i, ws, we, w) AS (
  SELECT symbol, i, s, e, 1 FROM g WHERE i = 1
  UNION ALL
  SELECT g.symbol, g.i, CASE WHEN g.e - f.ws <= {48 * HOUR} THEN f.ws ELSE g.s END, g.e, CASE WHEN g.e - f.ws <= {48 * HOUR} THEN f.w ELSE f.w + 1 END
  FROM fold f JOIN g ON g.symbol = f.symbol AND g.i = f.i + 1)
SELECT symbol, min(ws) AS start, max(we) AS "end", count(*)::INTEGER AS members FROM fold GROUP BY symbol, w""")
def plan_fetch_windows(spark, sf_dir):
    """Missing gaps joined into windows of at most 48 bars."""
    gaps = coverage.missing_only(cov_covered_gaps(spark, sf_dir))
    return coverage.fetch_windows(gaps, "1h", KEYS, budget=48)


@query(f"""WITH {CUT} SELECT b.symbol, b.ts, b.open, b.high, b.low, b."close", b.volume FROM bars b ASOF JOIN covered c ON b.symbol = c.symbol AND b.ts >= c.s WHERE b.ts < c.e""")
def scan_restricted(spark, sf_dir):
    """Bars of the request that coverage proves."""
    bars = hours(spark, sf_dir)
    return told(reading.scan_partial(bars, islands(bars), requests(bars), KEYS)[0])


@query(f"WITH {CUT} SELECT symbol, 'coverage.' || status AS code, s AS start, e AS \"end\" FROM cut WHERE status <> 'available'")
def scan_partial_gaps(spark, sf_dir):
    bars = hours(spark, sf_dir)
    gaps = reading.scan_partial(bars, islands(bars), requests(bars), KEYS)[1]
    return gaps.select("symbol", F.concat(F.lit("coverage."), "status").alias("code"), "start", "end")


@query(f"""WITH {BARS} SELECT symbol, ts, open, high, low, CASE WHEN ts >= {TO} THEN "close" + 1 ELSE "close" END AS "close", volume FROM bars
WHERE ts >= {TO} OR ts % {2 * HOUR} = 0""")
def merge_upsert(spark, sf_dir):
    """A batch of revised bars onto a store of every second hour: the batch wins."""
    bars = hours(spark, sf_dir)
    revised = bars.where(MS("timestamp") >= TO).withColumn("close", F.col("close") + 1)
    return told(reading.upsert(bars.where(MS("timestamp") % (2 * HOUR) == 0), revised, ["exchange", "symbol", "market", "settle", "timeframe", "timestamp"]))


@query("""SELECT o_custkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS row_count,
epoch_ms(min(o_orderdate)::TIMESTAMP) AS first, epoch_ms(max(o_orderdate)::TIMESTAMP) AS last FROM orders GROUP BY ALL""")
def split_months(spark, sf_dir):
    """Row count and bounds of each dataset's month."""
    from barloom.functions.timebar import month_of, year_of

    start = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * DAY
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", start.alias("ms"))
    return rows.groupBy("o_custkey", year_of(F.col("ms")).alias("year"), month_of(F.col("ms")).alias("month")).agg(F.count("*").alias("row_count"), F.min("ms").alias("first"), F.max("ms").alias("last"))


# Files of an index and of a storage that differ by rule.
_FILES = """f AS (SELECT 'p' || o_custkey AS path, o_custkey AS k, count(*) AS n, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey),
i AS (SELECT path, 's' || k AS symbol, 'h' || k AS sha256, n AS row_count, a AS "first", b AS "last" FROM f WHERE k % 11 <> 0),
g AS (SELECT path, CASE WHEN k % 13 = 0 THEN 'x' ELSE 's' || k END AS symbol, CASE WHEN k % 5 = 0 THEN 'x' ELSE 'h' || k END AS sha256, n + (k % 3 = 0)::INT AS row_count, a AS "first", b + (k % 4 = 0)::INT AS "last" FROM f WHERE k % 7 <> 0)"""


def _files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    f = f.withColumn("path", F.concat(F.lit("p"), "k"))
    k, symbol, sha = F.col("k"), F.concat(F.lit("s"), "k"), F.concat(F.lit("h"), "k")
    indexed = f.where("k % 11 <> 0").select("path", symbol.alias("symbol"), sha.alias("sha256"), F.col("n").alias("row_count"), F.col("a").alias("first"), F.col("b").alias("last"))
    found = f.where("k % 7 <> 0").select(
        "path", F.when(k % 13 == 0, "x").otherwise(symbol).alias("symbol"), F.when(k % 5 == 0, "x").otherwise(sha).alias("sha256"),
        (F.col("n") + (k % 3 == 0).cast("int")).alias("row_count"), F.col("a").alias("first"), (F.col("b") + (k % 4 == 0).cast("int")).alias("last"),
    )
    return indexed, found


@query(f"""WITH {_FILES}, j AS (SELECT coalesce(i.path, g.path) AS path, i.path IS NULL AS o, g.path IS NULL AS m, i.symbol <> g.symbol AS s, i.sha256 <> g.sha256 AS h,
  i.row_count <> g.row_count AS n, i."first" <> g."first" OR i."last" <> g."last" AS b FROM i FULL JOIN g ON i.path = g.path)
SELECT path, 'missing file' AS issue FROM j WHERE m UNION ALL SELECT path, 'orphan' FROM j WHERE o UNION ALL SELECT path, 'identity' FROM j WHERE s
UNION ALL SELECT path, 'SHA' FROM j WHERE h UNION ALL SELECT path, 'row count' FROM j WHERE n UNION ALL SELECT path, 'bounds' FROM j WHERE b""")
def validate_index_vs_files(spark, sf_dir):
    return reading.compare_files(*_files(spark, sf_dir))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS providers FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def lineage_conflicts(spark, sf_dir):
    """Customers as datasets, order priorities as providers."""
    return reading.lineage_conflicts(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderpriority", "provider"), ["o_custkey"])


@query("""SELECT p_partkey, p_brand, p_size FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) WHERE n = 1""")
def definitions_unique(spark, sf_dir):
    """Parts as definitions: those whose brand and size no other has."""
    return reading.unique_definitions(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"])


@query("SELECT p_brand, p_size, min(p_partkey)::VARCHAR AS settle FROM part GROUP BY ALL HAVING count(*) = 1 AND count(DISTINCT p_partkey) = 1")
def settle_inference(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_size", F.col("p_partkey").cast("string").alias("settle"))
    return reading.inferred_settle(rows, ["p_brand", "p_size"])


def _windows(bars: DataFrame) -> DataFrame:
    """A day each, but the third is only half a day long."""
    starts = bars.select("symbol").distinct().withColumn("start", F.explode(F.sequence(F.lit(FROM), F.lit(TO - 1), F.lit(DAY))))
    return starts.withColumn("end", F.col("start") + F.when(F.col("start") == FROM + 2 * DAY, DAY // 2).otherwise(DAY))


@query(f"""WITH {BARS} SELECT DISTINCT symbol, {FROM + 3 * DAY}::BIGINT AS start, 'not contiguous' AS fault FROM bars""")
def window_faults(spark, sf_dir):
    bars = hours(spark, sf_dir)
    return reading.window_faults(_windows(bars), requests(bars), KEYS)


@query(f"WITH {BARS} SELECT {TOLD} FROM bars WHERE ts < {FROM} OR ts >= {TO} OR (ts >= {FROM + 2 * DAY + DAY // 2} AND ts < {FROM + 3 * DAY})")
def window_evidence(spark, sf_dir):
    """Bars that no observed window holds."""
    bars = hours(spark, sf_dir)
    return told(reading.outside_windows(bars, _windows(bars), KEYS))


def _live(spark, sf_dir) -> DataFrame:
    """Events as updates of hourly bars, received up to two hours later."""
    start = F.col("ms") - F.col("ms") % HOUR
    return fixtures.events(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("symbol"), F.timestamp_millis(start).alias("timestamp"), F.timestamp_millis(start + (F.col("event_id") * 7919) % (2 * HOUR)).alias("received"),
        F.col("event_id").alias("seq"), F.abs("value").alias("close"),
    )


@query(f"""SELECT event_id, CASE WHEN d < {HOUR} THEN 'forming' WHEN d < {HOUR + 5000} THEN 'provisional' ELSE 'final' END AS finality
FROM (SELECT event_id, (event_id * 7919) % {2 * HOUR} AS d FROM events)""")
def live_finality(spark, sf_dir):
    return _live(spark, sf_dir).select("event_id", live.finality(MS("timestamp"), MS("received"), "1h").alias("finality"))


@query(f"""WITH u AS (SELECT event_id, event_type, epoch_ms(ts) - epoch_ms(ts) % {HOUR} AS h FROM events)
SELECT event_id, h AS ts, before FROM (SELECT *, lag(h) OVER (PARTITION BY event_type ORDER BY event_id - 2 * (event_id % 50)) AS before FROM u) WHERE before > h""")
def live_backwards(spark, sf_dir):
    """Updates that arrive fifty by fifty in reverse: those whose bar lies before the one that came before."""
    arrived = _live(spark, sf_dir).withColumn("seq", F.col("event_id") - 2 * (F.col("event_id") % 50))
    return live.backward_steps(arrived, KEYS).select("event_id", MS("timestamp").alias("ts"), "before")


@query(f"""WITH {BARS}, l AS (SELECT event_type || '/USD' AS symbol, ms - ms % {HOUR} AS ts, max(event_id) AS id FROM ev WHERE ms >= {TO} GROUP BY ALL)
SELECT b.symbol, b.ts, CASE WHEN l.id IS NULL THEN b."close" ELSE l.id::DOUBLE END AS "close" FROM bars b LEFT JOIN l ON b.symbol = l.symbol AND b.ts = l.ts""")
def live_bootstrap_merge(spark, sf_dir):
    """The stored bars, and buffered events over them from a moment on: the last event of a bar wins."""
    snapshot = hours(spark, sf_dir).select("symbol", "timestamp", "close", "seq")
    buffered = fixtures.events(spark, sf_dir).where(F.col("ms") >= TO).select(
        F.concat("event_type", F.lit("/USD")).alias("symbol"), F.timestamp_millis(F.col("ms") - F.col("ms") % HOUR).alias("timestamp"), F.col("event_id").cast("double").alias("close"), F.col("event_id").alias("seq")
    )
    return live.bootstrap(snapshot, buffered, KEYS).select("symbol", MS("timestamp").alias("ts"), "close")


@query(f"""WITH {BARS} SELECT symbol, count(*) AS row_count, min(ts) AS first, max(ts) AS last FROM bars GROUP BY symbol""")
def row_bounds(spark, sf_dir):
    return hours(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("row_count"), F.min(MS("timestamp")).alias("first"), F.max(MS("timestamp")).alias("last"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_files_datasets(spark, sf_dir):
    """Orders as files, customers as datasets: the inner join of a listing."""
    tables = {
        "files": spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("dataset_id")),
        "datasets": spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), "c_mktsegment"),
    }
    return files_of_datasets(tables).select("o_orderkey", "c_mktsegment")


@query("""SELECT event_id, o_orderdate::DATE::VARCHAR AS run_date FROM events LEFT JOIN orders ON o_orderkey = user_id * 37""")
def join_events_runs(spark, sf_dir):
    """Events with the run they name, those of no run too."""
    tables = {
        "quality_events": fixtures.events(spark, sf_dir).select("event_id", (F.col("user_id") * 37).alias("run_id")),
        "ingestion_runs": spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("run_date")),
    }
    return events_of_runs(tables).select("event_id", "run_date")


#: What the test venue says of [start, end): an hour's price from its number, nothing in hours divisible by seven.
_VENUE = f"""SELECT h * {HOUR} AS ts, 100.0::DOUBLE + h % 10 AS open, 101.0::DOUBLE + h % 10 AS high, 99.0::DOUBLE + h % 10 AS low,
 100.0::DOUBLE + h % 10 AS "close", 10.0::DOUBLE AS volume FROM (SELECT unnest(range({FROM // HOUR}, {TO // HOUR})) AS h) WHERE h % 7 <> 0"""
_DATASET = Dataset("okx", "BTC/USDT", "spot", None, "1h")


@query(f"""WITH ev AS (SELECT event_id, epoch_ms(ts) AS ms, 1 + abs(value) AS v FROM events WHERE event_type = 'click')
SELECT 'click/USD' AS symbol, ms - ms % {HOUR} AS ts, arg_min(v, (ms, event_id)) AS open, max(v) AS high, min(v) AS low, arg_max(v, (ms, event_id)) AS "close", count(*)::DOUBLE AS volume
FROM ev WHERE ms >= {FROM} AND ms < {TO} GROUP BY ALL""")
def src_provider_bars(spark, sf_dir):
    """A week of a provider's bars, a partition a page; holes stay holes. The client reads what the market's native id names."""
    d = Dataset("sim", "click/USD", "spot", None, "1h")
    request = BarRequest(d, datetime.fromtimestamp(FROM / 1000, UTC), datetime.fromtimestamp(TO / 1000, UTC))
    bars, _, _ = provider.observe(spark, request, "barloom.plans.fixtures:replayed", page=48, native_id=f"{sf_dir}/events.parquet")
    return told(bars)


def _store(spark) -> MarketData:
    """A fresh store in the shared checkpoint folder."""
    folder = _folder(spark)
    flat = provider.Provider("flat", "1", "barloom.sources.provider:flat_client", page=48)
    return MarketData(spark, MarketDataConfig(f"{folder}/state", f"{folder}/data"), provider=flat)


@query(f"""SELECT ts, open, high, low, "close", volume FROM ({_VENUE}) WHERE ts >= {FROM + DAY}""")
def sync_scan(spark, sf_dir):
    """A week synced in two overlapping steps into month files, then read back by coverage from its second day."""
    bars = _store(spark).bars(*(getattr(_DATASET, k) for k in ("exchange", "symbol", "market", "settle", "timeframe")))
    at = [datetime.fromtimestamp(t / 1000, UTC) for t in (FROM, FROM + 3 * DAY, FROM + DAY, TO)]
    bars.sync(at[0], at[1])
    bars.sync(at[2], at[3])
    return told(bars.scan_partial(at[2], at[3]).data).drop("symbol")


@query(f"""WITH v AS ({_VENUE}), h AS (SELECT x * {HOUR} AS ts FROM (SELECT unnest(range({FROM // HOUR}, {TO // HOUR})) AS x))
SELECT h.ts AS start, h.ts + {HOUR} AS "end", 'unavailable' AS status FROM h ANTI JOIN v USING (ts)""")
def sync_gaps(spark, sf_dir):
    """What a sync proves unavailable: the holes of the venue."""
    bars = _store(spark).bars(*(getattr(_DATASET, k) for k in ("exchange", "symbol", "market", "settle", "timeframe")))
    done = bars.sync(datetime.fromtimestamp(FROM / 1000, UTC), datetime.fromtimestamp(TO / 1000, UTC))
    return spark.createDataFrame(list(done.gaps), "start long, end long, status string")


@query("""WITH m AS (SELECT substr(n_name, 1, 8) || '/USD' AS symbol, n_regionkey AS r FROM nation), u AS (SELECT symbol, min(r) AS r FROM m GROUP BY symbol HAVING count(*) = 1)
SELECT symbol, CASE WHEN r > 0 THEN r::VARCHAR END AS tick_size, '1d,1h' AS timeframes FROM u""")
def definitions_translated(spark, sf_dir):
    """Nations as a venue's native markets: two of one identity both go, a tick of 0 is none, foreign timeframes drop out."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey").collect()
    native = [{"base": r["n_name"][:8], "quote": "USD", "spot": True, "precision": {"price": r["n_regionkey"]}} for r in rows]
    found = markets.translate(spark, native, "sim", "spot", ["1h", "60", "1d", "2w"])
    return found.select("symbol", F.col("tick_size").cast("int").cast("string").alias("tick_size"), F.array_join("timeframes", ",").alias("timeframes"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}".removeprefix("file:")


def _stored(spark, sf_dir: str) -> str:
    """All hourly bars in month files, in two batches: the second replaces the later half, each price raised by one."""
    root, bars = _folder(spark), hours(spark, sf_dir)
    later = bars.where(MS("timestamp") >= FROM)
    for batch in (bars, later.select(*[(F.col(c) + 1).alias(c) if c in ("open", "high", "low", "close") else c for c in bars.columns])):
        store.publish(store.prepare(batch, root, "sim"))
    return root


STORED = f"""{BARS}, stored AS (SELECT symbol, ts, open + x AS open, high + x AS high, low + x AS low, "close" + x AS "close", volume FROM (SELECT *, CASE WHEN ts >= {FROM} THEN 1 ELSE 0 END AS x FROM bars))"""
MONTHS = f"""{STORED}, months AS (SELECT symbol, year(make_timestamp(ts * 1000)) AS year, month(make_timestamp(ts * 1000)) AS month, count(*) AS row_count, min(ts) AS first, max(ts) AS last FROM stored GROUP BY ALL)"""


@query(f"WITH {STORED} SELECT * FROM stored")
def store_merge(spark, sf_dir):
    """Two batches merged month by month into files, read back: of equal times the later batch stays."""
    root = _stored(spark, sf_dir)
    return told(spark.read.schema(BAR_SCHEMA).parquet(*store.month_files(root)))


@query(f"WITH {MONTHS} SELECT symbol, row_count, first, last, 'sim' AS provider FROM months")
def store_deep_read(spark, sf_dir):
    """Every stored file read deeply: footer, identity, place and rows held against each other."""
    return recovery.deep_inventory(spark, _stored(spark, sf_dir)).where("fault IS NULL").select("symbol", "row_count", "first", "last", "provider")


@query(f"WITH {MONTHS} SELECT symbol, 'missing file' AS issue FROM (SELECT * FROM months ORDER BY symbol, first LIMIT 1) UNION ALL SELECT 'any', 'leftover of a writer'")
def validate_store(spark, sf_dir):
    """The catalog rebuilt from the files; then a file goes, and a dead writer leaves something."""
    root, state = _stored(spark, sf_dir), f"{_folder(spark)}/catalog.db"
    recovery.rebuild(spark, root, state)
    first = store.month_files(root)[0]
    _, notes, _ = store.read_month(first, root)
    os.unlink(first)
    open(os.path.join(os.path.dirname(first), ".data-dead.tmp"), "w").close()
    found = recovery.validate(spark, root, state)
    return found.select(F.when(F.col("path") == first, notes["symbol"]).otherwise("any").alias("symbol"), "issue")


@query(f"""WITH {ISLANDS} SELECT symbol, s AS start, e AS "end", 'available' AS status FROM islands""")
def catalog_rebuilt(spark, sf_dir):
    """The coverage that a catalog rebuilt from the files knows."""
    root, state = _stored(spark, sf_dir), f"{_folder(spark)}/catalog.db"
    recovery.rebuild(spark, root, state)
    opened = Catalog(state, read_only=True)
    tables = opened.snapshot(spark)
    opened.close()
    return tables["coverage"].join(tables["datasets"].withColumnRenamed("id", "dataset_id"), "dataset_id").select("symbol", "start", "end", "status")


@query(f"WITH {MONTHS} SELECT row_number() OVER (ORDER BY symbol) AS place, symbol, count(*) AS n_files, sum(row_count)::BIGINT AS row_count FROM months GROUP BY symbol")
def catalog_listing(spark, sf_dir):
    """Datasets and their files, listed in order by the catalog."""
    root, state = _stored(spark, sf_dir), f"{_folder(spark)}/catalog.db"
    recovery.rebuild(spark, root, state)
    opened = Catalog(state, read_only=True)
    rows = [(k, d[2], files) for k, d in enumerate(opened.datasets(), 1) for files in [list(opened.files(d[0]))]]
    opened.close()
    return spark.createDataFrame([(k, s, len(f), sum(r[4] for r in f)) for k, s, f in rows], "place long, symbol string, n_files long, row_count long")


@query("""SELECT s || '/USDT:' || m || '::1m' AS dataset, b.ms + k * 60000 AS ts, 101.0::DOUBLE + k + CASE WHEN m = 'perpetual' THEN 11 ELSE 7 END AS "close"
FROM (VALUES ('BTC'), ('ETH')) a(s), (VALUES ('spot'), ('perpetual')) c(m), range(0, 3) r(k), (SELECT epoch_ms(TIMESTAMP '2026-08-07 00:01:00') AS ms) b""")
def live_adapter_updates(spark, sf_dir):
    """What the adapter merges of two markets of two client families, three bars each."""
    adapter, found = LiveAdapter("binance", venue.Watching), []
    for symbol in ("BTC/USDT", "ETH/USDT"):
        for market in ("spot", "perpetual"):
            adapter.subscribe(f"{symbol}:{market}::1m", ("binance", symbol, market, None, "1m"))
    while len(found) < 12:
        found += adapter.pull()
    adapter.close()
    return spark.createDataFrame([(u["dataset"], u["row"][0], float(u["row"][4])) for u in found], "dataset string, ts long, close double")


@query("""SELECT e AS exchange, m AS market, CASE WHEN m = 'spot' THEN e WHEN e = 'binance' THEN 'binanceusdm' WHEN e IN ('kraken', 'kucoin') THEN e || 'futures' ELSE e END AS client
FROM (VALUES ('binance'), ('kraken'), ('kucoin'), ('okx'), ('bybit')) a(e), (VALUES ('spot'), ('perpetual')) b(m)""")
def client_families(spark, sf_dir):
    """Which client speaks to a venue's markets."""
    pairs = [(e, m) for e in ("binance", "kraken", "kucoin", "okx", "bybit") for m in ("spot", "perpetual")]
    return spark.createDataFrame([(e, m, markets.client_of(e, m)) for e, m in pairs], "exchange string, market string, client string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived bars, checked, restricted to what coverage proves of a week."""
    return scan_restricted(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
