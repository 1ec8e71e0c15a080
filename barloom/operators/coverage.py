"""Interval algebra of coverage, for all datasets of a frame at once.

Intervals are half-open, (keys, start, end, status), in milliseconds. Available goes before unavailable, and that before missing.
Everything is a sweep over sorted endpoints: no interval meets another in a range join.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.timebar import TimeBar, month_of, month_slices, year_of

STATUSES = ("available", "unavailable", "missing")


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on the keys in which null equals null: a spot dataset has no settle."""
    right = b.withColumnsRenamed({k: f"right_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    return a.join(right, on, how).drop(*[f"right_{k}" for k in keys])


def coalesce(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Touching neighbours of one status become one; the input doesn't overlap."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = ~((F.lag("end").over(w) == F.col("start")) & (F.lag("status").over(w) == F.col("status")))
    islands = segments.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island", "status").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end", "status")


def normalize(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping segments as disjoint ones, the best status winning everywhere, coalesced. Empty ones drop out."""
    real = segments.where(F.col("start") < F.col("end"))
    ends = real.select(*keys, "status", F.explode(F.array(F.struct(F.col("start").alias("point"), F.lit(1).alias("d")), F.struct(F.col("end").alias("point"), F.lit(-1).alias("d")))).alias("x"))
    deltas = ends.groupBy(*keys, F.col("x.point").alias("start")).agg(*[F.sum(F.when(F.col("status") == s, F.col("x.d")).otherwise(0)).alias(s) for s in STATUSES])
    w = Window.partitionBy(*keys).orderBy("start")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    open_ = deltas.select(*keys, "start", F.lead("start").over(w).alias("end"), *[F.sum(s).over(running).alias(s) for s in STATUSES])
    status = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in STATUSES])
    return coalesce(open_.select(*keys, "start", "end", status.alias("status")).where("status IS NOT NULL AND end IS NOT NULL"), keys)


def apply_update(stored: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """One pass, whatever the number of updates."""
    return normalize(stored.unionByName(update), keys)


def covered_and_gaps(segments: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The requests (keys, start, end) cut into available, unavailable and missing intervals. Requests of a dataset don't overlap."""
    asked = requests.select(*keys, "start", "end")
    clipped = (
        join_keys(segments, asked.withColumnsRenamed({"start": "from", "end": "to"}), keys)
        .select(*keys, F.greatest("start", "from").alias("start"), F.least("end", "to").alias("end"), "status")
        .where("start < end")
    )
    return normalize(clipped.unionByName(asked.withColumn("status", F.lit("missing"))), keys)


def bar_segments(bars: DataFrame, ranges: DataFrame, timeframe: str, keys: list[str]) -> DataFrame:
    """Each bar of the ranges (keys, start, end), available if it is there, else unavailable; coalesced."""
    bar = TimeBar.parse(timeframe)
    wanted = ranges.select(*keys, F.explode(bar.starts_col(F.col("start"), F.col("end"))).alias("start"))
    there = bars.select(*keys, F.unix_millis("timestamp").alias("start")).distinct().withColumn("there", F.lit(True))
    found = join_keys(wanted, there, [*keys, "start"], "left")
    status = F.when(F.col("there"), "available").otherwise("unavailable")
    return coalesce(found.select(*keys, "start", bar.next_col(F.col("start")).alias("end"), status.alias("status")), keys)


def available_islands(bars: DataFrame, timeframe: str, keys: list[str]) -> DataFrame:
    """Runs of consecutive bars as available segments, calendar included."""
    bar = TimeBar.parse(timeframe)
    start = F.unix_millis("timestamp")
    return coalesce(bars.select(*keys, start.alias("start"), bar.next_col(start).alias("end"), F.lit("available").alias("status")), keys)


def required_months(covered: DataFrame, timeframe: str, keys: list[str]) -> DataFrame:
    """(keys, year, month) of the months in which a covered bar starts."""
    bar = TimeBar.parse(timeframe)
    slices = covered.select(*keys, F.explode(month_slices(F.col("start"), F.col("end"))).alias("s"))
    first = bar.at_or_after_col(F.col("s.start"))
    return slices.where(first < F.col("s.end")).select(*keys, year_of(F.col("s.start")).alias("year"), month_of(F.col("s.start")).alias("month")).distinct()


def missing_only(gaps: DataFrame) -> DataFrame:
    """Unavailable ranges are not fetched again."""
    return gaps.where("status = 'missing'")


def fetch_windows(gaps: DataFrame, timeframe: str, keys: list[str], budget: int = 1000) -> DataFrame:
    """(keys, start, end, members): gaps joined greedily into windows of at most `budget` bars from a window's start.

    Bridged bars count; a single gap over the budget stays whole. One task folds a dataset's sorted gaps, in one pass.
    """
    if budget <= 0:
        raise ValueError("the budget is positive")
    bar = TimeBar.parse(timeframe)

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("end", "ascending")])
        found: list[list[int]] = []
        reach = 0
        for at, (start, end) in enumerate(zip(table["start"].to_pylist(), table["end"].to_pylist(), strict=True)):
            if found and end <= reach:
                found[-1][2:] = [end, found[-1][3] + 1]
            else:
                found.append([at, start, end, 1])
                reach = bar.later(start, budget) if bar.floor(start) == start else start + bar.later(0, budget)
        rows = table.select(keys).take([f[0] for f in found])
        for k, name in enumerate(("start", "end", "members"), 1):
            rows = rows.append_column(name, pa.array([f[k] for f in found], pa.int32() if name == "members" else pa.int64()))
        return rows

    kinds = dict(gaps.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "start long", "end long", "members int"])
    return gaps.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).groupBy(*keys).applyInArrow(fold, schema)
