"""Reading bars back: ranges, finality, and restriction to coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.timebar import TimeBar, month_index, month_slices
from barloom.model import CoverageError
from barloom.operators.coverage import covered_and_gaps, join_keys

GRACE_MS = 5000


def finalizable_end(request_end: Column, evidence_ms: Column, timeframe: str) -> Column:
    """The last moment up to which bars are final by evidence taken at `evidence_ms`."""
    return F.least(request_end, TimeBar.parse(timeframe).floor_col(evidence_ms - GRACE_MS))


def finalized(bars: DataFrame, end: Column) -> DataFrame:
    return bars.where(F.unix_millis("timestamp") < end)


def in_ranges(bars: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Bars in any of a few ranges; none for no ranges."""
    ms = F.unix_millis("timestamp")
    return bars.where(reduce(lambda a, b: a | b, [(ms >= s) & (ms < e) for s, e in ranges], F.lit(False)))


def restricted(bars: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Bars that start in a covered interval (keys, start, end).

    Intervals are cut at the months' ends, so dataset and month are an equi-join and only the bounds are left to test: a
    hash or merge join, never a nested loop.
    """
    cut = covered.select(*keys, F.explode(month_slices(F.col("start"), F.col("end"))).alias("s"))
    cut = cut.select(*[F.col(k).alias(f"r_{k}") for k in keys], month_index(F.col("s.start")).alias("r_month"), F.col("s.start").alias("r_start"), F.col("s.end").alias("r_end"))
    ms = F.unix_millis("timestamp")
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    on = reduce(lambda a, b: a & b, [*same, month_index(ms) == F.col("r_month"), ms >= F.col("r_start"), ms < F.col("r_end")])
    return bars.join(cut, on, "left_semi")


def scan_partial(bars: DataFrame, segments: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(covered bars, gaps): never raises for gaps."""
    cut = covered_and_gaps(segments, requests, keys)
    return restricted(bars, cut.where("status = 'available'"), keys), cut.where("status <> 'available'")


def scan(bars: DataFrame, segments: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Covered bars; raises CoverageError if any part of a request isn't covered."""
    found, missing = scan_partial(bars, segments, requests, keys)
    gap = missing.limit(1).collect()
    if gap:
        raise CoverageError(f"not covered: {gap[0].asDict()}")
    return found


def upsert(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """Both, keeping for each identity the last row: the batch's before the stored, then the later `seq`. Null equals null."""
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    w = Window.partitionBy(*identity).orderBy(F.desc("src"), F.desc("seq"))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "src")


def compare_files(indexed: DataFrame, found: DataFrame, identity: tuple[str, ...] = ("symbol",), lineage: tuple[str, ...] = ()) -> DataFrame:
    """(path, issue): the catalog's files against those in storage, both (path, identity, sha256, row_count, first, last)."""
    a, b = indexed.alias("i"), found.alias("f")
    both = a.join(b, F.col("i.path") == F.col("f.path"), "full_outer")
    checks = [("missing file", F.col("f.path").isNull()), ("orphan", F.col("i.path").isNull())]
    there = F.col("f.path").isNotNull() & F.col("i.path").isNotNull()
    for issue, columns in (("identity", identity), ("SHA", ["sha256"]), ("row count", ["row_count"]), ("bounds", ["first", "last"]), *([("lineage", lineage)] if lineage else [])):
        differs = reduce(lambda x, y: x | y, [~F.col(f"i.{c}").eqNullSafe(F.col(f"f.{c}")) for c in columns])
        checks.append((issue, there & differs))
    issues = F.filter(F.array(*[F.when(test, F.lit(issue)) for issue, test in checks]), lambda x: x.isNotNull())
    return both.select(F.coalesce("i.path", "f.path").alias("path"), F.explode(issues).alias("issue"))


def lineage_conflicts(files: DataFrame, keys: list[str]) -> DataFrame:
    """Datasets whose files come from more than one provider."""
    return files.groupBy(*keys).agg(F.count_distinct("provider").alias("providers")).where("providers > 1")


def unique_definitions(definitions: DataFrame, identity: list[str]) -> DataFrame:
    """Definitions whose identity no other has: every member of a collision goes."""
    n = F.count("*").over(Window.partitionBy(*identity))
    return definitions.withColumn("same", n).where("same = 1").drop("same")


def inferred_settle(definitions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, settle): where exactly one settlement and one definition fit."""
    return definitions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("settle").alias("m"), F.first("settle").alias("settle")).where("n = 1 AND m = 1").select(*keys, "settle")


def window_faults(windows: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, fault): observed windows that don't tile their request (start, end) exactly."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    step = join_keys(windows, requests.withColumnsRenamed({"start": "from", "end": "to"}), keys).withColumn("p", F.lag("end").over(w)).withColumn("n", F.lead("start").over(w))
    fault = (
        F.when(F.col("start") >= F.col("end"), "empty")
        .when(F.col("start") != F.coalesce("p", "from"), "not contiguous")
        .when(F.col("n").isNull() & (F.col("end") != F.col("to")), "short")
    )
    return step.select(*keys, "start", fault.alias("fault")).where("fault IS NOT NULL")


def outside_windows(bars: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Bars that no observed window holds."""
    inside = restricted(bars, windows, keys).select(*keys, "timestamp").distinct()
    on = reduce(lambda a, b: a & b, [bars[c].eqNullSafe(inside[c]) for c in [*keys, "timestamp"]])
    return bars.join(inside, on, "left_anti")
