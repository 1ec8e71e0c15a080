"""Data-quality findings of bar batches.

All batch counters come from one aggregation, order and gap checks from one window pass per dataset; findings are rows.
`seq` is the order of arrival: DataFrames have none, and gaps, order and returns are defined on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.timebar import TimeBar, missing_between
from barloom.model import ProviderError
from barloom.schema import BARS, KEY, PRICES, VALUES

OUTLIER_RETURN = 0.25
INF = float("inf")


def non_finite(c: str) -> Column:
    return F.isnan(c) | (F.abs(F.col(c)) == INF)


def ohlc_violation() -> Column:
    """True where low <= open, close <= high doesn't hold; null prices drop out."""
    o, h, lo, c = (F.col(x) for x in PRICES)
    return ~((lo <= o) & (lo <= c) & (o <= h) & (c <= h) & (lo <= h))


def schema_findings(schema: T.StructType) -> list[tuple[str, str, str]]:
    """(severity, code, message) of a batch's schema, without a job."""
    found, wanted, have = [], {f.name: f.dataType for f in BARS}, {f.name: f.dataType for f in schema if f.name != "seq"}
    if missing := [c for c in wanted if c not in have]:
        found.append(("fatal", "schema.missing_columns", ", ".join(missing)))
    if extra := [c for c in have if c not in wanted]:
        found.append(("fatal", "schema.unexpected_columns", ", ".join(extra)))
    wrong = [c for c in wanted if c in have and have[c] != wanted[c] and not (c == "timestamp" and isinstance(have[c], T.TimestampNTZType))]
    if wrong:
        found.append(("fatal", "schema.dtype_mismatch", ", ".join(wrong)))
    if isinstance(have.get("timestamp"), T.TimestampNTZType):
        found.append(("fatal", "timestamp.not_utc", "timestamp has no zone"))
    return found


def counters(bar: TimeBar, start: int | None = None, end: int | None = None) -> dict[str, Column]:
    """code (and column) -> count, all for one aggregation, in the order findings are told."""
    ms = F.unix_millis("timestamp")
    found: dict[str, Column] = {}
    for c in [f.name for f in BARS if f.name != "settle"]:
        found[f"null.disallowed:{c}"] = F.count_if(F.col(c).isNull())
    found["ohlc.invariant_violation"] = F.count_if(ohlc_violation())
    for c in PRICES:
        found[f"price.non_finite:{c}"] = F.count_if(non_finite(c))
        found[f"price.non_positive:{c}"] = F.count_if(F.col(c) <= 0)
    found["volume.non_finite"] = F.count_if(non_finite("volume"))
    found["volume.negative"] = F.count_if(F.col("volume") < 0)
    found["identity.duplicate"] = F.count("*") - F.count_distinct(F.struct(*KEY, "timestamp"))
    found["timestamp.off_timeframe_boundary"] = F.count_if(bar.floor_col(ms) != ms)
    if start is not None:
        found["range.out_of_request"] = F.count_if((ms < start) | (ms >= end))
    return found


def findings(bars: DataFrame, timeframe: str, keys: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """(keys, severity, code, row_count): the findings of each dataset, counts above 0 only.

    `bars` has the canonical columns and `seq`. Fatal codes come from `counters` and the order of arrival, warnings are gaps and
    outlier returns. A dataset without rows gives nothing.
    """
    bar = TimeBar.parse(timeframe)
    w = Window.partitionBy(*keys).orderBy("seq")
    ms = F.unix_millis("timestamp")
    step = bars.withColumn("p", F.lag(ms).over(w)).withColumn("pc", F.lag("close").over(w))
    ratio = F.try_divide(F.col("close"), F.col("pc"))
    counts = counters(bar, start, end) | {
        "timestamp.unordered": F.count_if(F.col("p") > ms),
        "timestamp.non_monotonic": F.count("*") - F.count_distinct("timestamp"),
        "coverage.timeframe_gap": F.coalesce(F.sum(missing_between(F.col("p"), ms, bar)), F.lit(0)),
        "statistics.outlier_return": F.count_if(((F.abs(ratio - 1) > OUTLIER_RETURN) | ((F.col("pc") == 0) & F.col("close").isNotNull()))),
    }
    wide = step.groupBy(*keys).agg(*[v.cast("long").alias(f"c{i}") for i, v in enumerate(counts.values())])
    names = list(counts)
    at = {n: i for i, n in enumerate(names)}
    # Not monotonic is told only of sorted input.
    row = F.array(
        *[
            F.struct(
                F.lit("warning" if n in ("coverage.timeframe_gap", "statistics.outlier_return") else "fatal").alias("severity"),
                F.lit(n).alias("code"),
                (F.when(F.col(f"c{at['timestamp.unordered']}") == 0, F.col(f"c{i}")).otherwise(0) if n == "timestamp.non_monotonic" else F.col(f"c{i}")).alias("row_count"),
            )
            for i, n in enumerate(names)
        ]
    )
    return wide.select(*keys, F.explode(row).alias("f")).select(*keys, "f.*").where("row_count > 0")


def enforce(bars: DataFrame, timeframe: str, keys: list[str], error: type[Exception] = ProviderError, **bounds) -> DataFrame:
    """The warnings; raises `error` listing the fatal codes if there is one."""
    bad = schema_findings(bars.schema)
    if bad:
        raise error("; ".join(f"{c}: {m}" for _, c, m in bad))
    found = findings(bars, timeframe, keys, **bounds)
    fatal = found.where("severity = 'fatal'").groupBy("code").agg(F.sum("row_count").alias("n")).collect()
    if fatal:
        raise error("; ".join(f"{r['code']} ({r['n']})" for r in sorted(fatal)))
    return found


def gaps(bars: DataFrame, timeframe: str, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys, gaps, missing): breaks in each dataset's bars and the bars missing in them."""
    bar, ms = TimeBar.parse(timeframe), F.unix_millis("timestamp")
    step = bars.withColumn("p", F.lag(ms).over(Window.partitionBy(*keys).orderBy(order)))
    lost = F.coalesce(missing_between(F.col("p"), ms, bar), F.lit(0))
    return step.groupBy(*keys).agg(F.count_if(lost > 0).alias("gaps"), F.sum(lost).alias("missing"))


def valid_update() -> Column:
    """Scalar check of a live update: finite, prices above 0, volume from 0, invariants."""
    finite = [F.col(c).isNotNull() & ~non_finite(c) for c in VALUES]
    positive = [F.col(c) > 0 for c in PRICES]
    return reduce(lambda a, b: a & b, [*finite, *positive, F.col("volume") >= 0, ~ohlc_violation()])
