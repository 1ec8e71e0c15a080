"""Calendar arithmetic of time bars, as values and as columns.

Moments are milliseconds since 1970 in UTC. All column forms are built-in functions of whole numbers and dates, so
neither a session's time zone nor the sign of a moment matters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
DAY_MS = UNIT_MS["d"]
#: Monday 1970-01-05.
WEEK_ORIGIN_MS = 345_600_000
_GRAMMAR = re.compile(r"([1-9]\d*)([smhdwM])")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class TimeBar:
    amount: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> TimeBar:
        found = _GRAMMAR.fullmatch(text)
        if not found or (found[2] in "wM" and found[1] != "1"):
            raise ValueError(f"{text!r} is no timeframe")
        return cls(int(found[1]), found[2])

    def __str__(self) -> str:
        return f"{self.amount}{self.unit}"

    @property
    def is_calendar(self) -> bool:
        return self.unit in "wM"

    @property
    def step_ms(self) -> int | None:
        """Milliseconds of a bar; None for months."""
        return None if self.unit == "M" else self.amount * UNIT_MS[self.unit]

    @property
    def origin_ms(self) -> int:
        return WEEK_ORIGIN_MS if self.unit == "w" else 0

    def floor(self, ms: int) -> int:
        if self.unit == "M":
            t = _EPOCH + timedelta(milliseconds=ms)
            return (datetime(t.year, t.month, 1, tzinfo=UTC) - _EPOCH) // timedelta(milliseconds=1)
        return ms - (ms - self.origin_ms) % self.step_ms

    def later(self, ms: int, bars: int) -> int:
        """The boundary `bars` bars after ms's own bar began, without a step for each."""
        if self.unit == "M":
            t = _EPOCH + timedelta(milliseconds=self.floor(ms))
            month = t.year * 12 + t.month - 1 + bars
            return (datetime(month // 12, month % 12 + 1, 1, tzinfo=UTC) - _EPOCH) // timedelta(milliseconds=1)
        return self.floor(ms) + bars * self.step_ms

    def next(self, ms: int) -> int:
        """The first boundary after ms."""
        if self.unit == "M":
            t = _EPOCH + timedelta(milliseconds=self.floor(ms))
            return (datetime(t.year + t.month // 12, t.month % 12 + 1, 1, tzinfo=UTC) - _EPOCH) // timedelta(milliseconds=1)
        return self.floor(ms) + self.step_ms

    def previous(self, ms: int) -> int:
        """The boundary before a boundary."""
        return self.floor(ms - 1)

    def at_or_after(self, ms: int) -> int:
        return ms if self.floor(ms) == ms else self.next(ms)

    def intervals(self, start: int, end: int) -> list[tuple[int, int]]:
        """Bars from an aligned start; the last may run past an unaligned end."""
        if self.floor(start) != start or start >= end:
            raise ValueError("start is aligned and lies before end")
        found = []
        while start < end:
            found.append((start, self.next(start)))
            start = found[-1][1]
        return found

    # Column forms

    def floor_col(self, ms: Column) -> Column:
        if self.unit == "M":
            return F.unix_date(F.trunc(_date(ms), "MM")).cast("long") * DAY_MS
        return ms - F.pmod(ms - F.lit(self.origin_ms), F.lit(self.step_ms))

    def next_col(self, ms: Column) -> Column:
        if self.unit == "M":
            return F.unix_date(F.add_months(F.trunc(_date(ms), "MM"), 1)).cast("long") * DAY_MS
        return self.floor_col(ms) + F.lit(self.step_ms)

    def previous_col(self, ms: Column) -> Column:
        return self.floor_col(ms - 1)

    def at_or_after_col(self, ms: Column) -> Column:
        return F.when(self.floor_col(ms) == ms, ms).otherwise(self.next_col(ms))

    def starts_col(self, start: Column, end: Column) -> Column:
        """Array of the bar starts in [start, end), start being aligned."""
        if self.unit == "M":
            days = F.sequence(_date(start), _date(end - 1), F.expr("interval 1 month"))
            return F.transform(days, lambda d: F.unix_date(d).cast("long") * DAY_MS)
        return F.sequence(start, end - 1, F.lit(self.step_ms).cast("long"))


def next_bar(timeframe: str, ms: int) -> int:
    return TimeBar.parse(timeframe).next(ms)


def _date(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int"))


def year_of(ms: Column) -> Column:
    return F.year(_date(ms))


def month_of(ms: Column) -> Column:
    return F.month(_date(ms))


def month_index(ms: Column) -> Column:
    return (F.year(_date(ms)) * 12 + F.month(_date(ms))).cast("long")


def month_slices(start: Column, end: Column) -> Column:
    """Array of (start, end): [start, end) cut at the months' ends."""
    month = TimeBar(1, "M")
    return F.transform(
        month.starts_col(month.floor_col(start), end),
        lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(month.next_col(m), end).alias("end")),
    )


def missing_between(previous: Column, current: Column, bar: TimeBar) -> Column:
    """Bars missing between two moments; 0 without a gap. One closed form for aligned, misaligned and unordered input."""
    expected = bar.next_col(previous)
    if bar.unit == "M":
        off = F.when(bar.floor_col(current) == current, 0).otherwise(1)
        missing = month_index(current) - month_index(previous) - 1 + off
    else:
        missing = F.ceil((current - expected) / F.lit(bar.step_ms)).cast("long")
    return F.when(current > expected, missing).otherwise(F.lit(0)).cast("long")
