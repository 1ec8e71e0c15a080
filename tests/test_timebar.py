import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions.timebar import TimeBar, missing_between, month_slices
from barloom.model import Dataset, InvalidRequestError, UnsupportedError, parse_time, percent_slug, to_ms

BARS = ["1s", "1m", "5m", "4h", "1d", "60d", "1w", "1M"]


def at(*when):
    return to_ms(datetime(*when, tzinfo=UTC))


@pytest.mark.parametrize("text", ["1min", "1H", "60", "m1", "1", "s", "0m", "-1m", "1x", "", "1 m", "2w", "3M", "1m\n"])
def test_bad_timeframes(text):
    with pytest.raises(ValueError):
        TimeBar.parse(text)


def test_columns_equal_values(spark):
    rng = random.Random(1)
    moments = [rng.randrange(at(1950, 1, 1), at(2060, 1, 1)) for _ in range(2000)] + [at(2024, 2, 29), at(2023, 12, 31, 23), at(1969, 12, 31, 23), 0, -1]
    rows = spark.createDataFrame([(m,) for m in moments], "ms long")
    for text in BARS:
        bar = TimeBar.parse(text)
        assert str(bar) == text
        ms = F.col("ms")
        got = rows.select("ms", bar.floor_col(ms), bar.next_col(ms), bar.at_or_after_col(ms), bar.previous_col(ms)).collect()
        for r in got:
            m = r[0]
            assert tuple(r)[1:] == (bar.floor(m), bar.next(m), bar.at_or_after(m), bar.floor(m - 1)), (text, m)


def test_missing_between_is_a_walk(spark):
    rng = random.Random(2)
    for text, span in (("1m", 10**7), ("1h", 10**9), ("1w", 10**10), ("1M", 10**11)):
        bar = TimeBar.parse(text)
        pairs = [(p, p + rng.randrange(-span, span)) for p in (rng.randrange(at(1960, 1, 1), at(2030, 1, 1)) for _ in range(300))]
        got = spark.createDataFrame(pairs, "p long, c long").select("p", "c", missing_between(F.col("p"), F.col("c"), bar)).collect()
        for p, c, n in got:
            walk, moment = 0, bar.next(p)
            while moment < c:
                walk, moment = walk + 1, moment + bar.step_ms if bar.step_ms else bar.next(moment)
            assert n == walk, (text, p, c)


def test_month_slices(spark):
    rows = spark.createDataFrame([(at(2023, 11, 15), at(2024, 2, 1))], "s long, e long")
    found = rows.select(F.explode(month_slices(F.col("s"), F.col("e"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in found] == [(at(2023, 11, 15), at(2023, 12, 1)), (at(2023, 12, 1), at(2024, 1, 1)), (at(2024, 1, 1), at(2024, 2, 1))]


def test_identity():
    assert Dataset("okx", "BTC/USDT", "perpetual", "USDT", "1h").settle == "USDT"
    for bad in (("OKX", "BTC/USDT", "spot", None), ("okx", "BTCUSDT", "spot", None), ("okx", "A/B/C", "spot", None), ("okx", "A/B", "swap", None), ("okx", "A/B", "spot", "B"), ("okx", "A/B", "perpetual", "x/y")):
        with pytest.raises(InvalidRequestError):
            Dataset(*bad, "1h")
    with pytest.raises(UnsupportedError):
        Dataset("okx", "A/B", "future", "B", "1h")
    assert parse_time(date(2024, 1, 1)) == parse_time("2024-01-01") == parse_time("2024-01-01T01:00:00+01:00")
    with pytest.raises(InvalidRequestError):
        parse_time(datetime(2024, 1, 1))
    assert percent_slug("A", "B.", "C/D") == "A-B%2E-C%2FD"
    assert parse_time(datetime(2024, 1, 1, tzinfo=UTC) + timedelta(0)).tzinfo == UTC
