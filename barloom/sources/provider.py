"""Historical bars from a provider, as a Python data source.

A request becomes windows of at most a page of bars; each is one partition, read with retries and checked row by row. Windows
come from the calendar, never from the last row seen, so an empty page cannot hide later bars. The moment of
evidence is taken on the driver before the job and handed in, since tasks may run again.
"""

from __future__ import annotations

import importlib
import inspect
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.functions.timebar import TimeBar
from barloom.model import BarloomError, BarRequest, InvalidRequestError, ProviderError, UnsupportedError, to_ms
from barloom.operators import quality, reading
from barloom.schema import PROVIDER_BARS, VALUES
from barloom.session import domain_errors, settled

#: Most bars of a venue's page.
PAGE_BARS = {"coinbase": 300, "binance": 1000, "binanceusdm": 1000, "bybit": 1000, "okx": 100}
RETRIES, BACKOFF_S = 5, 0.5


SPI = 1
GROUP = "barloom.providers"


@dataclass(frozen=True)
class Provider:
    """What a provider offers. `client`, `markets` and `live` are module:function, since tasks import them by name."""

    name: str
    version: str
    client: str
    markets: str | None = None
    live: str | None = None
    page: int | None = None
    spi: int = SPI

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9-]*", self.name) or not self.version:
            raise ProviderError(f"provider {self.name!r} of version {self.version!r}")
        if self.spi != SPI:
            raise ProviderError(f"{self.name} speaks version {self.spi} of the protocol; this is {SPI}")


def load(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def installed(name: str | None = None) -> Provider:
    """The one provider that installed packages offer, or the one of that name."""
    offers = [e for e in entry_points(group=GROUP) if name in (None, e.name)]
    if len(offers) != 1:
        raise UnsupportedError(f"{len(offers)} installed providers fit {name!r}; one is needed")
    found = offers[0].load()
    if not isinstance(found, Provider) or found.name != offers[0].name:
        raise ProviderError(f"{offers[0].value} is not the provider {offers[0].name}")
    return found


class TransientError(Exception):
    """The venue may answer if asked again."""


@dataclass
class Window(InputPartition):
    start: int
    end: int

    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


def page_windows(timeframe: str, start: int, end: int, page: int) -> list[Window]:
    """[start, end) cut into windows of at most `page` bars, contiguous and aligned."""
    if page <= 0:
        raise ValueError("a page holds bars")
    bar, found = TimeBar.parse(timeframe), []
    while start < end:
        stop = bar.later(start, page)
        found.append(Window(start, min(stop, end)))
        start = found[-1].end
    return found


@dataclass(frozen=True)
class Market:
    """What a client is told of the market it is asked for: the venue's whole identity, and its native id if one is known."""

    exchange: str
    symbol: str
    market: str
    settle: str | None = None
    native_id: str | None = None


@dataclass(frozen=True)
class Page:
    """What a client may give instead of bare rows: the rows, and the market they are of."""

    rows: list
    market: Market


def rows_of(answer: list | Page, asked: Market) -> list:
    """The rows of an answer; ProviderError if they are of another market than the one that was asked for."""
    if not isinstance(answer, Page):
        return answer
    for part in ("exchange", "symbol", "market", "settle"):
        if getattr(answer.market, part) != getattr(asked, part) and (part != "settle" or asked.settle is not None):
            raise ProviderError(f"asked for {asked}, got {answer.market}")
    return answer.rows


def asking(client: str, market: Market, timeframe: str) -> Callable[[int, int], list]:
    """A function of (since, until) that asks the client, by symbol or, if it takes one, for the whole market.

    What the client raises beyond transient failures comes as ProviderError with its cause; errors of the library pass.
    """
    fetch = load(client)
    more = {"market": market} if "market" in inspect.signature(fetch).parameters else {}

    def ask(since: int, until: int) -> list:
        try:
            return rows_of(fetch(market.symbol, timeframe, since, until, **more), market)
        except (TransientError, BarloomError):
            raise
        except Exception as e:
            raise ProviderError(f"{client} failed for {market}: {type(e).__name__}: {e}") from e

    return ask


def check_rows(rows: list, window: Window) -> list[tuple]:
    """(ms, open, high, low, close, volume) of raw rows; raises if one is short, not numeric, out of order or outside."""
    found, before = [], None
    for row in rows:
        if not isinstance(row, (list, tuple)) or len(row) < 6:
            raise ProviderError(f"a row of {row!r}")
        try:
            at, *values = int(row[0]), *(float(x) for x in row[1:6])
        except (TypeError, ValueError) as e:
            raise ProviderError(f"a row that isn't numeric: {row!r}") from e
        if before is not None and at <= before:
            raise ProviderError(f"rows are not ascending at {at}")
        if not window.start <= at < window.end:
            raise ProviderError(f"{at} lies outside [{window.start}, {window.end})")
        found.append((at, *values))
        before = at
    return found


def with_retries(call: Callable[[], list], sleep: Callable[[float], None] = time.sleep) -> list:
    """Only transient failures are tried again, waiting twice as long each time."""
    for attempt in range(RETRIES + 1):
        try:
            return call()
        except TransientError as e:
            if attempt == RETRIES:
                raise ProviderError(f"still failing after {RETRIES} retries: {e}") from e
            sleep(BACKOFF_S * 2**attempt)
    raise AssertionError


class BarSource(DataSource):
    """format("barloom"): options client (module:function), market (JSON), timeframe, start, end (ms), page."""

    @classmethod
    def name(cls) -> str:
        return "barloom"

    def schema(self):
        return PROVIDER_BARS

    def reader(self, schema) -> DataSourceReader:
        return BarReader(dict(self.options))


class BarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Window]:
        o = self.options
        return page_windows(o["timeframe"], int(o["start"]), int(o["end"]), int(o["page"]))

    def read(self, partition: Window) -> Iterator[tuple]:
        ask = asking(self.options["client"], Market(**json.loads(self.options["market"])), self.options["timeframe"])
        rows = with_retries(lambda: ask(partition.start, partition.end - 1))
        for at, *values in check_rows(rows, partition):
            yield (datetime.fromtimestamp(at / 1000, UTC), *values)


def observe(spark: SparkSession, request: BarRequest, client: str, page: int | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC), unfinished: bool = False, native_id: str | None = None) -> tuple[DataFrame, int, DataFrame]:
    """(canonical bars, end of what is final, warnings) of a request; raises ProviderError on fatal findings.

    Unfinished bars are left out and stay missing, but with `unfinished`. `seq` is the order of time within the observation.
    The rows are settled before anything is proved of them. The moment of evidence lies before the venue is asked; a clock that
    stands before it afterwards is an error.
    """
    d = request.dataset
    page = page or PAGE_BARS.get(d.exchange)
    if page is None:
        raise UnsupportedError(f"no page size is known for {d.exchange}")
    evidence = to_ms(now())
    start, end = to_ms(request.start), to_ms(request.end)
    final = end if unfinished else min(end, TimeBar.parse(d.timeframe).floor(evidence - reading.GRACE_MS))
    spark.dataSource.register(BarSource)
    market = Market(d.exchange, d.symbol, d.market, d.settle, native_id)
    options = {"client": client, "market": json.dumps(asdict(market)), "timeframe": d.timeframe, "start": start, "end": end, "page": page}
    rows = spark.read.format("barloom").options(**{k: str(v) for k, v in options.items()}).load()
    bars = reading.finalized(rows, F.lit(final)).select(
        *[F.lit(v).cast("string").alias(k) for k, v in (("exchange", d.exchange), ("symbol", d.symbol), ("market", d.market), ("settle", d.settle), ("timeframe", d.timeframe))],
        "timestamp", *VALUES, F.unix_millis("timestamp").alias("seq"),
    )
    with domain_errors():
        bars = settled(bars)  # read() runs for each action: quality, rows and coverage must see one observation
    if to_ms(now()) < evidence:
        raise ProviderError("the clock went back while the venue was asked")
    warnings = quality.enforce(bars, d.timeframe, ["symbol"], ProviderError, start=start, end=end)
    return bars, final, warnings


def definitions(spark: SparkSession, provider: Provider, exchange: str, market: str) -> DataFrame:
    """The venue's market definitions (schema DEFINITIONS), translated from its native ones."""
    from barloom.sources import markets

    if market not in ("spot", "perpetual"):
        raise (UnsupportedError if market in ("future", "option") else InvalidRequestError)(f"market {market!r}")
    if provider.markets is None:
        raise UnsupportedError(f"{provider.name} offers no market definitions")
    native, timeframes = load(provider.markets)(exchange, market)
    return markets.translate(spark, native, exchange, market, timeframes)


def flat_client(symbol: str, timeframe: str, since: int, until: int) -> list[list]:
    """A deterministic venue for tests: every bar of the calendar, rising by one, none in hours divisible by seven."""
    bar, rows, at = TimeBar.parse(timeframe), [], since
    while at <= until:
        if (at // 3_600_000) % 7:
            price = 100.0 + (at // 3_600_000) % 10
            rows.append([at, price, price + 1, price - 1, price, 10.0])
        at = bar.next(at)
    return rows


def market_client(symbol: str, timeframe: str, since: int, until: int, market: Market) -> Page:
    """A venue for tests whose prices depend on the market: a perpetual stands ten above the spot market, and more by its settlement."""
    above = 0 if market.market == "spot" else 10 + len(market.settle or "")
    rows = steady_client(symbol, timeframe, since, until)
    return Page([[r[0], *(x + above for x in r[1:5]), r[5]] for r in rows], market)


def steady_client(symbol: str, timeframe: str, since: int, until: int) -> list[list]:
    """A venue for tests without holes."""
    bar, rows, at = TimeBar.parse(timeframe), [], since
    while at <= until:
        price = 100.0 + (at // 3_600_000) % 10
        rows.append([at, price, price + 1, price - 1, price, 10.0])
        at = bar.next(at)
    return rows
