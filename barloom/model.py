"""Identities, requests and errors."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from barloom.functions.timebar import TimeBar, next_bar


class BarloomError(Exception):
    """Base of all errors of the library."""


class InvalidRequestError(BarloomError):
    """The request contradicts itself or the vocabulary."""


class UnsupportedError(BarloomError):
    """Well formed, but not offered."""


class ProviderError(BarloomError):
    """A provider broke its contract, or its bars failed validation."""


class CoverageError(BarloomError):
    """A strict read met a range that isn't covered."""


class StorageError(BarloomError):
    """Stored files contradict themselves."""


class CatalogError(BarloomError):
    """The catalog is absent, foreign, or of another version."""


class SyncError(BarloomError):
    """A sync did not finish."""


MARKETS = ("spot", "perpetual", "future", "option")
_EXCHANGE = re.compile(r"[a-z][a-z0-9]*")


@dataclass(frozen=True)
class Dataset:
    exchange: str
    symbol: str
    market: str
    settle: str | None
    timeframe: str

    def __post_init__(self) -> None:
        if not _EXCHANGE.fullmatch(self.exchange):
            raise InvalidRequestError(f"exchange {self.exchange!r} is not a lower-case slug")
        symbol = unicodedata.normalize("NFC", self.symbol)
        base, slash, quote = symbol.partition("/")
        if not (slash and base and quote) or "/" in quote:
            raise InvalidRequestError(f"symbol {self.symbol!r} is not BASE/QUOTE")
        if self.market not in MARKETS:
            raise InvalidRequestError(f"market {self.market!r}")
        if self.market in ("future", "option"):
            raise UnsupportedError(f"market {self.market!r}")
        if self.settle is not None:
            settle = unicodedata.normalize("NFC", self.settle)
            if self.market == "spot" or not settle or "/" in settle:
                raise InvalidRequestError(f"settle {self.settle!r}")
            object.__setattr__(self, "settle", settle)
        for text in (symbol, self.settle or ""):
            try:
                text.encode()
            except UnicodeEncodeError as e:
                raise InvalidRequestError(f"{text!r} is not UTF-8") from e
        object.__setattr__(self, "symbol", symbol)
        try:
            TimeBar.parse(self.timeframe)
        except ValueError as e:
            raise InvalidRequestError(str(e)) from e


@dataclass(frozen=True)
class BarRequest:
    dataset: Dataset
    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        for t in (self.start, self.end):
            if t.tzinfo is None or t.utcoffset() != timedelta(0):
                raise InvalidRequestError("bounds are UTC")
        if self.start >= self.end:
            raise InvalidRequestError("start must lie before end")
        bar = TimeBar.parse(self.dataset.timeframe)
        for t in (self.start, self.end):
            ms = to_ms(t)
            if t.microsecond % 1000 or bar.floor(ms) != ms:
                raise InvalidRequestError(f"{t} is not on a {self.dataset.timeframe} boundary")


def to_ms(t: datetime) -> int:
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def parse_time(value: datetime | date | str) -> datetime:
    """Aware datetimes, plain dates (midnight UTC) and ISO texts with an offset; naive ones are refused."""
    if isinstance(value, str):
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            value = date.fromisoformat(value)
        else:
            try:
                value = datetime.fromisoformat(value)
            except ValueError as e:
                raise InvalidRequestError(f"{value!r} is no time") from e
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise InvalidRequestError("naive times are refused")
        return value.astimezone(UTC)
    return datetime(value.year, value.month, value.day, tzinfo=UTC)


def default_end(timeframe: str, now: datetime, grace_ms: int = 5000) -> int:
    """The last boundary whose bar can be final: floor(now - grace). Local reads pass no grace."""
    return TimeBar.parse(timeframe).floor(to_ms(now) - grace_ms)


def percent_slug(*parts: str) -> str:
    """Path slug: parts in NFC, with reserved, edge-dot, blank and category-C characters as %HH, joined by -."""

    def one(text: str) -> str:
        text, out = unicodedata.normalize("NFC", text), []
        for i, c in enumerate(text):
            edge = c == "." and i in (0, len(text) - 1)
            if edge or c in '<>:"/\\|?*%-' or c.isspace() or unicodedata.category(c).startswith("C"):
                out.append("".join(f"%{b:02X}" for b in c.encode()))
            else:
                out.append(c)
        return "".join(out)

    return "-".join(one(p) for p in parts)


def advance(timeframe: str, ms: int, bars: int) -> int:
    """`bars` boundaries on from an aligned moment."""
    for _ in range(bars):
        ms = next_bar(timeframe, ms)
    return ms
