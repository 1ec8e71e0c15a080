"""A deterministic live venue for tests: what it says depends on the position alone."""

from __future__ import annotations

import threading
from datetime import UTC, datetime

from barloom.streaming.adapter import pulled

MINUTE = 60_000
#: 2026-08-07 00:01 UTC.
BASE = int(datetime(2026, 8, 7, 0, 1, tzinfo=UTC).timestamp() * 1000)


def _update(name: str, minute: int, close: float) -> dict:
    return {"dataset": name, "row": [BASE + minute * MINUTE, 100.0, 200.0, 50.0, close, 1.0]}


def revising(exchange: str, names: list[str], position: int):
    """A bar, a revision of it, and the next bar; then the stream ends."""
    steps = [(0, 101.0), (0, 102.0), (1, 103.0)]
    return ([_update(n, *steps[position]) for n in names], position + 1) if position < len(steps) else None


def backwards(exchange: str, names: list[str], position: int):
    """The second bar goes back in time."""
    return [_update(names[0], -position, 101.0)], position + 1


def foreign(exchange: str, names: list[str], position: int):
    return [_update("X/Y:spot::1m", 0, 101.0)], position + 1


def flooding(exchange: str, names: list[str], position: int):
    return [_update(names[0], 0, 101.0)] * 2000, position + 1


class Watching:
    """A native client that says three bars of each market it is asked for, then waits."""

    def __init__(self, known: str):
        self.known, self.has, self.said = known, {"watchOHLCV": True}, {}
        self.closed = threading.Event()

    def load_markets(self) -> dict:
        return {}

    def watch_ohlcv(self, symbol: str, timeframe: str) -> list:
        minute = self.said[symbol] = self.said.get(symbol, -1) + 1
        if minute > 2:
            self.closed.wait()
            return []
        return [[BASE + minute * MINUTE, 100.0, 200.0, 50.0, 101.0 + minute + len(self.known), 1.0]]

    def close(self) -> None:
        self.closed.set()


def watched(exchange: str, names: list[str], position: int):
    return pulled(Watching, exchange, names, position)


def clock() -> datetime:
    """Two seconds into the first live bar."""
    return datetime.fromtimestamp(BASE / 1000 + 2, UTC)
