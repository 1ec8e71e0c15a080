"""Live bars of a venue, as a Python streaming data source.

The client is asked for what came after a position; each update is stamped with its receipt here. A session ends for good when its
stream ends, an update is malformed or of a dataset nobody subscribed to, or more come at once than the buffer holds: nothing is
retried, joined or dropped in silence, and nothing is replayed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from barloom.model import ProviderError
from barloom.schema import KEY, PROVIDER_BARS, VALUES
from barloom.sources.provider import load

CAPACITY = 1024
LIVE = T.StructType(
    [
        *[T.StructField(k, T.StringType(), True) for k in KEY],
        *PROVIDER_BARS.fields,
        T.StructField("seq", T.LongType(), False),
        T.StructField("received", T.TimestampType(), False),
    ]
)


def parse_update(raw: object) -> tuple[str, tuple]:
    """(subscription, (bar start in ms, open, high, low, close, volume)) of {"dataset": text, "row": at least six fields}."""
    try:
        row = raw["row"]
        if len(row) < 1 + len(VALUES) or any(isinstance(x, bool) for x in row[:6]):
            raise ValueError("too few fields, or not numbers")
        return raw["dataset"], (int(row[0]), *(float(x) for x in row[1:6]))
    except (TypeError, ValueError, KeyError, IndexError) as e:
        raise ProviderError(f"a live update of {raw!r}: {e}") from e


class LiveSource(DataSource):
    """format("barloom_live"): options client and clock (module:function), exchange, subscriptions (JSON: name to identity)."""

    @classmethod
    def name(cls) -> str:
        return "barloom_live"

    def schema(self):
        return LIVE

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LiveReader(dict(self.options))


class LiveReader(SimpleDataSourceStreamReader):
    """client(exchange, names, position) gives (updates, next position), or None once the stream has ended."""

    def __init__(self, options: dict[str, str]):
        self.client, self.exchange = options["client"], options["exchange"]
        self.subscriptions = json.loads(options["subscriptions"])
        self.clock = options.get("clock")

    def initialOffset(self) -> dict:
        return {"position": 0, "seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        got = load(self.client)(self.exchange, list(self.subscriptions), start["position"])
        if got is None:
            raise ProviderError("the live stream ended")
        updates, position = got
        if len(updates) > CAPACITY:
            raise ProviderError(f"{len(updates)} live updates at once overflow the buffer of {CAPACITY}")
        rows = []
        for i, raw in enumerate(updates):
            name, (at, *values) = parse_update(raw)
            if name not in self.subscriptions:
                raise ProviderError(f"a live update of {name!r}, which is not subscribed to")
            received = load(self.clock)() if self.clock else datetime.now(UTC)
            rows.append((*self.subscriptions[name], datetime.fromtimestamp(at / 1000, UTC), *values, start["seq"] + i, received))
        return iter(rows), {"position": position, "seq": start["seq"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        raise ProviderError("a live session is not replayed")
