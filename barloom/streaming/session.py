"""A live session: subscriptions, one streaming query, and its updates one by one.

    with data.live("okx") as live:
        live.subscribe_bar_updates(bars, bootstrap=True)
        for update in live: ...

States go new, open, running, then closed or failed, and never back. Live updates never touch catalog or files.
"""

from __future__ import annotations

import asyncio
import json
import queue
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from barloom.functions.timebar import TimeBar
from barloom.model import BarRequest, Dataset, InvalidRequestError, ProviderError, UnsupportedError, to_ms
from barloom.schema import KEY, VALUES
from barloom.session import shared_folder
from barloom.sources import provider as providers
from barloom.streaming import live
from barloom.streaming.source import CAPACITY, LiveSource

BOOTSTRAP_BARS = 2
POLL_S = 0.05
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class LiveMarketData:
    def __init__(self, data, exchange: str):
        self.data, self.exchange, self.state = data, exchange, "new"
        self.clock: str | None = None
        self._subscribed: dict[Dataset, bool] = {}
        self._ready: queue.Queue[Row] = queue.Queue(CAPACITY)
        self._query = None
        self._overflow: ProviderError | None = None

    # Life

    def __enter__(self) -> LiveMarketData:
        if self.state != "new":
            raise InvalidRequestError(f"the session is {self.state}; each is entered once")
        if self.data.provider.live is None:
            raise UnsupportedError(f"{self.data.provider.name} offers no live bars")
        self.state = "open"
        return self

    def __exit__(self, kind, failure, trace) -> None:
        """Stop the stream. A failure that no read has told yet is raised here; that the venue's stream ended is none."""
        told = self.state == "failed"
        if not told:
            self.state = "closed"
        try:
            if self._query is not None:
                unread = None if told or failure is not None else self._query.exception()
                self._query.stop()
                if unread is not None and "the live stream ended" not in str(unread):
                    self.state = "failed"
                    raise self._overflow or ProviderError(f"the live session failed: {unread}")
        except ProviderError:
            raise
        except Exception as cleanup:
            if failure is not None:
                raise BaseExceptionGroup("the session and its end both failed", [failure, cleanup]) from None
            raise

    async def __aenter__(self) -> LiveMarketData:
        return self.__enter__()

    async def __aexit__(self, kind, failure, trace) -> None:
        await asyncio.to_thread(self.__exit__, kind, failure, trace)

    # Subscriptions

    def subscribe_bar_updates(self, bars, *, bootstrap: bool = False) -> None:
        """Add a dataset, before the first update is asked for. With `bootstrap`, its last closed bars come with the first update."""
        if self.state != "open":
            raise InvalidRequestError(f"the session is {self.state}")
        if bars.data is not self.data:
            raise InvalidRequestError("the dataset is of another facade")
        if bars.dataset.exchange != self.exchange:
            raise InvalidRequestError(f"the session is of {self.exchange}")
        d = bars.resolved()
        if d in self._subscribed:
            raise InvalidRequestError(f"{d} is subscribed to already")
        self._subscribed[d] = bootstrap

    @staticmethod
    def name(d: Dataset) -> str:
        """What the client calls a dataset."""
        return ":".join([d.symbol, d.market, d.settle or "", d.timeframe])

    # Updates

    def _start(self) -> None:
        if not self._subscribed:
            raise InvalidRequestError("nothing is subscribed to")
        spark = self.data.spark
        spark.dataSource.register(LiveSource)
        options = {
            "client": self.data.provider.live, "exchange": self.exchange,
            "subscriptions": json.dumps({self.name(d): [getattr(d, k) for k in KEY] for d in self._subscribed}),
        }
        if self.clock:
            options["clock"] = self.clock
        raw = spark.readStream.format("barloom_live").options(**options).load()
        writer = live.ordered(live.checked(raw), KEY).writeStream.foreachBatch(self._take)
        folder = f"{shared_folder(spark)}/live-{id(self)}-{to_ms(datetime.now(UTC))}"
        self._query = writer.option("checkpointLocation", folder).start()
        self.state = "running"

    def _told(self, updates: DataFrame) -> DataFrame:
        """Updates with their finality, each by its own timeframe."""
        start, received = F.unix_millis("timestamp"), F.unix_millis("received")
        frames = sorted({d.timeframe for d in self._subscribed})
        chosen = reduce(lambda c, t: c.when(F.col("timeframe") == t, live.finality(start, received, t)), frames[1:], F.when(F.col("timeframe") == frames[0], live.finality(start, received, frames[0])))
        return updates.withColumn("finality", chosen)

    def _take(self, batch: DataFrame, _: int) -> None:
        """Put a micro-batch, at most CAPACITY updates by the source's check, where the consumer takes it."""
        rows = self._told(batch).orderBy("seq").collect()
        waiting = [d for d, wanted in self._subscribed.items() if wanted]
        for d in waiting:
            own = [r for r in rows if self._is(r, d)]
            if own:
                merged = self._bootstrapped(batch, d, own[0])
                at = rows.index(own[0])
                rows = [r for r in rows[:at] if not self._is(r, d)] + merged + [r for r in rows[at:] if not self._is(r, d)]
                self._subscribed[d] = False
        for row in rows:
            try:
                self._ready.put_nowait(row)
            except queue.Full:
                self._overflow = ProviderError(f"the consumer fell {CAPACITY} updates behind")
                while not self._ready.empty():  # stale ones are not handed out any more
                    try:
                        self._ready.get_nowait()
                    except queue.Empty:
                        break
                raise self._overflow from None

    @staticmethod
    def _is(row: Row, d: Dataset) -> bool:
        return all(row[k] == getattr(d, k) for k in KEY)

    def _bootstrapped(self, batch: DataFrame, d: Dataset, first: Row) -> list[Row]:
        """The last closed bars and the buffered updates of a dataset, ascending; a live value wins over a stored one."""
        bar, data = TimeBar.parse(d.timeframe), self.data
        stop = bar.floor(to_ms(first["received"].astimezone(UTC)))
        start = stop
        for _ in range(BOOTSTRAP_BARS):
            start = bar.previous(start)
        request = BarRequest(d, EPOCH + timedelta(milliseconds=start), EPOCH + timedelta(milliseconds=stop))
        bars, _, _ = providers.observe(data.spark, request, data.provider.client, data.provider.page, data.now, unfinished=True)
        snapshot = bars.withColumn("seq", F.lit(-1).cast("long")).withColumn("received", F.lit(first["received"]))
        own = batch.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(getattr(d, k))) for k in KEY]))
        columns = [*KEY, "timestamp", *VALUES, "seq", "received"]
        merged = self._told(live.bootstrap(snapshot.select(*columns), own.select(*columns), KEY)).collect()
        return merged

    def __iter__(self) -> LiveMarketData:
        if self.state == "open":
            self._start()
        elif self.state != "failed":
            raise InvalidRequestError(f"the session is {self.state}; it has one consumer")
        return self

    def __next__(self) -> Row:
        """The next update: dataset, bar, seq, received, finality. ProviderError once the session has failed."""
        while True:
            if self.state in ("new", "open"):
                raise InvalidRequestError(f"the session is {self.state}")
            if self.state == "closed":
                raise StopIteration
            if self._overflow is not None:
                self.state = "failed"
                raise self._overflow
            if self.state == "failed" or (not self._query.isActive and self._ready.empty()):
                self.state = "failed"
                raise ProviderError(f"the live session failed: {self._query.exception()}")
            try:
                return self._ready.get(timeout=POLL_S)
            except queue.Empty:
                continue

    def __aiter__(self) -> LiveMarketData:
        return self.__iter__()

    async def __anext__(self) -> Row:
        try:
            return await asyncio.to_thread(self._next_or_none)
        except _Ended:
            raise StopAsyncIteration from None

    def _next_or_none(self) -> Row:
        try:
            return self.__next__()
        except StopIteration:  # may not cross a thread's future
            raise _Ended from None


class _Ended(Exception):
    pass
