"""The verbs: fetch, sync, scan and scan_partial of a dataset's bars, and maintenance of the store.

The driver plans, holds the locks, publishes and commits; bars are observed, checked and written by Spark jobs. A read proves
its range by coverage or says what is missing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import MarketDataConfig, resolve_config
from barloom.model import BarRequest, CatalogError, CoverageError, Dataset, InvalidRequestError, SyncError, UnsupportedError, default_end, parse_time, to_ms
from barloom.operators import coverage, reading
from barloom.schema import BARS
from barloom.session import require_utc
from barloom.sources import provider as providers
from barloom.sources import recovery, store
from barloom.sources.catalog import Catalog, dataset_lock
from barloom.sources.provider import Provider

Time = datetime | date | str
Interval = tuple[int, int, str]
ONE = ["symbol"]
SEGMENTS = "symbol string, start long, end long, status string"


@dataclass(frozen=True)
class DataWarning:
    code: str
    message: str
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class SyncResult:
    """What a sync did; `fetched_rows` counts bridged bars too, which are not written."""

    dataset: Dataset
    run_id: str
    changed: bool
    fetched_rows: int
    written_partitions: int
    covered: tuple[Interval, ...]
    gaps: tuple[Interval, ...]
    warnings: tuple[DataWarning, ...] = ()

    @property
    def is_complete(self) -> bool:
        return not self.gaps

    def require_complete(self) -> SyncResult:
        if self.gaps:
            raise SyncError(f"{len(self.gaps)} gaps remain in {self.dataset}")
        return self


@dataclass(frozen=True)
class PartialScanResult:
    dataset: Dataset
    data: DataFrame
    covered: tuple[Interval, ...]
    gaps: tuple[Interval, ...]
    warnings: tuple[DataWarning, ...] = ()

    @property
    def is_complete(self) -> bool:
        return not self.gaps


class MarketData:
    """Does no I/O until a verb is called. `provider` is one, or the name of an installed one."""

    def __init__(self, spark: SparkSession, config: MarketDataConfig | None = None, *, provider: Provider | str | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        require_utc(spark)
        self.spark, self.config, self.now = spark, config or resolve_config(), now
        self._provider = provider

    @property
    def provider(self) -> Provider:
        if not isinstance(self._provider, Provider):
            self._provider = providers.installed(self._provider)
        return self._provider

    def bars(self, exchange: str, symbol: str, market: str, settle: str | None = None, timeframe: str = "1h") -> BarDataset:
        return BarDataset(self, Dataset(exchange, symbol, market, settle, timeframe))

    def fetch_markets(self, exchange: str, market: str) -> DataFrame:
        return providers.definitions(self.spark, self.provider, exchange, market)

    def live(self, exchange: str):
        from barloom.streaming.session import LiveMarketData

        return LiveMarketData(self, exchange)

    def validate(self) -> DataFrame:
        """(path, issue): every difference between catalog and files."""
        return recovery.validate(self.spark, self.config.data_dir, self.config.catalog)

    def rebuild_catalog(self) -> int:
        """The catalog anew from the files; their number."""
        with self.gate():
            return recovery.rebuild(self.spark, self.config.data_dir, self.config.catalog)

    @contextmanager
    def gate(self) -> Iterator[None]:
        """One process at a time publishes or changes the catalog."""
        try:
            with dataset_lock(Path(self.config.state_dir, "locks", "catalog")):
                yield
        except SyncError as e:
            if "held by another" in str(e):
                raise CatalogError(str(e)) from e
            raise

    @contextmanager
    def catalog(self, create: bool) -> Iterator[Catalog]:
        if create and not self.config.catalog.exists() and self.stored():
            raise CatalogError(f"{self.config.catalog} is absent though files are stored: rebuild it first")
        opened = Catalog(self.config.catalog, create=create)
        try:
            yield opened
        finally:
            opened.close()

    def stored(self) -> bool:
        root = Path(self.config.data_dir)
        return root.is_dir() and any(p.is_file() for p in root.rglob("*"))


class BarDataset:
    def __init__(self, data: MarketData, dataset: Dataset):
        self.data, self.dataset = data, dataset

    # Requests

    def _request(self, start: Time, end: Time | None, dataset: Dataset, grace_ms: int) -> BarRequest:
        stop = parse_time(end) if end is not None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=default_end(dataset.timeframe, self.data.now(), grace_ms))
        return BarRequest(dataset, parse_time(start), stop)

    def resolved(self) -> Dataset:
        """The dataset with its settlement; an omitted one is inferred from the venue if exactly one fits."""
        d = self.dataset
        if d.market != "perpetual" or d.settle is not None:
            return d
        fitting = self.data.fetch_markets(d.exchange, d.market).where(F.col("symbol") == d.symbol)
        found = reading.inferred_settle(fitting, ONE).collect()
        if len(found) != 1:
            raise UnsupportedError(f"no single settlement fits {d.symbol}; name it")
        return Dataset(d.exchange, d.symbol, d.market, found[0]["settle"], d.timeframe)

    def _offered(self, d: Dataset) -> dict[str, str]:
        """What the venue's definition says of a derivative; UnsupportedError if it lists the market or timeframe not.

        A provider without definitions is taken at its word.
        """
        if self.data.provider.markets is None:
            return {}
        listed = self.data.fetch_markets(d.exchange, d.market).where((F.col("symbol") == d.symbol) & F.col("settle").eqNullSafe(F.lit(d.settle).cast("string"))).collect()
        if len(listed) != 1 or d.timeframe not in listed[0]["timeframes"]:
            raise UnsupportedError(f"{d} is not listed")
        facts = {k: listed[0][k] for k in store.DERIVATIVE} if d.market == "perpetual" else {}
        return {k: str(v).lower() if isinstance(v, bool) else v for k, v in facts.items() if v is not None}

    def _known(self) -> Dataset:
        """As `resolved`, from the catalog."""
        d = self.dataset
        if d.market != "perpetual" or d.settle is not None:
            return d
        settles = []
        if self.data.config.catalog.exists():
            with self.data.catalog(create=False) as c:
                settles = c.settles(d.exchange, d.symbol, d.market, d.timeframe)
        if len(settles) != 1:
            raise InvalidRequestError(f"the catalog knows {settles} for {d.symbol}; name the settlement")
        return Dataset(d.exchange, d.symbol, d.market, settles[0], d.timeframe)

    # Coverage of one dataset

    def _segments(self, rows: list[Interval]) -> DataFrame:
        return self.data.spark.createDataFrame([(self.dataset.symbol, *r) for r in rows], SEGMENTS)

    def _cut(self, stored: list[Interval], start: int, end: int) -> tuple[list[Interval], list[Interval]]:
        """(covered, gaps) of the range, in order."""
        asked = self._segments([(start, end, "missing")])
        rows = coverage.covered_and_gaps(self._segments(stored), asked, ONE).orderBy("start").collect()
        cut = [(r["start"], r["end"], r["status"]) for r in rows]
        return [c for c in cut if c[2] == "available"], [c for c in cut if c[2] != "available"]

    # Verbs

    def fetch(self, start: Time, end: Time | None = None) -> DataFrame:
        """Checked bars from the provider, in order; neither catalog nor files are touched."""
        request = self._request(start, end, self.resolved(), reading.GRACE_MS)
        self._offered(request.dataset)
        p = self.data.provider
        bars, _, _ = providers.observe(self.data.spark, request, p.client, p.page, self.data.now)
        return bars.drop("seq").orderBy("timestamp")

    def scan(self, start: Time, end: Time | None = None) -> DataFrame:
        """Stored bars of a range that coverage proves, in order; CoverageError if any of it is a gap."""
        found = self.scan_partial(start, end)
        if found.gaps:
            raise CoverageError(f"{self.dataset} is not covered: {found.gaps[:5]}")
        return found.data

    def scan_partial(self, start: Time, end: Time | None = None) -> PartialScanResult:
        """Stored bars of the covered parts, with the gaps. Takes no lock and asks no provider."""
        d = self._known()
        request = self._request(start, end, d, 0)
        s, e = to_ms(request.start), to_ms(request.end)
        stored: list[Interval] = []
        if self.data.config.catalog.exists():
            with self.data.catalog(create=False) as c:
                i = c.find(d)
                stored = c.segments(i) if i is not None else []
        elif self.data.stored():
            raise CatalogError(f"{self.data.config.catalog} is absent though files are stored: rebuild it first")
        covered, gaps = self._cut(stored, s, e)
        warnings = tuple(DataWarning(f"coverage.{g[2]}", f"{g[2]} from {g[0]} to {g[1]}", g[0], g[1]) for g in gaps) if covered else ()
        return PartialScanResult(d, self._stored_bars(d, covered, s, e), tuple(covered), tuple(gaps), warnings)

    def _stored_bars(self, d: Dataset, covered: list[Interval], start: int, end: int) -> DataFrame:
        spark = self.data.spark
        if not covered:
            return spark.createDataFrame([], BARS)
        proved = self._segments(covered)
        months = coverage.required_months(proved, d.timeframe, ONE).orderBy("year", "month").collect()
        bars = store.scan_files(spark, self.data.config.data_dir, d, [(m["year"], m["month"]) for m in months])
        near = bars.where((F.col("timestamp") >= F.timestamp_millis(F.lit(start))) & (F.col("timestamp") < F.timestamp_millis(F.lit(end))))  # reaches the row groups
        return reading.restricted(near, proved, ONE).orderBy("timestamp")

    def sync(self, start: Time, end: Time | None = None) -> SyncResult:
        """Fetch what is missing of the range, store it month by month and record what is proved.

        Unavailable ranges are not asked for again, and stored bars are never replaced by bridged ones. Months published before a
        failure stay; the SyncError then asks for a validation.
        """
        d = self.resolved()
        request = self._request(start, end, d, reading.GRACE_MS)
        s, e, data, run = to_ms(request.start), to_ms(request.end), self.data, uuid.uuid4().hex
        key = hashlib.sha256("\0".join([d.exchange, d.symbol, d.market, d.settle or "", d.timeframe]).encode()).hexdigest()
        with dataset_lock(Path(data.config.state_dir, "locks", key)):
            with data.gate(), data.catalog(create=True) as c, c.transaction():
                i = c.ensure(d)
                c.put_run(run, i, s, e, "running")
                stored, lineage = c.segments(i), c.provider_of(i)
            manifest: list = []
            try:
                if lineage not in (None, data.provider.name):
                    raise SyncError(f"{d} comes from {lineage}, not from {data.provider.name}")
                facts = self._offered(d)
                missing = [g for g in self._cut(stored, s, e)[1] if g[2] == "missing"]
                windows = coverage.fetch_windows(self._segments(missing), d.timeframe, ONE).orderBy("start").collect()
                fetched, segments, warnings, kept = self._observe(d, windows, missing, facts.pop("native_id", None))
                if kept is not None:
                    store.clean(data.config.data_dir, d)
                    manifest = store.prepare(kept, data.config.data_dir, data.provider.name, facts)
            except BaseException as failure:
                store.discard(manifest)
                self._fail(d, run, s, e, failure)
                raise
            published = False
            try:
                with data.gate(), data.catalog(create=True) as c:
                    published = bool(manifest)
                    store.publish(manifest)
                    with c.transaction():
                        if c.find(d) != i:
                            raise CatalogError("the catalog was rebuilt meanwhile")
                        whole = coverage.normalize(self._segments(c.segments(i) + segments), ONE).orderBy("start").collect()
                        whole = [(r["start"], r["end"], r["status"]) for r in whole]
                        if manifest or segments:
                            c.bind_provider(i, data.provider.name)
                            c.set_coverage(i, whole)
                        for m in manifest:
                            c.put_file(m["path"], i, run, m["sha256"], m["row_count"], m["first"], m["last"])
                        for w, n in warnings:
                            c.put_event(run, w.code, w.message, n)
                        c.put_run(run, i, s, e, "done")
            except BaseException as failure:
                if not self._committed(run):
                    if published:
                        raise SyncError("files were published but not recorded: validate the store first") from failure
                    store.discard(manifest)
                    self._fail(d, run, s, e, failure)
                    raise
        covered, gaps = self._cut(whole, s, e)
        return SyncResult(d, run, bool(manifest or segments), fetched, len(manifest), tuple(covered), tuple(gaps), tuple(w for w, _ in warnings))

    def _observe(self, d: Dataset, windows: list, missing: list[Interval], native_id: str | None):
        """(rows fetched, segments proved, warnings with counts, bars of the gaps) of all windows, one after the other."""
        spark, p, fetched, segments, warnings, kept = self.data.spark, self.data.provider, 0, [], [], None
        for w in windows:
            request = BarRequest(d, *(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=t) for t in (w["start"], w["end"])))
            bars, final, told = providers.observe(spark, request, p.client, p.page, self.data.now, native_id=native_id)
            fetched += bars.count()
            warnings += [(DataWarning(r["code"], f"{r['row_count']} rows", w["start"], w["end"]), r["row_count"]) for r in told.orderBy("code").collect()]
            gaps = [g for g in missing if w["start"] <= g[0] < w["end"]]
            ranges = [(g[0], min(g[1], final), "missing") for g in gaps if g[0] < final]
            if not ranges:
                continue
            proved = coverage.bar_segments(bars, self._segments(ranges), d.timeframe, ONE).orderBy("start").collect()
            segments += [(r["start"], r["end"], r["status"]) for r in proved]
            if any(r["status"] == "available" for r in proved):
                part = reading.restricted(bars, self._segments(gaps), ONE)
                kept = part if kept is None else kept.unionByName(part)
        return fetched, segments, warnings, kept

    def _fail(self, d: Dataset, run: str, start: int, end: int, failure: BaseException) -> None:
        """Mark the run; if even that fails, the first failure says so and stays the one that is raised."""
        try:
            with self.data.gate(), self.data.catalog(create=False) as c, c.transaction():
                if (i := c.find(d)) is not None:
                    c.put_run(run, i, start, end, "failed")
        except Exception as e:  # noqa: BLE001
            failure.add_note(f"the run could not be marked as failed: {e}")

    def _committed(self, run: str) -> bool:
        try:
            with self.data.catalog(create=False) as c:
                return c.run_status(run) == "done"
        except CatalogError:
            return False
