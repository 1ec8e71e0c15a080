"""Evidence, identity and errors of observations; deep checks of the store; the catalog's verbs; the live adapter."""

import threading
from datetime import UTC, datetime

import pyarrow as pa
import pytest

from barloom import config
from barloom.functions.timebar import TimeBar
from barloom.market_data import MarketData
from barloom.model import BarRequest, CatalogError, Dataset, ProviderError, StorageError, SyncError, UnsupportedError, to_ms
from barloom.operators import coverage
from barloom.sources import markets, provider, recovery, store
from barloom.sources.catalog import Catalog
from barloom.streaming import adapter, venue

DAY = 86_400_000


def day(n):
    return datetime(2024, 1, n, tzinfo=UTC)


def request(market="spot", settle=None):
    return BarRequest(Dataset("okx", "BTC/USDT", market, settle, "1h"), day(1), day(2))


def failing(symbol, timeframe, since, until):
    raise RuntimeError("the venue is on fire")


def mistaken(symbol, timeframe, since, until, market):
    return provider.Page([], provider.Market(market.exchange, "ETH/USDT", market.market, market.settle))


def unordered(symbol, timeframe, since, until):
    return [[since + 3_600_000, 1, 1, 1, 1, 1], [since, 1, 1, 1, 1, 1]]


def test_a_client_is_told_the_whole_market(spark):
    got = {}
    for market, settle in (("spot", None), ("perpetual", "USDT")):
        bars, _, _ = provider.observe(spark, request(market, settle), "barloom.sources.provider:market_client", page=7)
        got[market] = bars.orderBy("timestamp").collect()
    assert len(got["spot"]) == 24 and all(p["open"] == s["open"] + 14 for p, s in zip(got["perpetual"], got["spot"], strict=True))


@pytest.mark.parametrize("client, says", [("failing", "on fire"), ("mistaken", "asked for"), ("unordered", "ascending")])
def test_errors_of_tasks_are_the_librarys(spark, client, says):
    with pytest.raises(ProviderError, match=says):
        provider.observe(spark, request(), f"tests.test_integrity:{client}", page=24)


def test_a_clock_that_goes_back_is_an_error(spark):
    times = iter([day(9), day(8)])
    with pytest.raises(ProviderError, match="clock"):
        provider.observe(spark, request(), "barloom.sources.provider:steady_client", page=24, now=lambda: next(times))


def test_pages_are_cut_without_stepping():
    for text, page in (("1s", 1000), ("4h", 7), ("1w", 3), ("1M", 5)):
        bar, at, plain = TimeBar.parse(text), 0, []
        start = bar.floor(to_ms(day(1)))
        stop = bar.later(start, 4 * page - 1)
        at = start
        while at < stop:
            begin = at
            for _ in range(page):
                at = bar.next(at) if at < stop else at
            plain.append((begin, at))
        assert [(w.start, w.end) for w in provider.page_windows(text, start, stop, page)] == plain


def test_fetch_windows_are_a_greedy_fold(spark):
    import random

    rng = random.Random(3)
    for text, step in (("1h", 3_600_000), ("1M", 31 * DAY)):
        bar, gaps, at = TimeBar.parse(text), [], TimeBar.parse(text).floor(to_ms(day(1)))
        for _ in range(200):
            at = bar.later(at, rng.randint(1, 9))
            end = bar.later(at, rng.randint(1, 5))
            gaps.append(("a", None, at, end))
            at = end
        want = []
        for _, _, s, e in gaps:
            bars, t = 0, want[-1][0] if want else s
            while t < e and bars <= 12:
                t, bars = bar.next(t), bars + 1
            if want and bars <= 12:
                want[-1][1:] = [e, want[-1][2] + 1]
            else:
                want.append([s, e, 1])
        frame = spark.createDataFrame(rng.sample(gaps, len(gaps)), "symbol string, settle string, start long, end long")
        rows = coverage.fetch_windows(frame, text, ["symbol", "settle"], 12).orderBy("start").collect()
        assert [[r["start"], r["end"], r["members"]] for r in rows] == want and len(want) > 20 and rows[0]["settle"] is None
    many = spark.range(60_000).selectExpr("'a' AS symbol", "id * 72000000 AS start", "id * 72000000 + 3600000 AS end")
    assert coverage.fetch_windows(many, "1h", ["symbol"], 10).count() == 60_000


@pytest.fixture
def synced(spark, tmp_path):
    p = provider.Provider("steady", "1", "barloom.sources.provider:steady_client", page=100)
    data = MarketData(spark, config.MarketDataConfig(str(tmp_path / "state"), str(tmp_path / "data")), provider=p, now=lambda: day(20))
    assert recovery.validate(spark, data.config.data_dir, data.config.catalog).count() == 0  # nothing stored, nothing known
    data.bars("okx", "BTC/USDT", "spot").sync("2024-01-01", "2024-01-03").require_complete()
    return data


@pytest.mark.parametrize("column, value, says", [("high", 1.0, "high"), ("volume", float("inf"), "finite"), ("volume", -1.0, "volume"), ("timestamp", to_ms(day(1)) + 1, "boundary"), ("timestamp", to_ms(datetime(2023, 12, 31, tzinfo=UTC)), "outside")])
def test_stored_rows_are_read_deeply(synced, column, value, says):
    (path,) = store.month_files(synced.config.data_dir)
    d, notes, table = store.read_month(path, synced.config.data_dir)
    at = table.schema.get_field_index(column)
    kind = table.schema.field(at).type
    first = pa.array([value], pa.int64()).cast(kind) if column == "timestamp" else pa.array([value], kind)
    bad = table.set_column(at, table.schema.field(at), pa.concat_arrays([first, *table[column].slice(1).chunks]))
    notes = notes | ({"first": str(value)} if column == "timestamp" else {})
    pa.parquet.write_table(bad.replace_schema_metadata(notes), path)
    with pytest.raises(StorageError, match=says):
        store.read_month(path, synced.config.data_dir)
    assert says in synced.validate().where("issue LIKE 'unreadable%'").first()["issue"]


def test_leftovers_are_told_and_go_with_the_next_write(synced):
    (path,) = store.month_files(synced.config.data_dir)
    left = store.Path(path).parent / ".data-dead.tmp"
    left.write_bytes(b"x")
    assert store.classify(synced.config.data_dir) == "ambiguous"
    assert [r["issue"] for r in synced.validate().collect()] == ["leftover of a writer"]
    synced.bars("okx", "BTC/USDT", "spot").sync("2024-01-01", "2024-01-05").require_complete()
    assert not left.exists() and store.classify(synced.config.data_dir) == "canonical" and synced.validate().count() == 0


def test_catalog_verbs(synced):
    with pytest.raises(CatalogError):
        Catalog(synced.config.catalog.parent / "none.db", read_only=True)
    reader = Catalog(synced.config.catalog, read_only=True)
    ((i, *identity, lineage),) = reader.datasets()
    assert identity == ["okx", "BTC/USDT", "spot", None, "1h"] and lineage == "steady"
    (file,) = reader.files()
    assert [f[0] for f in reader.files(i)] == [file[0]] and list(reader.files(i + 1)) == [] and len(reader.runs(i)) == 1 and reader.events(reader.runs(i)[0][0]) == []
    with pytest.raises(Exception, match="readonly|query_only|read"):
        reader.remove_file(file[0])
    reader.close()
    writer = Catalog(synced.config.catalog, create=False)
    assert writer.remove_file(file[0]) and not writer.remove_file(file[0]) and writer.segments(i)
    writer.checkpoint()
    writer.close()
    assert [r["issue"] for r in synced.validate().collect()] == ["unindexed file"] or synced.validate().count() == 1


def test_client_families():
    assert [markets.client_of(e, m) for e, m in (("binance", "perpetual"), ("binance", "spot"), ("kraken", "perpetual"), ("kucoin", "perpetual"), ("okx", "perpetual"))] == ["binanceusdm", "binance", "krakenfutures", "kucoinfutures", "okx"]


class Native(venue.Watching):
    rows: list = []

    def watch_ohlcv(self, symbol, timeframe):
        if self.rows:
            rows, self.rows = self.rows, []
            return rows
        self.closed.wait()
        return []


def pulled(live, n):
    found = []
    while len(found) < n:
        found += live.pull()
    return found


def test_live_adapter_merges_its_clients():
    opened = {}
    live = adapter.LiveAdapter("binance", lambda known: opened.setdefault(known, venue.Watching(known)))
    live.subscribe("a", ("binance", "BTC/USDT", "spot", None, "1m"))
    live.subscribe("b", ("binance", "ETH/USDT", "spot", None, "1m"))
    live.subscribe("c", ("binance", "BTC/USDT", "perpetual", "USDT", "1m"))
    assert set(opened) == {"binance", "binanceusdm"}
    got = pulled(live, 9)
    for name, known in (("a", "binance"), ("b", "binance"), ("c", "binanceusdm")):
        assert [u["row"][4] for u in got if u["dataset"] == name] == [101.0 + k + len(known) for k in range(3)]
    for bad in (("binance", "BTC/USDT", "spot", None, "1m"), ("okx", "BTC/USDT", "spot", None, "1m")):
        with pytest.raises(ProviderError):
            live.subscribe("d", bad)
    live.close()
    assert all(c.closed.is_set() for c in opened.values())
    with pytest.raises(ProviderError):
        live.subscribe("e", ("binance", "X/USDT", "spot", None, "1m"))


@pytest.mark.parametrize("rows", ["none", [[1, 2]], [[1, 2, 3, 4, 5, 6]] * 9])
def test_live_adapter_fails_for_good(rows):
    client = Native("okx")
    client.rows = rows
    live = adapter.LiveAdapter("okx", lambda known: client, capacity=8)
    live.subscribe("a", ("okx", "BTC/USDT", "spot", None, "1m"))
    for _ in range(2):
        with pytest.raises(ProviderError):
            for _ in range(50):
                assert live.pull() == []
    with pytest.raises(ProviderError):
        live.subscribe("b", ("okx", "ETH/USDT", "spot", None, "1m"))


def test_live_adapter_refuses_clients():
    deaf, broken = venue.Watching("x"), venue.Watching("x")
    deaf.has, broken.load_markets = {}, lambda: 1 / 0
    for client, kind in ((deaf, UnsupportedError), (broken, ProviderError)):
        with pytest.raises(kind):
            adapter.LiveAdapter("okx", lambda known, c=client: c).subscribe("a", ("okx", "BTC/USDT", "spot", None, "1m"))
        assert client.closed.is_set()
    closing = venue.Watching("x")
    closing.close = lambda: 1 / 0
    live = adapter.LiveAdapter("okx", lambda known: closing)
    live.subscribe("a", ("okx", "BTC/USDT", "spot", None, "1m"))
    with pytest.raises(ProviderError, match="close"):
        live.close()


def live_facade(spark, tmp_path, client):
    p = provider.Provider("steady", "1", "barloom.sources.provider:steady_client", live=f"barloom.streaming.venue:{client}", page=100)
    return MarketData(spark, config.MarketDataConfig(str(tmp_path / "state"), str(tmp_path / "data")), provider=p, now=venue.clock)


def test_a_session_over_the_adapter(spark, tmp_path):
    data = live_facade(spark, tmp_path, "watched")
    with data.live("okx") as live:
        live.clock = "barloom.streaming.venue:clock"
        for symbol in ("BTC/USDT", "ETH/USDT"):
            live.subscribe_bar_updates(data.bars("okx", symbol, "spot", timeframe="1m"))
        it = iter(live)
        got = [next(it) for _ in range(6)]
    assert {s: [r["close"] for r in got if r["symbol"] == s] for s in ("BTC/USDT", "ETH/USDT")} == {s: [105.0 - 1, 105.0, 106.0] for s in ("BTC/USDT", "ETH/USDT")}


def test_an_unread_failure_is_raised_at_the_end(spark, tmp_path):
    data = live_facade(spark, tmp_path, "flooding")
    with pytest.raises(ProviderError, match="failed"), data.live("okx") as live:
        live.subscribe_bar_updates(data.bars("okx", "BTC/USDT", "spot", timeframe="1m"))
        iter(live)
        live._query.exception() or threading.Event().wait(0.1)
        while live._query.isActive:
            threading.Event().wait(0.1)


def test_overflow_drops_what_waits(spark, tmp_path):
    import queue

    data = live_facade(spark, tmp_path, "revising")
    live = data.live("okx")
    live.state, live._ready = "running", queue.Queue(1)
    rows = spark.createDataFrame([("okx", "B/U", "spot", None, "1m", day(1), 1.0, 1.0, 1.0, 1.0, 1.0, k, day(1)) for k in range(3)], venue_schema())
    live._subscribed = {Dataset("okx", "B/U", "spot", None, "1m"): False}
    with pytest.raises(ProviderError, match="behind"):
        live._take(rows, 0)
    with pytest.raises(ProviderError, match="behind"):
        next(live)
    assert live.state == "failed" and live._ready.empty()


def venue_schema():
    from barloom.streaming.source import LIVE

    return LIVE


def test_a_lock_times_out(tmp_path):
    from barloom.sources.catalog import dataset_lock

    with dataset_lock(tmp_path / "l"), pytest.raises(SyncError), dataset_lock(tmp_path / "l", 0.1):
        pass
