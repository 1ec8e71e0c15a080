from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom import config
from barloom.market_data import MarketData
from barloom.model import CatalogError, CoverageError, InvalidRequestError, ProviderError, StorageError, SyncError, UnsupportedError, to_ms
from barloom.operators import coverage
from barloom.schema import KEY
from barloom.sources import markets, provider, store

HOUR = 3_600_000
STEADY = provider.Provider("steady", "1", "barloom.sources.provider:steady_client", page=100)
FLAT = provider.Provider("flat", "1", "barloom.sources.provider:flat_client", page=100)


def at(*when):
    return datetime(*when, tzinfo=UTC)


@pytest.fixture
def make(spark, tmp_path):
    def f(p=STEADY, now=at(2024, 3, 1)):
        return MarketData(spark, config.MarketDataConfig(str(tmp_path / "state"), str(tmp_path / "data")), provider=p, now=lambda: now)

    return f


def test_sync_scan_and_rebuild(make):
    data = make()
    bars = data.bars("okx", "BTC/USDT", "spot")
    assert bars.scan_partial("2024-01-30", "2024-02-03").data.count() == 0
    first = bars.sync("2024-01-30", "2024-02-02").require_complete()
    assert (first.changed, first.fetched_rows, first.written_partitions) == (True, 72, 2)
    again = bars.sync("2024-01-30", "2024-02-02")
    assert (again.changed, again.fetched_rows, again.written_partitions) == (False, 0, 0) and again.is_complete
    rows = bars.scan("2024-01-31", "2024-02-02").collect()
    assert [to_ms(r["timestamp"].astimezone(UTC)) for r in rows] == list(range(to_ms(at(2024, 1, 31)), to_ms(at(2024, 2, 2)), HOUR))
    with pytest.raises(CoverageError):
        bars.scan("2024-01-31", "2024-02-03")
    part = bars.scan_partial("2024-02-01", "2024-02-03")
    assert part.data.count() == 24 and [g[2] for g in part.gaps] == ["missing"] and [w.code for w in part.warnings] == ["coverage.missing"]
    assert data.validate().count() == 0
    data.config.catalog.unlink()
    for verb in (bars.scan, bars.sync):
        with pytest.raises(CatalogError):
            verb("2024-01-31", "2024-02-02")
    assert data.rebuild_catalog() == 2 and data.validate().count() == 0
    assert bars.scan("2024-01-31", "2024-02-02").collect() == rows
    assert data.rebuild_catalog() == 2 and bars.scan("2024-01-31", "2024-02-02").count() == 48
    with pytest.raises(SyncError):
        make(FLAT).bars("okx", "BTC/USDT", "spot").sync("2024-02-02", "2024-02-03")
    assert not list(Path(data.config.data_dir).rglob("*.tmp"))


def test_holes_are_proved_once_and_unfinished_bars_stay_missing(make):
    data = make(FLAT, now=at(2024, 1, 2, 12, 0, 4))
    bars = data.bars("okx", "BTC/USDT", "spot")
    done = bars.sync("2024-01-01", "2024-01-03")
    statuses = {g[2] for g in done.gaps}
    assert statuses == {"unavailable", "missing"} and done.gaps[-1][:2] == (to_ms(at(2024, 1, 2, 11)), to_ms(at(2024, 1, 3)))
    assert all(g[0] // HOUR % 7 == 0 for g in done.gaps if g[2] == "unavailable")
    later = make(FLAT, now=at(2024, 1, 5)).bars("okx", "BTC/USDT", "spot").sync("2024-01-01", "2024-01-03")
    assert later.fetched_rows == sum(1 for h in range(to_ms(at(2024, 1, 2, 11)) // HOUR, to_ms(at(2024, 1, 3)) // HOUR) if h % 7)
    assert {g[2] for g in later.gaps} == {"unavailable"}
    assert bars.fetch("2024-01-01", "2024-01-02").count() == sum(1 for h in range(to_ms(at(2024, 1, 1)) // HOUR, to_ms(at(2024, 1, 2)) // HOUR) if h % 7)
    data.rebuild_catalog()  # what was proved unavailable is not in the files
    assert {g[2] for g in bars.scan_partial("2024-01-01", "2024-01-02").gaps} == {"missing"}


def test_tampered_and_foreign_files(make):
    data = make()
    bars = data.bars("okx", "BTC/USDT", "spot")
    bars.sync("2024-01-01", "2024-01-02")
    file = Path(store.month_files(data.config.data_dir)[0])
    whole = file.read_bytes()
    file.write_bytes(b"junk" * 100)
    assert data.validate().first()["issue"].startswith("unreadable")
    with pytest.raises(StorageError):
        data.rebuild_catalog()
    file.unlink()
    assert [r["issue"] for r in data.validate().collect()] == ["missing file"]
    with pytest.raises(StorageError):
        bars.scan("2024-01-01", "2024-01-02")
    file.write_bytes(whole)
    assert data.validate().count() == 0
    (file.parent / ".data-left.tmp").write_bytes(b"")
    with pytest.raises(StorageError):
        data.rebuild_catalog()


def test_a_failed_sync_leaves_nothing(make):
    data = make(provider.Provider("bad", "1", "nowhere:client", page=10))
    with pytest.raises(Exception):  # noqa: B017
        data.bars("okx", "BTC/USDT", "spot").sync("2024-01-01", "2024-01-02")
    assert not data.stored()
    with data.catalog(create=False) as c:
        assert c.db.execute("select status from ingestion_runs").fetchall() == [("failed",)]


NATIVE = [
    {"base": "BTC", "quote": "USDT", "swap": True, "settle": "USDT", "active": True, "precision": {"price": 0.1, "amount": "1e-3"}, "linear": True, "inverse": False, "contractSize": 0.01},
    {"base": "ETH", "quote": "USD", "swap": True, "settle": "ETH", "active": "yes", "precision": {"price": "inf", "amount": True}},
    {"base": "XRP", "quote": "USD", "swap": True, "settle": "USD"},
    {"base": "XRP", "quote": "USD", "swap": True, "settle": "USD"},
    {"base": "SOL", "quote": "USD", "swap": True, "settle": "USD"},
    {"base": "SOL", "quote": "USD", "swap": True, "settle": "USDC"},
    {"base": "BAD", "quote": "USD", "swap": True},
    {"base": "A/B", "quote": "USD", "swap": True, "settle": "USD"},
    {"base": "BTC", "quote": "USDT", "spot": True, "settle": "USDT"},
    "junk",
]


def venue(exchange, market):
    return NATIVE, ["1h", "60", "1d", "1h"]


def test_definitions(spark, make, monkeypatch):
    found = {(r["symbol"], r["settle"]): r for r in markets.translate(spark, NATIVE, "okx", "perpetual", ["1h", "60", "1d"]).collect()}
    assert set(found) == {("BTC/USDT", "USDT"), ("ETH/USD", "ETH"), ("SOL/USD", "USD"), ("SOL/USD", "USDC")}
    btc, eth = found["BTC/USDT", "USDT"], found["ETH/USD", "ETH"]
    assert (str(btc["tick_size"].normalize()), str(btc["size_increment"].normalize()), btc["contract_size"], btc["timeframes"]) == ("0.1", "0.001", "0.01", ["1d", "1h"])
    assert (eth["tick_size"], eth["size_increment"], eth["active"]) == (None, None, None)
    assert [(r["symbol"], r["settle"]) for r in markets.translate(spark, NATIVE, "okx", "spot", []).collect()] == [("BTC/USDT", None)]
    monkeypatch.setattr(provider, "load", lambda name: venue if name == "venue" else None)
    data = make(provider.Provider("v", "1", "x:y", markets="venue"))
    assert data.bars("okx", "BTC/USDT", "perpetual").resolved().settle == "USDT"
    with pytest.raises(UnsupportedError):
        data.bars("okx", "SOL/USD", "perpetual").resolved()
    with pytest.raises(InvalidRequestError):
        data.bars("okx", "BTC/USDT", "perpetual").scan("2024-01-01", "2024-01-02")
    with pytest.raises(ProviderError):
        provider.Provider("v", "1", "x:y", spi=2)


def test_null_settle_is_a_key(spark):
    key = "exchange string, symbol string, market string, settle string, timeframe string, start long, end long, status string"
    one = ("okx", "A/B", "spot", None, "1h")
    stored = spark.createDataFrame([(*one, 0, 2 * HOUR, "available")], key)
    asked = spark.createDataFrame([(*one, 0, 3 * HOUR, "missing")], key)
    cut = coverage.covered_and_gaps(stored, asked, KEY).orderBy("start").collect()
    assert [(r["start"], r["end"], r["status"]) for r in cut] == [(0, 2 * HOUR, "available"), (2 * HOUR, 3 * HOUR, "missing")]
    bars = stored.select(*KEY, F.timestamp_millis("start").alias("timestamp"))
    found = coverage.bar_segments(bars, asked, "1h", KEY).orderBy("start").collect()
    assert [(r["start"], r["status"]) for r in found] == [(0, "available"), (HOUR, "unavailable")]


def test_config(tmp_path, monkeypatch):
    file = tmp_path / "c.toml"
    file.write_text('data_dir = "d"\n')
    monkeypatch.setenv(config.VARIABLE, str(file))
    assert config.resolve_config(state_dir="s") == config.MarketDataConfig("s", "d")
    file.write_text("data_dir = 3\n")
    with pytest.raises(InvalidRequestError):
        config.resolve_config()
    file.write_text('other = "x"\n')
    with pytest.raises(InvalidRequestError):
        config.resolve_config()


def test_derivatives_and_links(spark, make, monkeypatch, tmp_path):
    def listed(contract):
        return lambda exchange, market: ([NATIVE[0] | {"contractSize": contract}], ["1h"])

    load, size = provider.load, [0.01]
    monkeypatch.setattr(provider, "load", lambda name: listed(size[0]) if name == "venue" else load(name))
    data = make(provider.Provider("steady", "1", "barloom.sources.provider:steady_client", markets="venue", page=100))
    bars = data.bars("okx", "BTC/USDT", "perpetual")
    bars.sync("2024-01-01", "2024-01-02").require_complete()
    file = store.month_files(data.config.data_dir)[0]
    d, notes, _ = store.read_month(file, data.config.data_dir)
    assert d.settle == "USDT" and {k: notes[k] for k in store.DERIVATIVE} == {"linear": "true", "inverse": "false", "contract_size": "0.01"}
    assert bars.scan("2024-01-01", "2024-01-02").count() == 24
    size[0] = 0.02
    with pytest.raises(Exception, match="would change"):
        bars.sync("2024-01-02", "2024-01-03")
    size[0] = 0.01
    assert bars.sync("2024-01-02", "2024-01-03").is_complete and data.rebuild_catalog() == 1 and data.validate().count() == 0
    with pytest.raises(UnsupportedError):
        data.bars("okx", "BTC/USDT", "perpetual", timeframe="4h").sync("2024-01-01", "2024-01-02")
    (tmp_path / "data" / "link").symlink_to(tmp_path)
    for wrong in (tmp_path / "data" / "link" / "x", tmp_path / "elsewhere", tmp_path / "data" / ".." / "x"):
        with pytest.raises(StorageError):
            store.managed(wrong, str(tmp_path / "data"))


def test_a_lost_catalog_with_leftovers_is_refused(make):
    data = make()
    Path(data.config.state_dir).mkdir(parents=True)
    Path(f"{data.config.catalog}-wal").write_bytes(b"x")
    with pytest.raises(CatalogError):
        data.bars("okx", "BTC/USDT", "spot").sync("2024-01-01", "2024-01-02")
