import asyncio
from datetime import UTC, datetime

import pytest

from barloom import config
from barloom.market_data import MarketData
from barloom.model import InvalidRequestError, ProviderError, UnsupportedError
from barloom.sources import provider
from barloom.streaming import source, venue


def facade(spark, tmp_path, live):
    p = provider.Provider("steady", "1", "barloom.sources.provider:steady_client", live=live and f"barloom.streaming.venue:{live}", page=100)
    return MarketData(spark, config.MarketDataConfig(str(tmp_path / "state"), str(tmp_path / "data")), provider=p, now=venue.clock)


def minute(row):
    return int((row["timestamp"].astimezone(UTC) - datetime(2026, 8, 7, tzinfo=UTC)).total_seconds() // 60)


def test_revisions_pass_and_the_end_is_an_error(spark, tmp_path):
    data = facade(spark, tmp_path, "revising")
    a, b = data.bars("okx", "BTC/USDT", "spot", timeframe="1m"), data.bars("okx", "ETH/USDT", "spot", timeframe="1m")
    got = []
    with data.live("okx") as live:
        live.clock = "barloom.streaming.venue:clock"
        live.subscribe_bar_updates(a, bootstrap=True)
        live.subscribe_bar_updates(b)
        with pytest.raises(InvalidRequestError):
            live.subscribe_bar_updates(a)
        with pytest.raises(InvalidRequestError):
            live.subscribe_bar_updates(data.bars("bybit", "BTC/USDT", "spot", timeframe="1m"))
        with pytest.raises(ProviderError):
            for update in live:
                got.append(update)
        assert live.state == "failed"
    btc = [(minute(r), r["close"], r["finality"]) for r in got if r["symbol"] == "BTC/USDT"]
    assert [x[::2] for x in btc[:3]] == [(-1, "final"), (0, "provisional"), (1, "forming")]
    assert btc[2:] == [(1, 101.0, "forming"), (1, 102.0, "forming"), (2, 103.0, "forming")]
    assert [(minute(r), r["close"]) for r in got if r["symbol"] == "ETH/USDT"] == [(1, 101.0), (1, 102.0), (2, 103.0)]
    assert not data.stored() and not data.config.catalog.exists()
    with pytest.raises(InvalidRequestError):
        live.__enter__()


@pytest.mark.parametrize("client", ["backwards", "foreign", "flooding"])
def test_terminal_failures(spark, tmp_path, client):
    data = facade(spark, tmp_path, client)
    with data.live("okx") as live:
        live.subscribe_bar_updates(data.bars("okx", "BTC/USDT", "spot", timeframe="1m"))
        with pytest.raises(ProviderError):
            for _ in live:
                pass
        with pytest.raises(ProviderError):
            next(live)


def test_states(spark, tmp_path):
    with pytest.raises(UnsupportedError), facade(spark, tmp_path, None).live("okx"):
        pass
    data = facade(spark, tmp_path, "revising")
    with data.live("okx") as live:
        with pytest.raises(InvalidRequestError):
            next(live)
        with pytest.raises(InvalidRequestError):
            iter(live)
        with pytest.raises(InvalidRequestError):
            live.subscribe_bar_updates(facade(spark, tmp_path, "revising").bars("okx", "BTC/USDT", "spot"))
    assert live.state == "closed"

    async def first():
        async with data.live("okx") as session:
            session.subscribe_bar_updates(data.bars("okx", "BTC/USDT", "spot", timeframe="1m"))
            async for update in session:
                return update["close"]

    assert asyncio.run(first()) == 101.0


@pytest.mark.parametrize("raw", [None, {}, {"dataset": "x", "row": [1, 2, 3]}, {"dataset": "x", "row": [1, True, 1, 1, 1, 1]}, {"dataset": "x", "row": ["a", 1, 1, 1, 1, 1]}])
def test_malformed_updates(raw):
    with pytest.raises(ProviderError):
        source.parse_update(raw)
