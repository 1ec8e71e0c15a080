from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.model import BarRequest, Dataset, ProviderError, StorageError, to_ms
from barloom.operators import coverage, reading
from barloom.sources import provider, store

D = Dataset("okx", "BTC/USDT", "spot", None, "1h")


def at(*when):
    return datetime(*when, tzinfo=UTC)


def test_windows_tile_the_request():
    start, end = to_ms(at(2024, 1, 1)), to_ms(at(2024, 1, 9, 9))
    windows = provider.page_windows("1h", start, end, 100)
    assert len(windows) == 3 and windows[0].start == start and windows[-1].end == end
    assert all(a.end == b.start for a, b in zip(windows, windows[1:], strict=False))


@pytest.mark.parametrize("rows", [[[1]], [["x", 1, 1, 1, 1, 1]], [[5, 1, 1, 1, 1, 1], [5, 1, 1, 1, 1, 1]], [[99, 1, 1, 1, 1, 1]], ["row"]])
def test_bad_pages(rows):
    with pytest.raises(ProviderError):
        provider.check_rows(rows, provider.Window(0, 10))
    assert provider.check_rows([["5", 1, 2, 3, 4, "5"]], provider.Window(0, 10)) == [(5, 1.0, 2.0, 3.0, 4.0, 5.0)]


def test_retries_only_transient_failures():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise provider.TransientError("busy")

    with pytest.raises(ProviderError):
        provider.with_retries(call, waits.append)
    assert len(calls) == 6 and waits == [0.5, 1, 2, 4, 8]


def test_observe_store_and_read_back(spark, tmp_path):
    request = BarRequest(D, at(2024, 1, 30), at(2024, 2, 3))
    bars, final, warnings = provider.observe(spark, request, "barloom.sources.provider:flat_client", now=lambda: at(2024, 2, 2, 12, 0, 4))
    assert final == to_ms(at(2024, 2, 2, 11)) and {r["code"] for r in warnings.collect()} == {"coverage.timeframe_gap"}
    n = bars.count()
    assert bars.agg(F.max(F.unix_millis("timestamp"))).first()[0] < final
    root = str(tmp_path / "store")
    manifest = store.prepare(bars, root, "flat")
    assert store_files(root) == [] and len(manifest) == 2
    store.publish(manifest)
    files = store.month_files(root)
    assert len(files) == 2 and files[0].endswith("okx/spot/BTC-USDT/1h/year=2024/month=01/data.parquet")
    months = [(r["year"], r["month"]) for r in coverage.required_months(coverage.available_islands(bars, "1h", ["symbol"]), "1h", ["symbol"]).collect()]
    read = store.scan_files(spark, root, D, sorted(months))
    assert read.count() == n and read.exceptAll(bars.drop("seq")).count() == 0
    revised = bars.where(F.col("timestamp") == at(2024, 2, 1, 1)).withColumn("close", F.col("close") + 0.5)
    store.publish(store.prepare(revised, root, "flat"))
    assert store.scan_files(spark, root, D, [(2024, 2)]).where(F.col("close") != F.floor("close")).count() == revised.count()
    found = store.inventory(spark, root)
    assert reading.compare_files(found, found).count() == 0 and found.agg(F.sum("row_count")).first()[0] == n
    store.discard(store.prepare(revised, root, "flat"))
    assert len(store.month_files(root)) == 2
    with pytest.raises(StorageError):
        store.scan_files(spark, root, D, [(2024, 3)])
    moved = Path(files[0]).parent.parent / "month=05"
    moved.mkdir()
    (moved / "data.parquet").write_bytes(Path(files[0]).read_bytes())
    with pytest.raises(StorageError):
        store.read_month(moved / "data.parquet", root)


def store_files(root):
    return [p for p in Path(root).rglob("data.parquet")]
