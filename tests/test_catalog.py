import sqlite3

import pytest

from barloom.model import CatalogError, Dataset, SyncError
from barloom.sources import catalog

D = Dataset("okx", "BTC/USDT", "perpetual", "USDT", "1h")


def test_catalog_keeps_identities(spark, tmp_path):
    c = catalog.Catalog(tmp_path / "state" / "catalog.db")
    with c.transaction():
        i = c.ensure(D)
        assert c.ensure(D) == i and c.ensure(Dataset("okx", "BTC/USDT", "spot", None, "1h")) != i
        c.bind_provider(i, "a")
        c.put_run("r1", i, 0, 10, "running")
        c.put_run("r1", i, 0, 10, "done")
        c.put_file("p", i, "r1", "h", 3, 0, 2)
        c.set_coverage(i, [(0, 5, "available"), (5, 9, "missing"), (9, 10, "unavailable")])
        c.put_event("r1", "coverage.timeframe_gap", "", 4)
        c.put_event("gone", "coverage.timeframe_gap", "", 1)
    for wrong in (lambda: c.bind_provider(i, "b"), lambda: c.put_run("r1", i, 0, 11, "done"), lambda: c.put_file("p", i + 1, None, "h", 3, 0, 2)):
        with pytest.raises(CatalogError), c.transaction():
            wrong()
    t = c.snapshot(spark)
    assert sorted(r["status"] for r in t["coverage"].collect()) == ["available", "unavailable"]
    assert [(r["path"], r["settle"]) for r in catalog.files_of_datasets(t).collect()] == [("p", "USDT")]
    assert [r["status"] for r in catalog.runs_of_datasets(t).collect()] == ["done"]
    assert sorted((r["run_id"], r["status"]) for r in catalog.events_of_runs(t).collect()) == [("gone", None), ("r1", "done")]
    with c.transaction():
        c.remove_dataset(i)
    assert c.db.execute("select count(*) from coverage").fetchone() == (0,)
    assert t["files"].count() == 1  # a snapshot doesn't move
    c.close()


def test_foreign_catalogs_are_refused(tmp_path):
    with pytest.raises(CatalogError):
        catalog.Catalog(tmp_path / "none.db", create=False)
    old = tmp_path / "old.db"
    catalog.Catalog(old).close()
    with sqlite3.connect(old) as db:
        db.execute("update schema_info set version = 3")
    with pytest.raises(CatalogError):
        catalog.Catalog(old)
    (tmp_path / "junk.db").write_bytes(b"no database at all" * 100)
    with pytest.raises(CatalogError):
        catalog.Catalog(tmp_path / "junk.db")


def test_one_writer_at_a_time(tmp_path):
    with catalog.dataset_lock(tmp_path / "locks" / "d"):
        with pytest.raises(SyncError), catalog.dataset_lock(tmp_path / "locks" / "d", timeout=0.1):
            pass
    with catalog.dataset_lock(tmp_path / "locks" / "d", timeout=0.1):
        pass
