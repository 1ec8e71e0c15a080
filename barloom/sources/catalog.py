"""The operational catalog: datasets, coverage, files, runs and quality events in SQLite, on the driver only.

It is small and transactional; Spark sees it as DataFrames of a read-only snapshot. Each change is one transaction, and a
dataset's writers hold a file lock.
"""

from __future__ import annotations

import fcntl
import sqlite3
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from barloom.model import CatalogError, Dataset, SyncError

VERSION = 4
TABLES = {
    "datasets": "id integer primary key, exchange text not null, symbol text not null, market text not null, settle text not null, timeframe text not null, provider text, unique (exchange, symbol, market, settle, timeframe)",
    "coverage": "dataset_id integer not null references datasets on delete cascade, start integer not null, end integer not null, status text not null check (status in ('available', 'unavailable'))",
    "ingestion_runs": "id text primary key, dataset_id integer not null references datasets on delete cascade, start integer not null, end integer not null, status text not null",
    "files": "path text primary key, dataset_id integer not null references datasets on delete cascade, run_id text references ingestion_runs, sha256 text not null, row_count integer not null, first integer not null, last integer not null",
    "quality_events": "run_id text, code text not null, message text, row_count integer not null",
}
#: What each table's snapshot looks like in Spark.
SNAPSHOT = {
    "datasets": "id long, exchange string, symbol string, market string, settle string, timeframe string, provider string",
    "coverage": "dataset_id long, start long, end long, status string",
    "ingestion_runs": "id string, dataset_id long, start long, end long, status string",
    "files": "path string, dataset_id long, run_id string, sha256 string, row_count long, first long, last long",
    "quality_events": "run_id string, code string, message string, row_count long",
}
LOCK_TIMEOUT_S, POLL_S = 30.0, 0.05


class Catalog:
    def __init__(self, path: str | Path, create: bool = True, read_only: bool = False):
        self.path = Path(path)
        create = create and not read_only
        fresh = not self.path.exists()
        if fresh and not create:
            raise CatalogError(f"{path} is absent")
        if fresh and not read_only and (left := [t for t in ("-wal", "-shm", "-journal") if Path(f"{path}{t}").exists()]):
            raise CatalogError(f"{path} is absent but left {left}")
        if not read_only:
            self.path.parent.mkdir(parents=True, exist_ok=True)
        self.db = sqlite3.connect(f"{self.path.absolute().as_uri()}?mode={'ro' if read_only else 'rwc'}", isolation_level=None, uri=True)
        self.db.execute("pragma foreign_keys = on")
        if read_only:
            self.db.execute("pragma query_only = on")
        self.db.execute("pragma busy_timeout = 5000")
        try:
            if fresh:
                self.db.execute("pragma journal_mode = wal")
                with self.transaction():
                    for name, columns in TABLES.items():
                        self.db.execute(f"create table {name} ({columns})")
                    self.db.execute("create table schema_info (version integer not null)")
                    self.db.execute("insert into schema_info values (?)", (VERSION,))
            found = self.db.execute("select version from schema_info").fetchall()
        except sqlite3.DatabaseError as e:
            self.db.close()
            raise CatalogError(f"{path}: {e}") from e
        if found != [(VERSION,)]:
            self.db.close()
            raise CatalogError(f"{path} has version {found}; this is {VERSION}")

    @contextmanager
    def transaction(self) -> Iterator[None]:
        self.db.execute("begin immediate")
        try:
            yield
        except BaseException:
            self.db.execute("rollback")
            raise
        self.db.execute("commit")

    def ensure(self, d: Dataset) -> int:
        key = (d.exchange, d.symbol, d.market, d.settle or "", d.timeframe)
        self.db.execute("insert or ignore into datasets (exchange, symbol, market, settle, timeframe) values (?, ?, ?, ?, ?)", key)
        return self.db.execute("select id from datasets where (exchange, symbol, market, settle, timeframe) = (?, ?, ?, ?, ?)", key).fetchone()[0]

    def find(self, d: Dataset) -> int | None:
        key = (d.exchange, d.symbol, d.market, d.settle or "", d.timeframe)
        row = self.db.execute("select id from datasets where (exchange, symbol, market, settle, timeframe) = (?, ?, ?, ?, ?)", key).fetchone()
        return row and row[0]

    def settles(self, exchange: str, symbol: str, market: str, timeframe: str) -> list[str]:
        """Settlements under which the catalog knows a market."""
        rows = self.db.execute("select distinct settle from datasets where (exchange, symbol, market, timeframe) = (?, ?, ?, ?) and settle <> '' order by settle", (exchange, symbol, market, timeframe))
        return [r[0] for r in rows]

    def segments(self, dataset_id: int) -> list[tuple[int, int, str]]:
        return self.db.execute("select start, end, status from coverage where dataset_id = ? order by start", (dataset_id,)).fetchall()

    def provider_of(self, dataset_id: int) -> str | None:
        row = self.db.execute("select provider from datasets where id = ?", (dataset_id,)).fetchone()
        return row and row[0]

    def run_status(self, run_id: str) -> str | None:
        """What a reader sees of a run: the proof whether an uncertain commit took place."""
        row = self.db.execute("select status from ingestion_runs where id = ?", (run_id,)).fetchone()
        return row and row[0]

    def clear(self) -> None:
        """Every dataset with all that hangs on it."""
        for name in ("quality_events", "files", "coverage", "ingestion_runs", "datasets"):
            self.db.execute(f"delete from {name}")

    def bind_provider(self, dataset_id: int, provider: str) -> None:
        """Lineage is bound once."""
        now = self.db.execute("select provider from datasets where id = ?", (dataset_id,)).fetchone()
        if now is None or now[0] not in (None, provider):
            raise CatalogError(f"dataset {dataset_id} belongs to {now and now[0]}")
        self.db.execute("update datasets set provider = ? where id = ?", (provider, dataset_id))

    def set_coverage(self, dataset_id: int, segments: list[tuple[int, int, str]]) -> None:
        """Replace a dataset's segments by those the coverage algebra gave; missing ranges are not stored."""
        self.db.execute("delete from coverage where dataset_id = ?", (dataset_id,))
        self.db.executemany("insert into coverage values (?, ?, ?, ?)", [(dataset_id, *s) for s in segments if s[2] != "missing"])

    def put_run(self, run_id: str, dataset_id: int, start: int, end: int, status: str) -> None:
        """A run's identity never changes, only its status."""
        old = self.db.execute("select dataset_id, start, end from ingestion_runs where id = ?", (run_id,)).fetchone()
        if old is not None and old != (dataset_id, start, end):
            raise CatalogError(f"run {run_id} is another one")
        self.db.execute("insert into ingestion_runs values (?, ?, ?, ?, ?) on conflict (id) do update set status = excluded.status", (run_id, dataset_id, start, end, status))

    def put_file(self, path: str, dataset_id: int, run_id: str | None, sha256: str, rows: int, first: int, last: int) -> None:
        """A file never changes its dataset."""
        old = self.db.execute("select dataset_id from files where path = ?", (path,)).fetchone()
        if old is not None and old[0] != dataset_id:
            raise CatalogError(f"{path} belongs to dataset {old[0]}")
        self.db.execute("insert or replace into files values (?, ?, ?, ?, ?, ?, ?)", (path, dataset_id, run_id, sha256, rows, first, last))

    def put_event(self, run_id: str, code: str, message: str, row_count: int) -> None:
        self.db.execute("insert into quality_events values (?, ?, ?, ?)", (run_id, code, message, row_count))

    def remove_file(self, path: str) -> bool:
        """Whether the file was listed; its dataset and coverage stay."""
        return self.db.execute("delete from files where path = ?", (path,)).rowcount > 0

    def datasets(self) -> list[tuple]:
        """(id, exchange, symbol, market, settle, timeframe, provider), in the order of the identity."""
        rows = self.db.execute("select id, exchange, symbol, market, nullif(settle, ''), timeframe, provider from datasets order by exchange, symbol, market, settle, timeframe")
        return rows.fetchall()

    def files(self, dataset_id: int | None = None) -> Iterator[tuple]:
        """(path, dataset id, run, sha256, rows, first, last) one after the other, in the order of the path."""
        yield from self.db.execute("select path, dataset_id, run_id, sha256, row_count, first, last from files where ? is null or dataset_id = ? order by path", (dataset_id, dataset_id))

    def runs(self, dataset_id: int) -> list[tuple]:
        """(id, start, end, status) in the order of the range, then of the id."""
        return self.db.execute("select id, start, end, status from ingestion_runs where dataset_id = ? order by start, end, id", (dataset_id,)).fetchall()

    def events(self, run_id: str) -> list[tuple]:
        """(code, message, rows) of a run, by code."""
        return self.db.execute("select code, message, row_count from quality_events where run_id = ? order by code, message", (run_id,)).fetchall()

    def checkpoint(self) -> None:
        """Bring the write-ahead log into the database; CatalogError if a reader keeps it from that."""
        if self.db.execute("pragma wal_checkpoint(truncate)").fetchone()[0]:
            raise CatalogError(f"{self.path} is being read")

    def remove_dataset(self, dataset_id: int) -> None:
        """Its coverage, files and runs go with it."""
        self.db.execute("delete from files where dataset_id = ?", (dataset_id,))
        self.db.execute("delete from datasets where id = ?", (dataset_id,))

    def snapshot(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All tables as they stand at one moment."""
        with sqlite3.connect(":memory:") as copy:
            self.db.backup(copy)
            return {name: spark.createDataFrame(copy.execute(f"select * from {name}").fetchall(), schema) for name, schema in SNAPSHOT.items()}

    def close(self) -> None:
        self.db.close()


def files_of_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """Files with their dataset's identity."""
    return tables["files"].join(tables["datasets"].withColumnRenamed("id", "dataset_id"), "dataset_id")


def runs_of_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["ingestion_runs"].withColumnRenamed("id", "run_id").join(tables["datasets"].withColumnRenamed("id", "dataset_id"), "dataset_id")


def events_of_runs(tables: dict[str, DataFrame]) -> DataFrame:
    """All events, those whose run is gone too."""
    return tables["quality_events"].join(tables["ingestion_runs"].withColumnRenamed("id", "run_id"), "run_id", "left")


@contextmanager
def dataset_lock(path: str | Path, timeout: float = LOCK_TIMEOUT_S) -> Iterator[None]:
    """One writer of a dataset at a time, over all processes of this machine; SyncError after the timeout."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    until = time.monotonic() + timeout
    with open(path, "a") as f:
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= until:
                    raise SyncError(f"{path} is held by another writer") from None
                time.sleep(POLL_S)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)
