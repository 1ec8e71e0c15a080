"""Holding the catalog against the files, and building it anew from them.

Every file is read deeply by a task; only one row a file comes back. Rebuilding knows available bars alone: what was proved
unavailable, runs and warnings are not in the files and are gone.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.model import BarloomError, CatalogError, Dataset, StorageError
from barloom.operators import coverage, reading
from barloom.schema import BARS, KEY
from barloom.session import settled
from barloom.sources import store
from barloom.sources.catalog import Catalog, files_of_datasets

FOUND = ", ".join(["path string", *[f"{k} string" for k in KEY], "provider string, sha256 string, row_count long, first long, last long, fault string"])


def deep_inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row a file; `fault` says what is wrong with one that contradicts itself. StorageError for files that don't belong."""
    names = [part.split()[0] for part in FOUND.split(", ")]

    def run(batches):
        schema = pa.schema([(n, pa.int64() if n in ("row_count", "first", "last") else pa.string()) for n in names])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = dict.fromkeys(names) | {"path": path}
                try:
                    d, notes, _ = store.read_month(path, root)
                    row |= {k: getattr(d, k) for k in KEY} | {"provider": notes["provider"], "sha256": store.sha256_of(path)}
                    row |= {k: int(notes[k]) for k in ("row_count", "first", "last")}
                except (BarloomError, OSError, ValueError, KeyError, TypeError) as e:  # pa.ArrowInvalid is a ValueError
                    row["fault"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema)

    paths = store.month_files(root) if os.path.isdir(root) else []
    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, FOUND)


def validate(spark: SparkSession, root: str, catalog: str | Path) -> DataFrame:
    """(path, issue) of every difference between catalog and files; creates and changes nothing."""
    if not Path(catalog).exists() and store.classify(root) == "empty":
        return spark.createDataFrame([], "path string, issue string")
    found = settled(deep_inventory(spark, root))
    opened = Catalog(catalog, create=False)
    try:
        indexed = files_of_datasets(opened.snapshot(spark)).withColumn("settle", F.expr("nullif(settle, '')"))
    finally:
        opened.close()
    faults = found.where("fault IS NOT NULL").select("path", F.concat(F.lit("unreadable: "), "fault").alias("issue"))
    compared = reading.compare_files(indexed, found, tuple(KEY), ("provider",)).join(faults.select("path"), "path", "left_anti")
    left = spark.createDataFrame([(p, "leftover of a writer") for p in store.leftovers(root)], "path string, issue string")
    return compared.unionByName(faults).unionByName(left)


def rebuild(spark: SparkSession, root: str, catalog: str | Path) -> int:
    """The catalog as the files tell it; their number. A current catalog is refilled in one transaction, any other replaced.

    StorageError for a file that contradicts itself or doesn't belong, or a dataset of several providers: then nothing changes.
    """
    if left := store.leftovers(root):
        raise StorageError(f"leftovers of writers: {left[:5]}")
    found = settled(deep_inventory(spark, root))
    if bad := found.where("fault IS NOT NULL").select("path", "fault").limit(5).collect():
        raise StorageError("; ".join(f"{r['path']}: {r['fault']}" for r in bad))
    if reading.lineage_conflicts(found, KEY).limit(1).collect():
        raise StorageError("a dataset's files come from several providers")
    files = found.orderBy(*KEY, "first").collect()
    segments: dict[tuple, list] = {}
    for timeframe in sorted({r["timeframe"] for r in files}):
        bars = spark.read.schema(BARS).parquet(*[r["path"] for r in files if r["timeframe"] == timeframe])
        for s in coverage.available_islands(bars, timeframe, KEY).orderBy(*KEY, "start").collect():
            segments.setdefault(tuple(s[k] for k in KEY), []).append((s["start"], s["end"], s["status"]))

    def fill(into: Catalog) -> None:
        with into.transaction():
            into.clear()
            for r in files:
                key = tuple(r[k] for k in KEY)
                i = into.ensure(Dataset(*key))
                into.bind_provider(i, r["provider"])
                into.put_file(r["path"], i, None, r["sha256"], r["row_count"], r["first"], r["last"])
                if key in segments:
                    into.set_coverage(i, segments.pop(key))

    try:
        current = Catalog(catalog, create=False)
    except CatalogError:
        Path(catalog).parent.mkdir(parents=True, exist_ok=True)
        temp = Path(f"{catalog}.{uuid.uuid4().hex}")
        fresh = Catalog(temp)
        fill(fresh)
        fresh.db.execute("pragma journal_mode = delete")
        fresh.close()
        for tail in ("-wal", "-shm"):
            Path(f"{catalog}{tail}").unlink(missing_ok=True)
        os.replace(temp, catalog)
        Catalog(catalog, create=False).close()
    else:
        fill(current)
        current.close()
    return len(files)
