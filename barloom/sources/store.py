"""Month files of bars: layout, footer, two-phase writes, deep reads.

One file holds one dataset's month, written by pyarrow inside a grouped task, since Spark's own writer offers neither the
footer nor the name. Tasks only prepare temporary files and tell what they hold; the driver publishes them by atomic
replacement. Files live on a file system that driver and tasks share.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.timebar import TimeBar, month_of, year_of
from barloom.model import Dataset, StorageError, percent_slug, to_ms
from barloom.schema import BARS, KEY, VALUES
from barloom.session import domain_errors

LAYOUT_VERSION = "5"
MANIFEST = "symbol string, year long, month long, temp string, path string, row_count long, first long, last long, sha256 string"
ARROW = pa.schema([(f.name, pa.timestamp("ms", "UTC") if f.name == "timestamp" else pa.string() if f.dataType.simpleString() == "string" else pa.float64()) for f in BARS])


def month_path(root: str, d: Dataset, year: int, month: int) -> Path:
    slug = percent_slug(*d.symbol.split("/"), *([d.settle] if d.settle else []))
    return Path(root, d.exchange, d.market, slug, d.timeframe, f"year={year:04d}", f"month={month:02d}", "data.parquet")


def sha256_of(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


#: Facts of a derivative that a footer may carry.
DERIVATIVE = ("linear", "inverse", "contract_size")


def merged_facts(old: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """What is known of a derivative stays and grows; StorageError if it would change."""
    if differ := [k for k in old if k in new and old[k] != new[k]]:
        raise StorageError(f"{', '.join(differ)} would change")
    return old | new


def managed(path: str | Path, root: str) -> Path:
    """The path, if it lies below the root and no part of it below the root is a link; else StorageError."""
    path, below = Path(path), Path(root)
    if ".." in path.parts or not path.is_relative_to(below):
        raise StorageError(f"{path} lies outside {root}")
    for part in path.relative_to(below).parts:
        below = below / part
        if below.is_symlink():
            raise StorageError(f"{below} is a link")
    return path


def footer(d: Dataset, year: int, month: int, rows: int, first: int, last: int, provider: str, derivative: dict[str, str] | None = None) -> dict[str, str]:
    found = {
        "layout_version": LAYOUT_VERSION, "exchange": d.exchange, "symbol": d.symbol, "market": d.market, "timeframe": d.timeframe, "year": str(year), "month": str(month),
        "row_count": str(rows), "first": str(first), "last": str(last), "provider": provider,
    }
    return found | ({"settle": d.settle} if d.settle else {}) | (derivative or {})


def row_fault(table: pa.Table, at: np.ndarray, d: Dataset, year: int, month: int) -> str | None:
    """What is wrong with a month's stored rows: order, month, alignment, values that aren't finite, or no proper bar."""
    if table.num_rows and any(table[f.name].null_count for f in BARS if not f.nullable):
        return "a value is null"
    if (np.diff(at) <= 0).any():
        return "rows are not in order"
    bar, first = TimeBar.parse(d.timeframe), to_ms(datetime(year, month, 1, tzinfo=UTC))
    if len(at) and not (first <= at[0] and at[-1] < TimeBar(1, "M").next(first)):
        return "rows lie outside the month"
    if ((at != first) if bar.unit == "M" else ((at - bar.origin_ms) % bar.step_ms != 0)).any():
        return "rows are not on a boundary"
    o, h, low, c, v = (table[name].to_numpy() for name in VALUES)
    if not all(np.isfinite(x).all() for x in (o, h, low, c, v)):
        return "values are not finite"
    if (h < np.maximum(np.maximum(o, c), low)).any() or (low > np.minimum(o, c)).any() or (v < 0).any():
        return "high, low or volume contradict the bar"
    return None


def read_month(path: str | Path, root: str) -> tuple[Dataset, dict[str, str], pa.Table]:
    """A committed file, with footer, identity, path and rows held against each other; StorageError if they differ."""
    table = pq.read_table(path, partitioning=None)
    notes = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items() if k != b"ARROW:schema"}
    if notes.get("layout_version") != LAYOUT_VERSION:
        raise StorageError(f"{path}: layout {notes.get('layout_version')}")
    if not table.schema.remove_metadata().equals(ARROW):
        raise StorageError(f"{path}: schema")
    d = Dataset(*(notes.get(k) for k in KEY))
    values = table["timestamp"].cast(pa.int64()).to_numpy()
    told = footer(d, int(notes["year"]), int(notes["month"]), len(values), int(values[0]) if len(values) else 0, int(values[-1]) if len(values) else 0, notes.get("provider", ""), {k: notes[k] for k in DERIVATIVE if k in notes and d.market == "perpetual"})
    if told != notes:
        raise StorageError(f"{path}: the footer differs from the rows")
    if Path(path) != month_path(root, d, int(notes["year"]), int(notes["month"])):
        raise StorageError(f"{path}: not where its identity belongs")
    if fault := row_fault(table, values, d, int(notes["year"]), int(notes["month"])):
        raise StorageError(f"{path}: {fault}")
    for name, want in zip(KEY, (d.exchange, d.symbol, d.market, d.settle, d.timeframe), strict=True):
        if set(table[name].unique().to_pylist()) - {want}:
            raise StorageError(f"{path}: {name} differs")
    return d, notes, table


def prepare(bars: DataFrame, root: str, provider: str, derivative: dict[str, str] | None = None) -> list:
    """Phase one: merge each dataset's month with its file and write it beside it; the manifest rows.

    The batch wins over stored rows, and later `seq` over earlier. One task holds one dataset's month.
    """

    def write(table: pa.Table) -> pa.Table:
        one = {k: table[k][0].as_py() for k in KEY}
        d, year, month = Dataset(*one.values()), table["year"][0].as_py(), table["month"][0].as_py()
        path = managed(month_path(root, d, year, month), root)
        facts = derivative or {}
        rows = table.sort_by([("timestamp", "ascending"), ("seq", "ascending")]).select(ARROW.names).cast(ARROW)
        if path.exists():
            old_d, notes, old = read_month(path, root)
            if old_d != d or notes["provider"] != provider:
                raise StorageError(f"{path}: another dataset or provider")
            facts = merged_facts({k: notes[k] for k in DERIVATIVE if k in notes}, facts)
            rows = pa.concat_tables([old.replace_schema_metadata(None), rows])
        at = rows["timestamp"].cast(pa.int64()).to_numpy()
        order = np.argsort(at, kind="stable")  # of equal times the last one stays: new ones lie behind stored ones
        at = at[order]
        last = np.append(at[1:] != at[:-1], True)
        merged, at = rows.take(order[last]), at[last]
        merged = merged.replace_schema_metadata(footer(d, year, month, len(at), int(at[0]), int(at[-1]), provider, facts))
        path.parent.mkdir(parents=True, exist_ok=True)
        temp = path.parent / f".data-{uuid.uuid4().hex}.tmp"
        try:
            with open(temp, "wb") as f:
                pq.write_table(merged, f)
                f.flush()
                os.fsync(f.fileno())
            if not pq.read_table(temp, partitioning=None).equals(merged, check_metadata=True):
                raise StorageError(f"{temp}: what was written reads otherwise")
            if fault := row_fault(merged, at, d, year, month):
                raise StorageError(f"{path}: {fault}")
            digest = sha256_of(temp)
        except BaseException:
            temp.unlink(missing_ok=True)
            raise
        values = [d.symbol, year, month, str(temp), str(path), len(at), int(at[0]), int(at[-1]), digest]
        return pa.table({n.split()[0]: [v] for n, v in zip(MANIFEST.split(", "), values, strict=True)})

    ms = F.unix_millis("timestamp")
    dated = bars.select(*[f.name for f in BARS], "seq", year_of(ms).cast("long").alias("year"), month_of(ms).cast("long").alias("month"))
    with domain_errors():
        return dated.groupBy(*KEY, "year", "month").applyInArrow(write, MANIFEST).collect()


def publish(manifest: list) -> None:
    """Phase two: each temporary file takes its place, and the folder is synced; what tasks that ran twice left behind goes."""
    for row in manifest:
        os.replace(row["temp"], row["path"])
        folder = os.open(Path(row["path"]).parent, os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
    for row in manifest:
        for left in Path(row["path"]).parent.glob(".data-*.tmp"):
            left.unlink()


def discard(manifest: list) -> None:
    for row in manifest:
        Path(row["temp"]).unlink(missing_ok=True)


def classify(root: str) -> str:
    """What lies below the root: "empty", "canonical" (month files), or "ambiguous" (writers' leftovers, or other files, too)."""
    try:
        return "ambiguous" if leftovers(root) else "canonical" if os.path.isdir(root) and month_files(root) else "empty"
    except StorageError:
        return "ambiguous"


def clean(root: str, d: Dataset) -> None:
    """Delete what dead writers left of a dataset; for the holder of its lock, before it writes."""
    folder = managed(month_path(root, d, 1970, 1).parents[2], root)
    for left in leftovers(str(folder)):
        Path(left).unlink(missing_ok=True)


def leftovers(root: str) -> list[str]:
    """Temporary files of writers that died."""
    return sorted(str(p) for p in Path(root).rglob(".data-*.tmp")) if os.path.isdir(root) else []


def month_files(root: str) -> list[str]:
    """Committed files in order, without writers' leftovers; StorageError for files of another shape."""
    found = []
    for path in sorted(Path(root).rglob("*")):
        if path.is_file() and not (path.name.startswith(".data-") and path.suffix == ".tmp"):
            if path.name != "data.parquet" or len(path.relative_to(root).parts) != 7:
                raise StorageError(f"{path} does not belong here")
            found.append(str(path))
    return found


def scan_files(spark: SparkSession, root: str, d: Dataset, months: list[tuple[int, int]]) -> DataFrame:
    """Bars of the required months; every file must be there. Spark's own reader, with the fixed schema."""
    paths = [str(month_path(root, d, y, m)) for y, m in months]
    if missing := [p for p in paths if not os.path.exists(p)]:
        raise StorageError(f"missing: {missing}")
    return spark.read.schema(BARS).parquet(*paths) if paths else spark.createDataFrame([], BARS)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, symbol, sha256, row_count, first, last) of all files, each read deeply by a task."""
    paths = month_files(root)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                d, notes, _ = read_month(path, root)
                yield pa.record_batch([[path], [d.symbol], [sha256_of(path)], [int(notes["row_count"])], [int(notes["first"])], [int(notes["last"])]], names=["path", "symbol", "sha256", "row_count", "first", "last"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.mapInArrow(run, "path string, symbol string, sha256 string, row_count long, first long, last long")
