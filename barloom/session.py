"""Session settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from barloom import model

#: What a session must say for the calendar arithmetic and the stored files to be right.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MILLIS",
}


def local_session(name: str = "barloom", cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; one of this machine's own only where the whole cluster is it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise SessionError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="barloom-checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder: a lost executor can't have them computed anew and otherwise."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def domain_errors() -> Iterator[None]:
    """An error of the library that a task raised comes out of a Spark job as itself; any other as it is."""
    try:
        yield
    except PySparkException as e:
        kinds = {k: c for k, c in vars(model).items() if isinstance(c, type) and issubclass(c, model.BarloomError)}
        if found := re.findall(r"barloom\.model\.(\w+): (.*)", str(e)):
            kind, message = found[-1]
            raise kinds.get(kind, model.BarloomError)(message) from e
        raise


class SessionError(RuntimeError):
    """The session would give wrong answers."""


def require_utc(spark: SparkSession) -> None:
    """Refuse a session whose time zone would move bars between partitions."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise SessionError(f"spark.sql.session.timeZone is {zone}; it must be UTC")
