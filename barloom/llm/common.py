"""What several operators of this subpackage share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import shared_folder

#: Words are runs of anything but these: blank, and tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def prepare_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; set one only where none is named (as in tests)."""
    shared_folder(spark)


#: Shuffle files go once the query that wrote them has ended; settled rows never need them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: computed once, safe from lost executors."""
    prepare_checkpoints(df.sparkSession)
    with dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Queries made in this block drop their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def train_rows(doc_id: str = "doc_id") -> Column:
    """Rows a classifier may learn from: crc32 of doc_id as text, modulo 3, is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 = 1; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id that each node of the undirected edges reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round hangs every
    neighbour of a node on the smallest one; it stops when a round changes nothing. Every round is
    two aggregations and two equi-joins whose sides AQE may split at a hot node; no list of
    neighbours is ever gathered, and each round is settled in the checkpoint folder. Nodes
    without an edge do not appear. Null ends and loops are ignored.
    """
    links = settled(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    seen = _signature(links)
    while seen[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        links = settled(small)
        now = _signature(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _signature(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(7), "v", "u").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
