"""Bounded, repeatable samples of labelled rows, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import train_rows


def drawn(rows: DataFrame, most: int, identity: list[str], seed: int) -> DataFrame:
    """About `most` rows of each `label`, by a seeded hash of the identity: the same on every run and any partitions."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    whole = 1 << 30
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("label") == name, min(whole, most * whole // max(n, 1))).otherwise(share)
    return rows.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(whole))).where(F.col("place") < share)


def labelled_sample(docs: DataFrame, label: Column, most: int, doc_id: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """About `most` rows (doc_id, text, label, place) of each label, of those that may be learned from and lack neither."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label.alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    return drawn(rows.where(train_rows("doc_id")), most, ["doc_id", "text"], seed)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object]):
    """fit() on the (text, label) pairs of a bounded sample, run in one task so that the driver's memory stays free."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("place", "text", "label")), strict=True), key=lambda r: (r[0], r[1], str(r[2])))
        return pa.table({"model": pa.array([pickle.dumps(fit([(t, y) for _, t, y in rows]))], pa.binary())})

    rows = sample.select("place", "text", "label", (F.col("place") % 1).alias("one"))
    models = rows.groupBy("one").applyInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fit([])
