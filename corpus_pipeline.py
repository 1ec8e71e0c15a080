"""A training corpus from `documents`: STAGES one after the other, each over all rows that the one before kept.

All stages but the last give the columns of `documents`; the last gives the places of the pieces. Near-duplicates, mixing and
line deduplication take their parameters from here; those not named are the operators' own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import line_dedup, minhash, mixing, packing, toxicity
from barloom.llm.common import prepare_checkpoints, settled
from barloom.llm.queries import MIX_LEVELS, MIX_WEIGHTS, table, tokenizer_path, with_domain


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled rows of the tables.

    Rows are judged one by one: null and empty texts stay, repeated rows and those without an id share their text's fate.
    """
    net = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = toxicity.score(docs, net, carry=tuple(docs.columns)).toDF("id", "held_out", "score", "predicted", *names)
    return scored.where("predicted = 0").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, however short, that many sites share, but where they stand first; n_chars follows the text.

    No row goes: a null text stays null, one whose lines all went is empty. A null source is no site; rows with one doc_id are one document.
    """
    kept = line_dedup.drop_boilerplate(docs, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, one with the smallest doc_id: shingles of five words, similarity 0.8.

    Rows are compared by numbers of their own, so that those with a null doc_id, or one they share, are told apart.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = settled(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    judged = minhash.near_duplicates(rows, words=5, threshold=0.8, doc_id="row", text=text)
    judged = judged.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).join(rows.select("row", doc), "row")
    first = judged.groupBy("group").agg(F.min(F.struct(F.col(doc).isNull().alias("unnamed"), doc, "row")).alias("first"))
    stays = rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi")
    return stays.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def draw(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for a budget of nine tenths of the tokens, each at most once.

    Rows with one doc_id, null too, are drawn together. Texts without a word have no token and are never drawn. No documents, none drawn.
    """
    drawn = mixing.mix(with_domain(docs), MIX_LEVELS, MIX_WEIGHTS, (9, 10), max_epochs=1, seed=7)
    ids = drawn.select(F.col("doc_id").alias("drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["drawn"]), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 1024 tokens; null and empty texts are a piece of the end id alone, repeated rows have theirs each."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", keep_clean),
    ("line dedup", drop_boilerplate),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", draw),
    ("packing", pack),
]

#: Learned scores and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each gives is written to the shared checkpoint folder and read again."""
    prepare_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
