"""Cross-site boilerplate lines, by the spread of their distinct sites.

Lines that occur often enough are sketched: a HyperLogLog sketch of sites for each line hash, merged by the aggregation.
A line whose estimate lies clear of the threshold is decided by it; near the threshold the distinct sites are counted
exactly. A boilerplate line stays where it stands first and goes everywhere else.

The HOT most frequent lines, a list of that length and no more, are known in every task and dealt over SALTS partitions each;
any other line has at most one HOT-th of all rows. So no join gathers one line's rows in a task.

DataFrame expressions only; the text is split twice for the lines, to count them and to sketch them, and a third time to apply the
decisions: a line's hashes are not settled, since they outweigh the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settled

LAST = (1 << 63) - 1
#: Sketches have 2**LG_K registers; a relative error beyond MARGIN, seven deviations, doesn't happen in practice.
LG_K = 12
MARGIN = 7 * 1.04 / (1 << LG_K) ** 0.5
HOT = 2000
SALTS = 64


def _line(x: Column) -> Column:
    return F.trim(F.translate(x, "\r\t", "  "))


def _dealt(keys: DataFrame) -> DataFrame:
    """Keys once for each salt that their rows carry."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return keys.withColumn("salt", F.explode(salts))


def drop_boilerplate(
    docs: DataFrame, min_sites: int = 5, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text", site: str = "source", counts: bool = False
) -> DataFrame:
    """`docs` with the text less the boilerplate lines; with `counts`, n_lines and n_removed (long) behind.

    Lines end at \\n and are compared without blanks, tabs and \\r at their ends. One with at least `min_chars` characters
    that occurs on at least `min_sites` distinct sites is boilerplate, and stays only at the smallest (doc_id,
    line number). A null site is no site. A null text stays null and has no lines; an empty one has one. A null doc_id comes
    after all others. Rows that share a doc_id are one document: a line at its first place stays in all of them.
    All rows and columns stay, whatever their names; an empty table gives none. No document is dropped.
    """
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    lines = docs.select(order.alias("doc"), F.col(site).alias("site"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    lines = lines.withColumn("line", _line(F.col("line"))).where(F.length("line") >= min_chars)
    lines = lines.select("doc", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(77), "line").alias("h2"))
    often = settled(lines.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites))
    hot = F.broadcast(often.orderBy(F.desc("n"), "h1", "h2").limit(HOT).select("h1", "h2", F.lit(True).alias("hot")))
    marked = lines.join(hot, ["h1", "h2"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    marked = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int")).otherwise(0))
    wanted = _dealt(often.join(hot, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("hot", F.lit(False)).alias("hot")))
    on = ["h1", "h2", "salt"]
    rows = settled(marked.join(wanted.select(*on), on, "left_semi"))
    spread = rows.groupBy("h1", "h2", "hot").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("doc", "at")).alias("first")
    )
    spread = settled(spread)
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    near = spread.where(F.col("sites").between(low, high))
    exact = (
        rows.join(_dealt(near).select(*on), on, "left_semi").select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites)
    )
    boilerplate = spread.where(F.col("sites") > high).select("h1", "h2", "hot", "first").union(
        near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "hot", "first")
    )
    gone = (
        rows.join(_dealt(boilerplate).drop("hot"), on)
        .where("doc <> first.doc OR at <> first.at")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("at", "h1")).alias("gone"))
    )
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at = docs.columns.index(text)
    named = docs.toDF(*names).withColumn("doc", F.coalesce(F.col(names[docs.columns.index(doc_id)]).cast("long"), F.lit(LAST)))
    joined = named.join(gone, "doc", "left")
    whole = F.split(F.col(names[text_at]), "\n")
    kept = F.filter(whole, lambda x, i: ~F.array_contains(F.col("gone"), F.struct(i.alias("at"), F.xxhash64(_line(x)).alias("h1"))))
    joined = joined.withColumn("kept", F.when(F.col("gone").isNull(), whole).otherwise(kept))
    out = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    out[text_at] = F.array_join("kept", "\n").alias(text)
    if counts:
        n = F.coalesce(F.size(whole), F.lit(0))
        n = F.when(F.col(names[text_at]).isNull(), 0).otherwise(n).cast("long")
        left = F.when(F.col(names[text_at]).isNull(), 0).otherwise(F.size("kept")).cast("long")
        out += [n.alias("n_lines"), (n - left).alias("n_removed")]
    return joined.select(*out)
