"""Mixing sources to target weights over a tree such as domain, language, source.

Token counts add up from the leaves; a node can give its tokens times `max_epochs`. The budget goes down the tree: the children
of a node share what it got by weight, and what a child cannot give goes to its siblings before it could go anywhere
else, since a node is never given more than its whole subtree holds. A leaf gives whole epochs of its documents, then the
first tokens of one more epoch in that epoch's seeded order.

The prefix of a leaf is found by sums over ranges of the order, and only the range where it ends is sorted, so a
leaf with a third of all documents is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_CLASS, settled

#: Documents in a range of a leaf's order, about.
RANGE_DOCS = 2048


def tokens_of(text: Column) -> Column:
    """Words that blanks and tab to carriage return part; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def seeded(seed: int, epoch: Column, doc: Column) -> Column:
    """The place of a document in an epoch's order."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """`nodes` (parents, name, weight, capacity, got) with `given`: what each gets of its parent's `got`.

    Water-filling in whole numbers: in the order of capacity by weight, children that cannot give their share give all they
    have; the others part the rest by weight, rounded so that the sum is exact.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = family.orderBy((F.col("capacity").cast("double") / F.col("weight")).asc(), F.col(name).asc())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = nodes.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("heavy", F.sum("weight").over(onward))
    full = exact("capacity") * exact("heavy") <= (exact("got") - exact("taken")) * exact("weight")
    step = step.withColumn("full", full)
    step = step.withColumn("rest", F.col("got") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family))
    step = step.withColumn("open", F.when(F.col("full"), 0).otherwise(F.col("weight")))
    step = step.withColumn("all_open", F.sum("open").over(family)).withColumn("cum", F.sum("open").over(upto))
    part = "cast((cast(rest AS decimal(25,0)) * cast({} AS decimal(12,0))) div cast(nullif(all_open, 0) AS decimal(12,0)) AS bigint)"
    given = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr(part.format("cum")) - F.expr(part.format("(cum - open)")))
    return step.withColumn("given", given).drop("taken", "heavy", "full", "rest", "open", "all_open", "cum", "got")


def mix(
    docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int = 1, seed: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, *levels, epoch, n_tokens, take_tokens): which documents are drawn, in which epochs, and how much of each.

    The budget is share[0] / share[1] of all tokens, at most max_epochs times all. `weights` has positive whole numbers by level and name, 1
    where it is silent. Documents are drawn by doc_id: rows that share one, and its place in the tree, count as one text.
    A document whose first token is in the prefix is drawn, and take_tokens says how many of its tokens are in it. Null names
    and a null doc_id are names like any other; null texts have no tokens. A leaf without tokens gives nothing. Other
    columns are not read; an empty table gives none. Columns of the result have the levels' names.
    """
    named = docs.select(F.col(doc_id).alias("doc"), *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(f"l{i}") for i, c in enumerate(levels)], tokens_of(F.col(text)).alias("n"))
    path = [f"l{i}" for i in range(len(levels))]
    rows = settled(named.groupBy("doc", *path).agg(F.sum("n").alias("n")))
    leaves = settled(rows.groupBy(*path).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")))
    total = leaves.agg(F.sum("tokens"), F.max("docs")).first()
    budget = min((total[0] or 0) * share[0] // share[1], (total[0] or 0) * max_epochs)
    held = None
    for depth in range(1, len(path) + 1):
        here = path[:depth]
        weight = F.lit(1)
        for name, w in weights.get(levels[depth - 1], {}).items():
            weight = F.when(F.col(here[-1]) == name, w).otherwise(weight)
        nodes = leaves.groupBy(*here).agg((F.sum("tokens") * max_epochs).alias("capacity")).withColumn("weight", weight.cast("long"))
        nodes = nodes.withColumn("got", F.lit(budget).cast("long")) if held is None else nodes.join(held, here[:-1])
        held = share_out(nodes, here[:-1], here[-1]).select(*here, F.col("given").alias("got"))
    digits = 0
    while 16**digits * RANGE_DOCS < (total[1] or 0):
        digits += 1
    plan = leaves.join(held, path).where("tokens > 0").select(*path, F.expr("got div tokens").alias("whole"), F.expr("got % tokens").alias("rest"))
    placed = settled(
        rows.join(plan, path)
        .withColumn("key", seeded(seed, F.col("whole"), F.col("doc")))
        .withColumn("span", F.substring("key", 1, digits) if digits else F.lit(""))
    )
    spans = placed.groupBy(*path, "span").agg(F.sum("n").alias("size"))
    spans = spans.withColumn("before", F.sum("size").over(Window.partitionBy(*path).orderBy("span")) - F.col("size")).drop("size")
    inner = Window.partitionBy(*path, "span").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.join(spans, [*path, "span"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    last = F.when(F.col("start") < F.col("rest"), F.array(F.struct(F.col("whole").alias("epoch"), F.least("n", F.col("rest") - F.col("start")).alias("take"))))
    whole = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1), lambda e: F.struct(e.alias("epoch"), F.col("n").alias("take"))))
    none = F.array().cast("array<struct<epoch:bigint,take:bigint>>")
    drawn = started.withColumn("draw", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(last, none))))
    return drawn.select(
        F.col("doc").alias("doc_id"),
        *[F.col(p).alias(c) for p, c in zip(path, levels, strict=True)],
        F.col("draw.epoch").cast("int").alias("epoch"),
        F.col("n").alias("n_tokens"),
        F.col("draw.take").alias("take_tokens"),
    )
