"""URL rules, indexed by their rarest literal token.

A rule is (host, path, verdict): it fits its host and every subdomain when the url's path starts
with the rule's path. Each rule is filed under one token that every url it fits must hold: a host
label, or a path segment closed by a slash, whichever is rarest over all urls. A url fetches the rules
filed under its own tokens, and only those run their regular expression. The longest rule that
fits wins.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower

#: More rules than this are joined without a broadcast hint.
BROADCAST_RULES = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; path: then up to ``? #``.

    Both are empty for a null url or one without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return (
        ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def _tokens(host: Column, path: Column) -> Column:
    """Host labels and closed path segments, tagged by kind; the text after the last slash is open."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    closed = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, closed), lambda x: F.length(x) > 2))


def index_rules(rules: DataFrame, urls: DataFrame, small: bool = False) -> DataFrame:
    """(token, rule, verdict, pattern, rank): every rule under its rarest token over all of `urls`.

    `urls` has the columns host and path. Ties go to the longer token, then to the smaller text. Rows of
    `rules` with a null or an empty host are left out, and repeated rules count once. `small`: the rule list is known to be within BROADCAST_RULES.
    """
    named = (
        rules.where("host IS NOT NULL AND host <> '' AND verdict IS NOT NULL")
        .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .distinct()
    )
    named = named.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.concat(F.lit(r"^(?:[^/]*\.)?\Q"), F.replace(F.concat("host", "path"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")).alias("pattern"),
        (F.length("host") + F.length("path")).alias("rank"),
        F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"),
    )
    wanted = named.select("token").distinct()
    counts = (
        urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(F.broadcast(wanted) if small else wanted, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("urls"))
    )
    rarity = F.struct(F.coalesce("urls", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), F.col("token"))
    return (
        named.join(counts, "token", "left")
        .groupBy("rule", "verdict", "pattern", "rank")
        .agg(F.min(rarity)["token"].alias("token"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), otherwise: str = "allow"
) -> DataFrame:
    """The `keep` columns of every row, with host, path, rule and verdict.

    One row for each row of `pages`, repeated rows too. A url that no rule fits (null and malformed
    ones too) has a null rule and the verdict `otherwise`. Of rules of one length that fit, a block
    goes before an allow, then the larger text. Columns of `pages` that are not kept may have any
    name. No rules, or no pages, are fine.

    Plan: the tokens fan out from each row, meet the index in a broadcast join (no shuffle of the urls,
    so a hot host is no hot task), and come together again in one aggregation by row number.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], host.alias("host"), path.alias("path"))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    index = index_rules(rules, rows.select("host", "path"), small)
    fits = F.rlike(F.concat("host", "path"), F.col("pattern"))
    best = F.struct(
        F.col("rank"), (F.col("verdict") == "block").alias("blocks"), F.col("rule"), F.col("verdict")
    )
    fanned = rows.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "token", F.explode_outer(_tokens(F.col("host"), F.col("path")))
    )
    kept = [f"k{i}" for i in range(len(keep))]
    judged = (
        fanned.join(F.broadcast(index) if small else index, "token", "left")
        .groupBy("row")
        .agg(*[F.first(c).alias(c) for c in [*kept, "host", "path"]], F.max(F.when(fits, best)).alias("best"))
    )
    return judged.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
