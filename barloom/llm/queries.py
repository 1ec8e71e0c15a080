"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import grid_join, langid, line_dedup, media, minhash, mixing, packing, substrings, toxicity, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Production mix. The tables name no domain; the length of the source's name stands in for one.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"d4": 3, "d5": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", F.concat(F.lit("d"), F.length("source").cast("string")))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for a budget of nine tenths of all tokens, at most two epochs of a source."""
    return mixing.mix(with_domain(table(spark, sf_dir, "documents")), MIX_LEVELS, MIX_WEIGHTS, (9, 10), max_epochs=2, seed=7)


def _fill(level: str, parents: str, before: str) -> str:
    """SQL for one level of the budget's way down."""
    on = f"USING ({parents})" if parents else "ON true"
    own = f"{parents}, {level}" if parents else level
    family = f"PARTITION BY {parents}" if parents else ""
    weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1 END"
    return f"""
 {level}_nodes AS (SELECT n.*, b.got FROM (
   SELECT {own}, sum(tokens) * 2 AS capacity, {weight} AS weight FROM leaves GROUP BY {own}) n JOIN {before} b {on}),
 {level}_steps AS (SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
   sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
   FROM {level}_nodes WINDOW o AS ({family} ORDER BY capacity::DOUBLE / weight, {level})),
 {level}_full AS (SELECT *, capacity::HUGEINT * heavy <= (got - taken)::HUGEINT * weight AS is_full FROM {level}_steps),
 {level}_open AS (SELECT *, got - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({family}) AS rest,
   sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({family}) AS all_open,
   sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({family} ORDER BY capacity::DOUBLE / weight, {level} ROWS UNBOUNDED PRECEDING) AS cum
   FROM {level}_full),
 {level}_given AS (SELECT {own}, CASE WHEN is_full THEN capacity
   ELSE (rest::HUGEINT * cum) // nullif(all_open, 0) - (rest::HUGEINT * (cum - weight)) // nullif(all_open, 0) END AS got FROM {level}_open)"""


OP1_SQL = f"""
WITH rows AS (
  SELECT doc_id, domain, lang, source, sum(n)::BIGINT AS n FROM (
    SELECT doc_id, coalesce('d' || length(source), '(null)') AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents)
  GROUP BY ALL
), leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM rows GROUP BY ALL),
 root AS (SELECT (sum(tokens) * 9 // 10)::BIGINT AS got FROM leaves),
{_fill("domain", "", "root")},
{_fill("lang", "domain", "domain_given")},
{_fill("source", "domain, lang", "lang_given")},
 plan AS (SELECT domain, lang, source, (got // tokens)::BIGINT AS whole, (got % tokens)::BIGINT AS rest
   FROM leaves JOIN source_given USING (domain, lang, source) WHERE tokens > 0),
 started AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source
     ORDER BY md5('7-' || whole || '-' || coalesce(doc_id::VARCHAR, 'null')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
   FROM rows JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, n AS n_tokens, n AS take_tokens FROM started, unnest(range(0, whole)) t(e)
UNION ALL
SELECT doc_id, domain, lang, source, whole::INTEGER, n, least(n, rest - start)::BIGINT FROM started WHERE start < rest
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines removed, and the digest of what is left, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(doc_id, 9223372036854775807) AS doc, doc_id, source, text FROM documents),
lines AS (
  SELECT row, doc, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM docs WHERE text IS NOT NULL
), trimmed AS (SELECT *, trim(translate(line, chr(13) || chr(9), '  '), ' ') AS t FROM lines),
spread AS (
  SELECT t, min((doc, pos)) AS first FROM trimmed WHERE length(t) >= 1 GROUP BY t HAVING count(DISTINCT source) >= 5
), judged AS (
  SELECT row, pos, line, (s.t IS NOT NULL AND (doc, pos) <> s.first) AS gone FROM trimmed LEFT JOIN spread s USING (t)
), kept AS (
  SELECT row, count(*) AS n_lines, count_if(gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM judged GROUP BY row
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from `labels.toxic`."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with cosine 0.95 or more."""
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as lossless WebP and read back."""
    return media.read_media(media.store_media(table(spark, sf_dir, "documents")), payload=False)


def tokenizer_path() -> str:
    """The byte-level BPE's file: a parameter of the operator, installed with its library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)


#: Production rules: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = """
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rest AS (
  SELECT page_id, row_number() OVER () AS row,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, row,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ranked AS (
  SELECT p.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY p.row ORDER BY length(rhost || rpath) DESC NULLS LAST, rverdict DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM ranked WHERE place = 1
"""


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles and Jaccard similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=0.8)


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from `documents.lang`."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op10_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 20-word windows that start earlier in the corpus."""
    return substrings.deduplicate(table(spark, sf_dir, "documents"), window=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_line_dedup": op2_line_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_grid_order_join": op4_grid_order_join,
        "op5_lossless_webp": op5_lossless_webp,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_url_filters": op7_url_filters,
        "op8_hyperminhash": op8_hyperminhash,
        "op9_byte_cnn": op9_byte_cnn,
        "op10_fingerprint_index": op10_fingerprint_index,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op7_url_filters": OP7_SQL,
    }
