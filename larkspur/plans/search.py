"""Queries of full-text search."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from ..text import search as T
from .catalog import register

WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')"
EN = f"(SELECT doc_id, {WORDS} AS w FROM documents)"
COUNT = lambda x: f"len(list_filter(w, lambda t: t = '{x}'))"


@register("text_tokens", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w[1] AS first_token FROM {EN}")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.get(w, F.lit(0)).alias("first_token"))


SUFFIX_SQL = "CASE WHEN t LIKE '%ies' AND length(t) > 3 THEN t[:-4] || 'y' WHEN t LIKE '%es' AND length(t) > 2 THEN t[:-3] WHEN t LIKE '%s' AND length(t) > 1 THEN t[:-2] WHEN t LIKE '%ed' AND length(t) > 2 THEN t[:-3] WHEN t LIKE '%ing' AND length(t) > 3 THEN t[:-4] WHEN t LIKE '%ly' AND length(t) > 2 THEN t[:-3] ELSE t END"


@register("text_simple_vector", f"SELECT lexeme, count(*) AS n FROM (SELECT {SUFFIX_SQL} AS lexeme FROM (SELECT unnest(w) AS t FROM {EN})) GROUP BY lexeme")
def text_simple_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w"))
    return words.select(T.simple_lexeme(F.col("w")).alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("n"))


@register("text_english_vector")
def text_english_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.to_tsvector(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.size("vector").alias("n_lexemes"))


@register("text_vector_positions", f"SELECT doc_id, lexeme, list(p ORDER BY p) AS positions FROM (SELECT doc_id, {SUFFIX_SQL} AS lexeme, CAST(p AS INTEGER) AS p FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM {EN})) GROUP BY doc_id, lexeme")
def text_vector_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = T.to_tsvector(load(spark, sf_dir, "documents"), "doc_id", "text", "simple")
    return vectors.select("doc_id", F.explode("vector").alias("e")).select("doc_id", "e.lexeme", "e.positions")


@register("text_match", f"SELECT doc_id FROM {EN} WHERE ({COUNT('the')} > 0 AND {COUNT('of')} = 0) OR {COUNT('der')} > 0")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = T.Query.parse("the & !of | der")
    return load(spark, sf_dir, "documents").where(query.matches_text(F.col("text"))).select("doc_id")


@register("text_rank", f"SELECT doc_id, CAST({COUNT('the')} + {COUNT('la')} AS DOUBLE) AS score FROM {EN} WHERE {COUNT('the')} + {COUNT('la')} > 0 ORDER BY score DESC, doc_id LIMIT 25")
def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = T.Query.parse("the | la")
    return load(spark, sf_dir, "documents").select("doc_id", T.text_rank(F.col("text"), query).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(25)


@register("text_rank_cover", f"SELECT doc_id, round(CASE WHEN n > 1 THEN n / (1 + CAST(hi - lo AS DOUBLE) / (n - 1)) ELSE n / 2.0 END, 8) AS score FROM (SELECT doc_id, CAST(count(*) AS DOUBLE) AS n, min(p) AS lo, max(p) AS hi FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM {EN}) WHERE t IN ('the', 'la') GROUP BY doc_id)")
def text_rank_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = T.Query.parse("the | la")
    found = load(spark, sf_dir, "documents").where(query.matches_text(F.col("text")))
    return found.select("doc_id", F.round(T.text_rank_cd(F.col("text"), query), 8).alias("score"))


HEADLINE_SQL = """
WITH s AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS w FROM documents),
f AS (SELECT doc_id, w, coalesce(list_position(list_transform(w, lambda x: lower(x) IN ('the', 'la')), true), 0) AS first FROM s),
b AS (SELECT doc_id, w, CASE WHEN first > 0 THEN greatest(first - 18, 0) ELSE 0 END AS start FROM f)
SELECT doc_id, array_to_string(list_transform(list_slice(w, start + 1, start + CASE WHEN regexp_matches(w[start + 1], '^[A-Za-z0-9_]') THEN 69 ELSE 70 END), lambda x: CASE WHEN lower(x) IN ('the', 'la') THEN '<b>' || x || '</b>' ELSE x END), '') AS headline FROM b
"""


@register("text_headline", HEADLINE_SQL)
def text_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.ts_headline(F.col("text"), T.Query.parse("the | la")).alias("headline"))


@register("text_query_rewrite", f"SELECT doc_id FROM {EN} WHERE {COUNT('die')} > 0 OR {COUNT('das')} > 0")
def text_query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = T.Query.parse("article").rewrite({"article": T.Query.parse("die | das")})
    return load(spark, sf_dir, "documents").where(query.matches_text(F.col("text"))).select("doc_id")


@register(
    "text_common_lexemes",
    f"WITH l AS (SELECT DISTINCT doc_id, {SUFFIX_SQL} AS lexeme FROM (SELECT doc_id, unnest(w) AS t FROM {EN})) SELECT lexeme, count(*) AS n, (SELECT count(*) FROM l) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS average_length FROM l GROUP BY lexeme ORDER BY n DESC, lexeme LIMIT 10",
)
def text_common_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lexeme_statistics(load(spark, sf_dir, "documents"), "doc_id", "text", config="simple")


@register(
    "text_affix_dictionary",
    "SELECT p_partkey, CASE WHEN w IN ('ring', 'rod', 'bolt') THEN w ELSE w || 's' END AS plural, CASE WHEN w IN ('ring', 'rod', 'bolt') THEN w ELSE 'un' || w END AS negated, w AS bare FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS w FROM part)",
)
def text_affix_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that lose a suffix or prefix where the rest is known, and stay in lower case where it is not."""
    w = F.split_part("p_name", F.lit(" "), F.lit(2))
    known, affixes = ["Ring", "rod", "bolt"], [("s", False), ("UN", True)]
    return load(spark, sf_dir, "part").select("p_partkey", T.affix_lexeme(F.concat(F.upper(w), F.lit("S")), known, affixes).alias("plural"), T.affix_lexeme(F.concat(F.lit("Un"), w), known, affixes).alias("negated"), T.affix_lexeme(F.upper(w), known, affixes).alias("bare"))


@register("text_thesaurus", "SELECT p_partkey, CASE WHEN w IN ('ring', 'hoop', 'band') THEN ['ring', 'hoop', 'band'] WHEN w IN ('rod', 'bar') THEN ['rod', 'bar'] ELSE [w] END AS words FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS w FROM part)")
def text_thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.upper(F.split_part("p_name", F.lit(" "), F.lit(2)))
    return load(spark, sf_dir, "part").select("p_partkey", T.thesaurus_lexemes(w, [["ring", "hoop", "band"], ["rod", "bar"], ["band", "strap"]]).alias("words"))
