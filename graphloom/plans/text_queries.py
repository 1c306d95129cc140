"""Full-text search over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem, tokenize
from ..operators import fts
from .catalogue import register, table

WORDS = "the and onre thion shea"
CONFIG = fts.FtsConfig(stemmer="none", stop_words=("the", "and", "of"))
IGNORE_SQL = fts.IGNORE.replace("'", "''")
_TOKENS = f"""
t AS (SELECT doc_id AS id, unnest(list_filter(string_split(lower(regexp_replace(text, '{IGNORE_SQL}', ' ', 'g')), ' '), lambda x: x <> '')) AS term FROM documents),
p AS (SELECT id, term, count(*) AS tf FROM t WHERE term NOT IN ('the', 'and', 'of') GROUP BY ALL),
l AS (SELECT id, sum(tf) AS len FROM p GROUP BY id),
s AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_SCORE = "round(sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score"


def index(spark: SparkSession, sf_dir: str, config: fts.FtsConfig = CONFIG) -> fts.FtsIndex:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return fts.build(docs, ["text"], config)


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@register("fts_search", f"WITH {_TOKENS} SELECT id, {_SCORE} FROM p JOIN d USING (term) JOIN l USING (id) CROSS JOIN s WHERE term IN ('the', 'and', 'onre', 'thion', 'shea') GROUP BY id")
def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(fts.query(index(spark, sf_dir), WORDS))


@register("fts_conjunctive", f"WITH {_TOKENS} SELECT id, {_SCORE} FROM p JOIN d USING (term) JOIN l USING (id) CROSS JOIN s WHERE term IN ('onre', 'shea') GROUP BY id HAVING count(*) = 2")
def fts_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(fts.query(index(spark, sf_dir), "the onre shea", conjunctive=True))


@register("fts_wildcard", f"WITH {_TOKENS} SELECT id, {_SCORE} FROM p JOIN d USING (term) JOIN l USING (id) CROSS JOIN s WHERE regexp_full_match(term, 'thio.*') OR regexp_full_match(term, '.nre') GROUP BY id")
def fts_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(fts.query(index(spark, sf_dir), "thio* ?nre"))


@register("fts_dictionary", f"WITH {_TOKENS} SELECT term, df FROM d")
def fts_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms


@register("fts_top", f"WITH {_TOKENS} SELECT id, {_SCORE} FROM p JOIN d USING (term) JOIN l USING (id) CROSS JOIN s WHERE term IN ('onre', 'shea') GROUP BY id ORDER BY score DESC, id LIMIT 10")
def fts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(fts.query(index(spark, sf_dir), "onre shea")).orderBy(F.col("score").desc(), "id").limit(10)


@register("fts_stemmed")
def fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.query(index(spark, sf_dir, fts.FtsConfig()), "nations regions tionings")


@register("fts_stem_words")
def fts_stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tokenize(F.lower("text"))).alias("word")).distinct()
    return words.select("word", stem(F.col("word")).alias("stem"))


@register("fts_tokenize", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::BIGINT AS tokens FROM documents")
def fts_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokenize(F.col("text"))).cast("long").alias("tokens"))
