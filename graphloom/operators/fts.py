"""Full-text search: an inverted index as DataFrames, scored with BM25."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import check_stemmer, stem, stem_word, tokenize
from ..storage import forget, stored

#: Characters that documents and queries lose by default (queries keep the wildcards).
IGNORE = "[0-9!@#$%^&*()_+={}\\[\\]:;<>,.?~\\/\\|'\"`-]+"
IGNORE_QUERY = "[0-9!@#$%^&()_+={}\\[\\]:;<>,.~\\/\\|'\"`-]+"
#: The usual function words; longer lists are given as a parameter (words or a one-column DataFrame).
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could "
    "did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into "
    "is it its itself just me more most my myself no nor not of off on once only or other our ours ourselves out over own same she should "
    "so some such than that the their theirs them themselves then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your yours yourself yourselves".split()
)


@dataclass(frozen=True)
class FtsConfig:
    """Options of an index."""

    stemmer: str = "english"
    stop_words: Iterable[str] | DataFrame = field(default=STOP_WORDS)
    ignore_pattern: str = IGNORE
    ignore_pattern_query: str = IGNORE_QUERY
    tokenizer: str = "simple"

    def __post_init__(self) -> None:
        check_stemmer(self.stemmer)
        if self.tokenizer != "simple":
            raise ValueError(f"Tokenizer '{self.tokenizer}' is not available; use simple.")


@dataclass(frozen=True)
class FtsIndex:
    """Postings ``term, id, tf``, lengths ``id, len`` and dictionary ``term, df``; documents without a token are in none."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    config: FtsConfig
    #: Stored tables that go with the index.
    paths: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        for name in ("postings", "lengths", "terms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str, config: FtsConfig) -> FtsIndex:
        return FtsIndex(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "terms")], config)

    def without(self, ids: DataFrame) -> FtsIndex:
        """The index after deleting the documents in ``ids`` (``id``)."""
        return _indexed(self.postings.join(ids.select("id"), "id", "left_anti"), self.config)

    def with_rows(self, docs: DataFrame, columns: list[str]) -> FtsIndex:
        """The index after inserting or updating ``docs``; rows with a known id replace it."""
        kept = self.postings.join(docs.select("id"), "id", "left_anti")
        return _indexed(kept.unionByName(_postings(docs, columns, self.config)), self.config)


def words(text: Column, ignore: str, tokenizer: str) -> Column:
    return tokenize(F.lower(F.regexp_replace(text, ignore, " ")), tokenizer)


def _stop_frame(config: FtsConfig, df: DataFrame) -> DataFrame | None:
    if isinstance(config.stop_words, DataFrame):
        return config.stop_words.select(F.col(config.stop_words.columns[0]).alias("word")).distinct()
    return None


def _postings(docs: DataFrame, columns: list[str], config: FtsConfig) -> DataFrame:
    # documents are dealt by id once, so their words and stems fold without being shuffled one by one
    docs = docs.select("id", F.concat_ws(" ", *[F.col(c) for c in columns]).alias("text")).repartition("id")
    text = F.col("text")
    each = docs.select("id", F.explode(words(text, config.ignore_pattern, config.tokenizer)).alias("word"))
    stop = _stop_frame(config, docs)
    if stop is not None:
        each = each.join(stop, "word", "left_anti")
    elif config.stop_words:
        each = each.where(~F.col("word").isin(list(config.stop_words)))
    # words fold before they are stemmed: a word is stemmed once a document
    counted = each.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    stemmed = counted.select("id", stem(F.col("word"), config.stemmer).alias("term"), "n")
    return stemmed.groupBy("id", "term").agg(F.sum("n").alias("tf")) if config.stemmer != "none" else stemmed.withColumnRenamed("n", "tf")


def _indexed(postings: DataFrame, config: FtsConfig) -> FtsIndex:
    """Postings are kept in ranges of terms, sorted, so that a query's terms prune files and row groups of the scan.

    They are stored before they are dealt in ranges, as the ranges' bounds take a pass of their own.
    """
    paths, passing = [], []
    given = stored(postings, "given", passing)
    lengths = stored(given.groupBy("id").agg(F.sum("tf").alias("len")), "lengths", paths)
    kept = stored(given.repartitionByRange("term").sortWithinPartitions("term", "id"), "postings", paths)
    forget(postings.sparkSession, passing)
    counted = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = stored(counted.sortWithinPartitions("term"), "terms", paths)
    return FtsIndex(kept, lengths, terms, config, paths)


def build(docs: DataFrame, columns: list[str], config: FtsConfig | None = None) -> FtsIndex:
    """Indexes the string ``columns`` of ``docs`` (key ``id``); all of them make up one document length."""
    return _indexed(_postings(docs, columns, config or FtsConfig()), config or FtsConfig())


def query_terms(text: str, config: FtsConfig, conjunctive: bool) -> tuple[list[str], list[str]]:
    """Exact (stemmed) and wildcard terms of a query; stop words go only from conjunctive ones."""
    import re

    cleaned = re.sub(config.ignore_pattern_query, " ", text).lower()
    found = [t for t in cleaned.split(" ") if t]
    if conjunctive:
        stop = config.stop_words
        stop = {r[0] for r in stop.select(stop.columns[0]).where(F.col(stop.columns[0]).isin(found)).collect()} if isinstance(stop, DataFrame) else set(stop)
        found = [t for t in found if t not in stop]
    wild = [t for t in found if "*" in t or "?" in t]
    plain = [stem_word(t, config.stemmer) for t in found if t not in wild]
    return list(dict.fromkeys(plain)), list(dict.fromkeys(wild))


def query(
    index: FtsIndex, text: str, k: float = 1.2, b: float = 0.75, conjunctive: bool = False, top: int | None = None
) -> DataFrame:
    """``id, score`` by BM25 with the decimal logarithm; ``top`` keeps the best, ties to the lower id.

    The query's terms reach the postings scan as a filter; nothing but matching postings is shuffled.
    """
    if k < 0:
        raise ValueError("BM25 model requires the Term Frequency Saturation(k) value to be a positive number.")
    if not 0 <= b <= 1:
        raise ValueError("BM25 model requires the Document Length Normalization(b) value to be in the range [0,1].")
    plain, wild = query_terms(text, index.config, conjunctive)
    conditions = [(t, F.col("term") == t) for t in plain]
    conditions += [(t, F.col("term").rlike("^(?:" + t.replace("*", ".*").replace("?", ".") + ")$")) for t in wild]
    some = F.lit(False)
    if plain:
        some = some | F.col("term").isin(plain)
    for _, c in conditions[len(plain) :]:
        some = some | c
    stats = index.lengths.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))  # one row
    hit = index.postings.where(some).join(index.terms.where(some), "term").join(index.lengths, "id").join(F.broadcast(stats))
    idf = F.log10((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.lit(k) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.when(F.col("avgdl") > 0, F.col("avgdl")))
    one = idf * F.col("tf") * (k + 1) / (F.col("tf") + norm)
    covered = [F.max(F.when(c, 1).otherwise(0)).alias(f"c{i}") for i, (_, c) in enumerate(conditions)] if conjunctive else []
    scored = hit.groupBy("id").agg(F.sum(one).alias("score"), *covered)
    for i in range(len(covered)):
        scored = scored.where(F.col(f"c{i}") == 1)
    scored = scored.select("id", "score")
    return scored.orderBy(F.col("score").desc(), "id").limit(top) if top is not None else scored
