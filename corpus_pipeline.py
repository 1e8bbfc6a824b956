"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing, SentencePiece ids.

Each stage takes the documents that the one before it kept and returns documents, the last one the
encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.llm import langid, mixing, pieces, simhash, substrings
from textgauge.llm.common import crc_mod, hold_batches, written
from textgauge.llm.queries import tokenizer
from textgauge.plans.session import spread

#: Documents under this share of the greatest distance to every profile are no text of a known language.
LANGUAGE_FROM = 0.2
ORACLE_SQL = None


def ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A stage's documents, in a session whose batches suit them, over all cores."""
    hold_batches(spark)
    return spread(docs)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are near enough to a known language; null and letterless texts go."""
    docs = ready(spark, docs)
    profiles = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    made = langid.identify(docs, profiles, to="__language")
    return made.where((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LANGUAGE_FROM)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of copies and near copies (five-word shingles, similarity 0.8)."""
    docs = ready(spark, docs)
    return simhash.keep_first(docs, simhash.similar_documents(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    docs = ready(spark, docs)
    return substrings.drop_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them, one row a pass."""
    docs = ready(spark, docs)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, n_fallback, round_trip and ids of every row of the mix."""
    docs = ready(spark, docs)
    made = pieces.encode_documents(spark, docs, tokenizer("piece_bpe_32k.model"), remembered=60_000, forget=True)
    return made.select("doc_id", "source", "pieces.n_tokens", "pieces.n_fallback", "pieces.round_trip", "pieces.ids")


STAGES = [
    ("language_id", by_language),
    ("near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("mix_sources", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
