"""A corpus pipeline: language ID, near-duplicate removal, mixing to target weights, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join, langid, mixing, unigram
from ledgerloom.llm.common import materialize, table
from ledgerloom.llm.queries import tokenizer

#: Texts with a lesser share of n-grams known in their language are rejected.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like no learned language, go."""
    model = langid.train(docs.where(~langid.is_held_out()))
    kept = langid.predict(docs, model).where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard similarity of 0.8 over five-word shingles, the least id stays."""
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have tempered shares of source, language and topic."""
    return mixing.sample(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that decode to the text."""
    out = unigram.encode(docs, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", F.col("_sp_ids").alias("piece_ids"), F.size("_sp_ids").cast("long").alias("n_pieces"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: SQL cannot express the language filter, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
