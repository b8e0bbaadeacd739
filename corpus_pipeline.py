"""From raw documents to token ids in five stages.

All stages but the last return rows as they came, with all their columns, whatever those are called; an empty table stays empty.
Every stage is written as Parquet and read again before the next, so a lost executor costs a stage's
tasks at most and no plan spans two stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm import decontamination, language, pieces, repetition, simhash
from foldsmith.session import materialize, table

#: Least mean probability of a document's language; below it no language prevails.
LEAST_LANGUAGE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null, empty and blank texts among them; repeated rows stay or go together."""
    return repetition.keep_quality(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those in which no language prevails, go.

    Where no row has a language to learn from, all documents with a letter stay. Repeated rows stay or go together.
    """
    model = language.train_model(language.learning_rows(docs))
    return language.keep_languages(docs, model, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id (null the last); one of repeated rows and of texts without a word."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none. Without test items all stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text; a null or empty text has none. Every row gives one."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(docs, model), model)
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality rules", quality), ("language ID", languages), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("SentencePiece", encode)]

#: The language stage is a trained model, so SQL cannot express run(); tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs, f"pipeline-{i}") if i < len(STAGES) - 1 else docs
    return docs
