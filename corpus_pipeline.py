"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, SentencePiece ids.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last
return the columns of documents. ``run`` writes what a stage returns as Parquet and gives the next one what it
reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import decontaminate, near_dedup, personal_data, piece_encoding, quality
from weftwork.llm.common import table, without, written
from weftwork.llm.q01_quality import training_labels
from weftwork.llm.q09_piece_encoding import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below 0.5; it is fitted on the labels of ``docs``.

    Rows are dropped by id and text: rows that share an id, or have none, are judged each by its own text; repeated
    rows share their verdict. Null texts are empty ones. Other columns stay as they are; no rows give none.
    """
    return without(docs, quality.keyed_scores(docs, training_labels(spark, sf_dir)).where(F.col("score") < 0.5))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates (five words, 0.8), that of the smallest id; rows without words or id stay."""
    return near_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages; rows that share an id, or have none, are judged each by its own text."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows the new text, and stays where the text is null."""
    found = personal_data.redacted(docs)
    size = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return found.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document."""
    found = piece_encoding.encoded(docs, vocabulary())
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("encoding", encoding_stage),
]

#: Fitting a classifier is beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
