"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame; written as Parquet, it is the next stage's
``docs``. Models are learnt from the stage's own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlark.llm import language, lines, mixing, ngram_join, pieces
from fleetlark.llm.common import shared_folder

# A document stays if its language is determined with at least this posterior.
LEAST_CERTAIN = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with at least LEAST_CERTAIN, go. A missing
    ``lang`` takes the prediction; other columns stay, whatever their names. Where no document has a
    ``lang``, no language can be learnt and all documents stay as they are."""
    langs, logp = language.fit(docs)
    if not langs:
        return docs
    predicted, score = pieces.free_name(docs.columns, "lang_pred"), pieces.free_name(docs.columns, "score")
    found = language.classified(docs, langs, logp, into=(predicted, score))
    kept = found.where((F.col(predicted) != language.UNDETERMINED) & (F.col(score) >= LEAST_CERTAIN))
    return kept.withColumn("lang", F.coalesce("lang", predicted)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which no line is left."""
    return lines.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, directly or
    through others, the one of smallest id stays."""
    return ngram_join.keep_one_of_each(docs, threshold="0.8", width=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the mix's weights, each at most once."""
    return mixing.mix_sources(docs, epochs=1).where("copies > 0").select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``tokens``, a sampled segmentation."""
    return pieces.encode(docs)


STAGES = [("language ID", language_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_duplicate_stage),
          ("mixing to target weights", mixing_stage), ("SentencePiece encoding", pieces_stage)]
# Shingle sets, MinHash candidates and sampled segmentations cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``. What a stage returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
