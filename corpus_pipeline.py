"""The corpus pipeline: documents through the stages below, each written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, near_dedup, packing, quality, repeats
from tablewright.llm.common import held_out, table, unused
from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import drop_unread, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from four fifths of the labels."""
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 0))
    own = unused(docs, "_id")
    bad = written(scores.filter("predicted = 0").select(F.col("doc_id").alias(own)).distinct(), "rejected")
    return docs.join(broadcast_if_small(bad), F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: five words, four fifths."""
    return near_dedup.drop_near(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 400 bytes or 50 words or more that occur elsewhere too."""
    return repeats.cut_repeats(docs, repeats.Passages(), repeats.FIFTY_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces)


STAGES = [("quality classifier", good), ("exact dedup", exact), ("near dedup", near), ("repeated passages", passages), ("best-fit packing", packed)]
ORACLE_SQL = None  # the classifier and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_unread(spark)
    return docs
