"""From raw documents to token ids in five stages, each on all that its predecessor kept."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from armparity.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from armparity.llm.common import removed, shared_folder, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """``stage`` with small batches: an executor holds some for each task, beside all that earlier stages left in its heap."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go. The model is fitted on the labelled ones among ``docs``."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@bounded
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go from the text; a document of which no word is left goes with them."""
    return line_dedup.keep_rest(docs)


@bounded
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return ngram_join.keep_one(docs)


@bounded
def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("toxicity", civil), ("line_dedup", lines), ("ngram_join", distinct), ("decontaminate", untested), ("byte_bpe", tokens)]

#: The model of the first stage is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the token ids of every document that is kept.

    Between two stages lies a Parquet table in the shared folder; it goes when the next
    one is written, so that only the table the result is read from stays. Null and empty
    texts are judged civil and clean, lose no line and become documents without tokens;
    of repeated rows one stays if their texts have a word. Columns beyond those of
    ``documents`` play no part and do not come out. Without labels nothing is toxic,
    without a benchmark nothing leaks, and no documents give no rows.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = f"{folder}/{k}-{name}"
            docs.write.parquet(written)
            docs = spark.read.parquet(written)
            if before:
                removed(spark, before)
            before = written
    return docs
