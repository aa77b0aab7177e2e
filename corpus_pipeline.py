"""From raw documents to token ids: each stage works on all that the one before it kept.

``run`` writes the result of every stage as Parquet and reads it back as the next one's documents. Every
stage takes an empty table, and columns of any name beside those of the documents, which it keeps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, near_dup, token_ids, toxicity
from tidemark.llm.common import bound_batches, free_name, quoted, table
from tidemark.session import materialise, new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session of small Arrow batches. The setting stays, for the frame that the stage
    returns is worked out later; results do not depend on it."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores below one half.

    Null and empty texts are scored as empty ones. Equal rows have one fate. Without labels of both
    kinds all documents have the score of the more frequent kind.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least key; null keys come last.

    Texts without words are one class. Of equal rows one stays.
    """
    return near_dup.drop_near_duplicates(docs)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weight of their source asks, in random order.

    A null source is a source of its own; rows of equal keys, also null ones, are drawn together.
    """
    prefix = free_name(docs, "__mix_")
    while any(free_name(docs, prefix + name) != prefix + name for name in ("copy", "order")):
        prefix += "_"
    return mixing.mix_sources(docs, prefix=prefix).select(*map(quoted, docs.columns))


@in_small_batches
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents as files; what was read back from them, per document.

    Null and empty texts are their end id alone; null keys come first, equal keys are a row each.
    """
    folder = new_path(spark, "token-ids")
    token_ids.write_token_ids(docs, folder)
    return token_ids.read_token_ids(spark, folder, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

# A trained classifier, signatures and a tokenizer have no SQL; tests/llm/test_pipeline.py compares
# each stage with brute force on a small folder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


REGISTERED = {"pipeline": run}
