"""The operators as queries over the test tables: (spark, folder) -> frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import new_path

from . import (
    alignment,
    ann,
    chat,
    decontam,
    language,
    mixing,
    near_dup,
    secret_scan,
    token_counts,
    token_ids,
    toxicity,
    url_filter,
    vector_codes,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def registered(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
CONTROL_CASE = "\\### Assistant: </turn> ok"


@registered
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@registered
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select(*added.columns).union(added)
    return chat.read_chat(chat.format_chat(turns))


@registered
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@registered
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@registered
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@registered
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-ids")
    token_ids.write_token_ids(table(spark, sf_dir, "documents"), folder)
    return token_ids.read_token_ids(spark, folder, with_ids=False)


@registered
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "is_first")


@registered
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.find_contained(docs, items).drop("row")


@registered
def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@registered
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@registered
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


@registered
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))
