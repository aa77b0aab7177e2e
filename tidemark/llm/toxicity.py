"""Toxicity of texts: a linear classifier over character n-grams scaled by log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

from .common import quoted, text_of
from .descent import PIECES, minimise, sum_over

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
TRAINING_ROWS = 8_000  # labelled rows that a model is fitted on at most
ROUNDS, PENALTY = 25, 1.0
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def ngram_buckets(text: str) -> np.ndarray:
    """Hashed buckets of all character n-grams of the lower-case text, with repetitions. White space
    counts as one space, and the text has a space at either end."""
    letters = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
    letters = letters.astype(np.uint64) + np.uint64(1)
    hashes, found = np.zeros(len(letters), np.uint64), []
    for size in range(1, max(SIZES) + 1):
        if len(letters) < size:
            break
        hashes = hashes[: len(letters) - size + 1] * MULTIPLIER + letters[size - 1 :]
        if size in SIZES:
            mixed = (hashes ^ (hashes >> np.uint64(29))) * MIXER
            found.append((mixed >> np.uint64(46)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Weight of each bucket that occurs in a text, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str, last: np.ndarray) -> float:
        """Probability of the label 1. ``last`` is scratch space, one number per bucket."""
        buckets = ngram_buckets(text)
        places = np.arange(len(buckets), dtype=np.int32)
        last[buckets] = places
        once = buckets[last[buckets] == places]
        logit = self.bias + float(self.weights[once].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def _counts(_: None, batch: pa.RecordBatch) -> np.ndarray:
    """Rows of either label that hold each bucket, and the number of rows of either label."""
    labels, lists = batch.column(0).to_numpy(), batch.column(1)
    columns, row_of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    of_label = labels[row_of] == 1
    held = [np.bincount(columns[of_label == wanted], minlength=BUCKETS) for wanted in (True, False)]
    return np.concatenate([*held, [(labels == 1).sum(), (labels != 1).sum()]]).astype(np.float64)


def _slope(state: tuple[np.ndarray, np.ndarray, float, np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
    """Gradient of the loss of a batch by scaled weight and bias, and the loss itself."""
    ratio, weights, bias, share = state
    labels, lists = batch.column(0).to_numpy().astype(np.float64), batch.column(1)
    columns, row_of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    logit = bias + np.bincount(row_of, (ratio * weights)[columns], len(lists))
    counted = share[labels.astype(int)]
    error = counted * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - labels)
    slope = np.bincount(columns, error[row_of], BUCKETS) * ratio
    return np.concatenate([slope, [error.sum(), counted @ (np.logaddexp(0, logit) - labels * logit)]])


def fit(rows: DataFrame, *, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Logistic regression on presence of buckets times their naive Bayes log-count ratio.

    ``rows`` is a stored table (label, buckets), the distinct buckets of each training row. Counts and
    gradients are summed by tasks; the driver holds a few arrays of one number per bucket, all of which
    get a weight. Both classes count alike in the loss, however many rows they have. With one class only, all texts score that class's smoothed share.
    """
    counts = sum_over(rows, _counts, None, 2 * BUCKETS + 2)
    positive, negative = counts[-2:]
    if not positive or not negative:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((positive + 1) / (negative + 1))))
    with_label, without = counts[:BUCKETS] + 1, counts[BUCKETS:-2] + 1
    ratio = np.log(with_label / with_label.sum()) - np.log(without / without.sum())
    ratio[counts[:BUCKETS] + counts[BUCKETS:-2] == 0] = 0.0  # never seen: nothing is known of it
    n = positive + negative
    share = np.array([n / (2 * negative), n / (2 * positive)])

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        total = sum_over(rows, _slope, (ratio, at[:-1], float(at[-1]), share), BUCKETS + 2)
        slope = total[:-1] / n
        slope[:-1] += penalty * at[:-1] / n
        return float(total[-1] / n + penalty * (at[:-1] @ at[:-1]) / (2 * n)), slope

    best = minimise(loss, np.zeros(BUCKETS + 1), rounds=rounds)
    return Model((best[:-1] * ratio).astype(np.float32), float(best[-1]))


def held_out(key: str) -> Column:
    """Rows that no model learns from: crc32 of the key as text, mod 5, is 0."""
    return F.coalesce(F.crc32(quoted(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_table(
    docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, training_rows: int
) -> DataFrame:
    """(label, buckets) of at most ``training_rows`` different labelled rows, those with the smallest
    hash of the key, as a stored table in the order of their keys."""
    few = lambda df, *order: F.broadcast(df.orderBy(*order).limit(training_rows))
    chosen = few(
        labels.filter(~held_out(key))
        .groupBy(quoted(key).alias("key"))
        .agg(F.max(quoted(label).cast("int")).alias("label"))
        .filter("key IS NOT NULL AND label IS NOT NULL"),
        F.xxhash64("key"),
        "key",
    )
    texts = docs.select(quoted(key).alias("key"), text_of(text).alias("text")).join(chosen, "key")
    texts = texts.withColumn("hash", F.xxhash64("text"))
    # A key may stand for many rows of documents: the bound holds for rows, not only for keys.
    which = few(texts.select("key", "hash").distinct(), F.xxhash64("key"), "key", "hash")
    rows = texts.join(which, ["key", "hash"]).dropDuplicates(["key", "hash"])
    rows = rows.repartition(PIECES, "key").sortWithinPartitions("key", "hash")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = [np.unique(ngram_buckets(t.as_py())) for t in batch.column(1)]
            buckets = pa.array(once, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), buckets], ["label", "buckets"])

    features_of = rows.select("label", "text").mapInArrow(features, "label int, buckets array<int>")
    return materialise(features_of, "training")


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    training_rows: int = TRAINING_ROWS,
) -> Model:
    """Fits on at most ``training_rows`` labelled rows, those with the smallest hash of the key.

    A key labelled more than once counts as 1 if any label is; rows with a null key or label are not
    learned from, and rows of documents that are equal in key and text count once. The rows' buckets
    stay in a stored table; only sums over it reach the driver.
    """
    table = training_table(docs, labels, key=key, text=text, label=label, training_rows=training_rows)
    return fit(table)


def toxicity_of(model: Model, docs: DataFrame, text: str) -> Column:
    """The score of a text column, as a column: no other column goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: one weight per bucket

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted, last = shared.value, np.zeros(BUCKETS, np.int32)
        for texts in batches:
            yield pa.array([fitted.score(t.as_py(), last) for t in texts], pa.float64())

    return score(text_of(text))


def score_toxicity(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score), one row per row of ``docs``: how likely label 1 is for the whole text.

    Null texts are empty; an empty text scores what its few n-grams and the bias give. Keys may
    repeat or be null, other columns are not looked at.
    """
    return docs.select(quoted(key).cast("long").alias(key), toxicity_of(model, docs, text).alias("score"))


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns, whatever
    their names."""
    return docs.filter(toxicity_of(model, docs, text) < threshold)


def judge_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) with a model trained on the rows that are not held out."""
    scored = score_toxicity(docs, train(docs, labels, key=key), key=key)
    return scored.select(
        key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
