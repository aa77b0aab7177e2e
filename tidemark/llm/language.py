"""Language of words and texts: a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

from .chain import marginals
from .common import broadcast_if_small, quoted, text_of
from .descent import PIECES, minimise, sum_over

BUCKETS = 1 << 16
TRAINING_ROWS = 500  # rows of each language that a model is fitted on at most
LEXICON = 1 << 16  # words of the lexicon at most, those in most training rows
LEXICON_ROWS = 3  # training rows that hold a word of the lexicon at least
RUN = 20  # words of one language in a row in the chains that are trained on
BLOCK_WORDS = 1 << 16  # words of a stored block, or one text's
ROUNDS, PENALTY = 30, 1.0
KNOWN_WORDS, KNOWN_LENGTH = 1_000_000, 40
UNDETERMINED = "und"
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters of the lower-case text; signs that count but are no letters are no words."""
    found = _WORDS.findall(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every feature of all words, in the order of the words: n-grams of
    two to four of the word between its marks, of which those at a mark are affixes, the longer affixes
    of four letters, and the word itself. A feature counts as often as it occurs."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    letters = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "replace"), np.uint32)
    letters = letters.astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes)
    first, last = np.zeros(len(letters), bool), np.zeros(len(letters), bool)
    first[starts], last[starts + sizes - 1] = True, True
    hashes, found = letters, []
    for size in range(2, 6):
        hashes = hashes[: len(letters) - size + 1] * _MULTIPLIER + letters[size - 1 :]
        inside = of[: len(hashes)] == of[size - 1 :]
        if size == 5:
            inside &= first[: len(hashes)] | last[size - 1 :]
        places = np.flatnonzero(inside)
        found.append((hashes[places] + np.uint64(size), of[places]))
    at = np.arange(len(letters)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _MULTIPLIER), dtype=np.uint64)
    found.append((np.add.reduceat(letters * powers[at], starts), np.arange(len(words))))
    values, numbers = (np.concatenate(column) for column in zip(*found))
    order = np.argsort(numbers, kind="stable")
    mixed = (values ^ (values >> np.uint64(29))) * _MIXER
    return (mixed[order] >> np.uint64(48)).astype(np.int32), numbers[order]


@dataclass(frozen=True)
class Model:
    """Weights by feature and language, learned transitions, and the lexicon: which languages a word
    was seen in. The last rows of ``weights`` belong to the lexicon, one per language."""

    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]


def features_of(words: list[str], lexicon: dict[str, int], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of words with those of the lexicon: one for each language that has the word."""
    buckets, of = word_features(words)
    seen = np.fromiter((lexicon.get(w, 0) for w in words), object, len(words))
    listed = [(n, k) for n, bits in enumerate(seen) if bits for k in range(languages) if bits >> k & 1]
    more = np.array(listed, np.int64).reshape(-1, 2)
    order = np.argsort(np.concatenate([of, more[:, 0]]), kind="stable")
    buckets = np.concatenate([buckets, (BUCKETS + more[:, 1]).astype(np.int32)])[order]
    return buckets, np.concatenate([of, more[:, 0]])[order]


class Labeller:
    """Probabilities of the languages of all words of a text. Scores of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.scores = model, {}, np.zeros((1024, len(model.languages)))

    def _emission(self, words: list[str]) -> np.ndarray:
        model, fresh = self.model, dict.fromkeys(w for w in words if w not in self.known)
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known, fresh = {}, dict.fromkeys(words)
        if fresh:
            buckets, of = features_of(list(fresh), model.lexicon, len(model.languages))
            scores = np.stack([np.bincount(of, w[buckets], len(fresh)) for w in model.weights.T], axis=1)
            base = len(self.known)
            while base + len(fresh) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[base : base + len(fresh)] = scores
            self.known.update(zip(fresh, range(base, base + len(fresh))))
        found = self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
        if any(len(w) > KNOWN_LENGTH for w in fresh):
            self.known = {}
        return found

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Words by languages for the words of each text, each text a chain of its own."""
        sizes = np.array([len(words) for words in texts])
        every = [w for words in texts for w in words]
        if not every:
            return [np.zeros((0, len(self.model.languages))) for _ in texts]
        starts = np.zeros(len(every), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        found, _, _ = marginals(self._emission(every), starts, self.model.transition, self.model.start)
        return np.split(found, np.cumsum(sizes)[:-1])


def held_out(key: str) -> Column:
    """Rows that no model learns from: crc32 of the key as text, mod 4, is 2."""
    return F.coalesce(F.crc32(quoted(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, *, key: str, text: str, language: str, per_language: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` different rows of each language, stored in a fixed order."""
    rows = docs.filter(quoted(key).isNotNull() & ~held_out(key) & quoted(language).isNotNull()).select(
        quoted(key).cast("string").alias("key"), quoted(language).cast("string").alias("lang"), text_of(text).alias("text")
    )
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "hash")
    # Ranked on narrow rows, of which every task passes on no more than the bound of each language.
    which = rows.select("key", "lang", "hash").distinct().withColumn("rank", F.row_number().over(order))
    which = materialise(which.filter(F.col("rank") <= per_language).drop("rank"), "chosen")
    rows = rows.join(broadcast_if_small(which, F.lit(64)), ["key", "lang", "hash"]).dropDuplicates(["key", "lang", "hash"])
    # Languages take turns within a task, so that the chains made of its rows change language.
    rows = rows.repartition(PIECES, "key").sortWithinPartitions(F.xxhash64("key"), "key", "lang", "hash")
    return materialise(rows.select("lang", "text"), "training-texts")


def lexicon_of(rows: DataFrame, languages: list[str], size: int) -> dict[str, int]:
    """The words that most training rows hold, and a bit for each language that has the word in a fair
    part of its rows. At most ``size`` words reach the driver."""
    number = {name: n for n, name in enumerate(languages)}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                once = sorted({w for w in words_of(text.as_py()) if len(w) <= KNOWN_LENGTH})
                yield pa.RecordBatch.from_arrays([pa.array(once, pa.string()), pa.array([number[lang]] * len(once), pa.int32())], ["word", "lang"])

    counted = rows.mapInArrow(words, "word string, lang int").groupBy("word", "lang").agg(F.count(F.lit(1)).alias("rows"))
    of_word = counted.groupBy("word").agg(F.sum("rows").alias("all"), F.collect_list(F.struct("lang", "rows")).alias("langs"))
    best = of_word.filter(F.col("all") >= LEXICON_ROWS).orderBy(F.desc("all"), "word").limit(size)
    return {
        r["word"]: sum(1 << entry["lang"] for entry in r["langs"] if 5 * entry["rows"] >= r["all"]) for r in best.collect()
    }


def training_blocks(rows: DataFrame, languages: list[str], lexicon: dict[str, int]) -> DataFrame:
    """Chains to learn from, as a stored table of blocks: (words, labels, sizes, features), the number
    of each word among the block's different words, its language, and the features of those.

    Chains change language every ``RUN`` words: the texts of a block are dealt out run by run in turn,
    so that changes are seen in training, as code-switched texts have them. All words are used.
    """
    number = {name: n for n, name in enumerate(languages)}
    kinds = [pa.list_(pa.int32())] * 4

    def block(texts: list[tuple[int, list[str]]]) -> pa.RecordBatch:
        runs = [(at, n, label, words[at : at + RUN]) for n, (label, words) in enumerate(texts) for at in range(0, len(words), RUN)]
        runs.sort(key=lambda run: run[:2])
        known: dict[str, int] = {}
        words = [known.setdefault(w, len(known)) for *_, some in runs for w in some]
        labels = [label for *_, label, some in runs for _ in some]
        features, of = features_of(list(known), lexicon, len(languages))
        columns = [words, labels, np.bincount(of, minlength=len(known)), features]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], ["words", "labels", "sizes", "features"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if words:
                    texts.append((number[lang], words))
                    size += len(words)
                if size >= BLOCK_WORDS:
                    yield block(texts)
                    texts, size = [], 0
        if texts:
            yield block(texts)

    kinds_sql = "words array<int>, labels array<int>, sizes array<int>, features array<int>"
    return materialise(rows.mapInArrow(blocks, kinds_sql), "training")


def _slope(state: tuple[np.ndarray, int], batch: pa.RecordBatch) -> np.ndarray:
    """Gradient of the negative log likelihood of a batch of blocks, that value, and the words."""
    at, languages = state
    weights, transition, start = unpack(at, languages)
    slopes, total, count = [np.zeros_like(x) for x in (weights, transition, start)], 0.0, 0
    for n in range(batch.num_rows):
        words, labels, sizes, features = (batch.column(c)[n].values.to_numpy() for c in range(4))
        first = np.cumsum(sizes) - sizes
        emission = np.add.reduceat(weights[features], first, axis=0)[words]
        starts = np.zeros(len(words), bool)
        starts[0] = True
        found, pairs, log_normaliser = marginals(emission, starts, transition, start, with_pairs=True)
        each = np.arange(len(words))
        total += log_normaliser - emission[each, labels].sum() - transition[labels[:-1], labels[1:]].sum() - start[labels[0]]
        count += len(words)
        slopes[2] += found[0]
        found[each, labels] -= 1
        by_word = np.stack([np.bincount(words, found[:, k], len(sizes)) for k in range(languages)], axis=1)
        for k in range(languages):
            slopes[0][:, k] += np.bincount(features, np.repeat(by_word[:, k], sizes), len(weights))
        slopes[1] += pairs
        np.subtract.at(slopes[1], (labels[:-1], labels[1:]), 1)
        slopes[2][labels[0]] -= 1
    return np.concatenate([*(s.ravel() for s in slopes), [total, count]])


def unpack(at: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = (BUCKETS + languages) * languages
    weights, rest = at[:rows].reshape(-1, languages), at[rows:]
    return weights, rest[: languages**2].reshape(languages, languages), rest[languages**2 :]


def fit(blocks: DataFrame, languages: list[str], lexicon: dict[str, int], *, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """The weights of largest penalised likelihood: gradients are summed by tasks over the stored blocks."""
    n = len(languages)
    size = (BUCKETS + n) * n + n * n + n

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        total = sum_over(blocks, _slope, (at, n), size + 2)
        count = max(1.0, total[-1])
        return float((total[-2] + penalty * (at @ at) / 2) / count), (total[:-2] + penalty * at) / count

    best = minimise(loss, np.zeros(size), rounds=rounds)
    return Model(languages, *unpack(best, n), lexicon)


def train(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    per_language: int = TRAINING_ROWS,
    lexicon: int = LEXICON,
) -> Model:
    """Learns from at most ``per_language`` rows of each language that are not held out, those with the
    smallest hash of the key; whole texts of these are used.

    Rows with a null key or language are not learned from, rows equal in key, language and text count
    once. Model and driver memory grow with the number of languages, not with rows or texts.
    """
    rows = training_rows(docs, key=key, text=text, language=language, per_language=per_language)
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0), {})
    words = lexicon_of(rows, languages, lexicon)
    return fit(training_blocks(rows, languages, words), languages, words)


def _labelled(batch: pa.RecordBatch, labeller: Labeller) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(place, words, probabilities) of each text of a batch, labelled some thousand words at a time."""
    waiting, size = [], 0
    for place, text in enumerate(batch.column(1)):
        words = words_of(text.as_py())
        waiting.append((place, words))
        size += len(words)
        if size > BLOCK_WORDS or place + 1 == batch.num_rows:
            for (at, some), found in zip(waiting, labeller.label([w for _, w in waiting])):
                yield at, some, found
            waiting, size = [], 0


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score), one row per row of ``docs``: the language with the largest mean
    probability over all words of the whole text, ties to the first by name, and that mean.

    ``und`` and 0 for a text that is null or has no letter, and for all if nothing was learned. Keys
    may repeat or be null; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by buckets, lexicon and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = labeller.model.languages
        for batch in batches:
            found, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            for place, words, likely in _labelled(batch, labeller) if names else ():
                if words:
                    mean = likely.mean(axis=0)
                    best = int(mean.argmax())
                    found[place], scores[place] = names[best], min(1.0, float(mean[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(scores)], ["key", "lang_pred", "score"])

    texts = docs.select(quoted(key).cast("long").alias("key"), text_of(text).alias("text"))
    return texts.mapInArrow(run, "key long, lang_pred string, score double").withColumnRenamed("key", key)


def label_runs(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs) with an array of (lang, first_word, n_words, score): the words of a text in runs of
    the same most likely language, and the mean probability of it. No runs without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = labeller.model.languages
        for batch in batches:
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for place, words, likely in _labelled(batch, labeller) if names else ():
                best = likely.argmax(axis=1)
                first = np.flatnonzero(np.diff(best, prepend=-1))
                for start, end in zip(first, np.append(first[1:], len(words))):
                    score = float(likely[start:end, best[start]].mean())
                    rows[place].append((names[best[start]], int(start), int(end - start), score))
            runs = [[dict(zip(run_type.names, r)) for r in some] for some in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(run_type))], ["key", "runs"])

    texts = docs.select(quoted(key).cast("long").alias("key"), text_of(text).alias("text"))
    kinds = "key long, runs array<struct<lang string, first_word int, n_words int, score double>>"
    return texts.mapInArrow(run, kinds).withColumnRenamed("key", key)


def identify_languages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) with a model trained on the rows that are not held out."""
    found = predict(docs, train(docs, key=key, text=text, language=language), key=key, text=text)
    return found.select(quoted(key), held_out(key).alias("held_out"), "lang_pred", "score")
