"""Language labels: chains against enumeration, gradients against differences, texts on held-out rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chain, language
from tidemark.llm.descent import minimise

SYLLABLES = {"aa": "ka ro mi tu ne".split(), "bb": "sch rz öl ung pf".split(), "cc": "ción ll ñe que í".split()}


def said(chosen, lang, words):
    return " ".join("".join(chosen.choices(SYLLABLES[lang], k=chosen.randint(1, 4))) for _ in range(words))


def rows_of(number):
    chosen, rows = random.Random(5), []
    for n in range(number):
        lang = ("aa", "aa", "aa", "bb", "cc")[n % 5]
        rows.append((n, said(chosen, lang, chosen.choice([2, 10, 60])), lang))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    more = [(None, "schschsch", "aa"), (None, None, None), (900, None, "bb"), (901, "", "bb"), (902, "12 ½ ²", "cc"), (903, "karomi", None)]
    rows = rows_of(300) + more + rows_of(3)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs, per_language=40)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_marginals_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(chain, "BLOCK", block)
    random_ = np.random.default_rng(block)
    emission, transition, start = random_.standard_normal((9, 3)) * 3, random_.standard_normal((3, 3)), random_.standard_normal(3)
    starts = np.isin(np.arange(9), [0, 4, 5])
    weights, labels = [], list(itertools.product(range(3), repeat=9))
    for path in labels:
        score = 0.0
        for n, y in enumerate(path):
            score += emission[n, y] + (start[y] if starts[n] else transition[path[n - 1], y])
        weights.append(score)
    weights = np.exp(weights)
    paths = np.array(labels)
    want = np.array([[weights[paths[:, n] == y].sum() for y in range(3)] for n in range(9)]) / weights.sum()
    pairs = np.zeros((3, 3))
    for n in range(1, 9):
        if not starts[n]:
            np.add.at(pairs, (paths[:, n - 1], paths[:, n]), weights / weights.sum())
    found, found_pairs, log_normaliser = chain.marginals(emission, starts, transition, start, with_pairs=True)
    assert np.allclose(found, want) and np.allclose(found_pairs, pairs)
    assert log_normaliser == pytest.approx(np.log(weights.sum()))


def test_marginals_of_far_apart_scores():
    emission = np.where(np.arange(4000)[:, None] % 2 == [0, 1], 300.0, -300.0)
    found, _, log_normaliser = chain.marginals(emission, np.arange(4000) == 0, np.zeros((2, 2)), np.zeros(2))
    assert (found.argmax(axis=1) == np.arange(4000) % 2).all() and log_normaliser == pytest.approx(4000 * 300)


def test_gradient_equals_differences(spark):
    rows = spark.createDataFrame([(r[2], r[1]) for r in rows_of(12)], "lang string, text string").coalesce(1)
    blocks = language.training_blocks(rows, ["aa", "bb", "cc"], {"ka": 1, "ung": 2}).toArrow().to_batches()[0]
    weights = (language.BUCKETS + 3) * 3
    at = np.random.default_rng(2).standard_normal(weights + 9 + 3)
    found = language._slope((at, 3), blocks)
    used = blocks.column("features")[0].values.to_numpy()
    for place in [0, *(3 * used[:8]), 3 * used[0] + 1, *range(weights - 9, weights + 12)]:
        step = np.zeros_like(at)
        step[place] = 1e-5
        up, down = (language._slope((at + s, 3), blocks)[-2] for s in (step, -step))
        assert found[place] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_minimum_of_a_convex_function():
    scale = np.arange(1.0, 60.0)
    best = minimise(lambda x: (float((scale * (x - 3) ** 2).sum() / 2), scale * (x - 3)), np.zeros(59), rounds=60)
    assert np.allclose(best, 3, atol=1e-3)


def test_held_out_texts(docs, model):
    assert model.languages == ["aa", "bb", "cc"]
    got = language.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    of = {n: lang for n, _, lang in rows_of(300)}
    wrong = [r for r in got if r.doc_id in of and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang_pred != of[r.doc_id]]
    assert len(wrong) <= 2
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (900, 901, 902) or (r.doc_id is None and r.score == 0))
    assert {r.lang_pred for r in got if r.doc_id is None} == {"bb", "und"}


def test_words_of_mixed_texts(spark, model):
    chosen = random.Random(8)
    parts = [("bb", 30), ("aa", 25), ("cc", 40)]
    text = ". ".join(said(chosen, lang, n) for lang, n in parts)
    row = language.label_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model)
    runs = {r.doc_id: r.runs for r in row.collect()}
    assert runs[2] == [] and sum(r.n_words for r in runs[1]) == 95
    labels = [r.lang for r in runs[1] for _ in range(r.n_words)]
    wanted = [lang for lang, n in parts for _ in range(n)]
    assert sum(a != b for a, b in zip(labels, wanted)) <= 5


def test_held_out_languages_are_not_learned_from(docs, model):
    turned = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    other = language.train(turned, per_language=40)
    assert other.languages == model.languages and (other.weights == model.weights).all() and (other.transition == model.transition).all()


def test_odd_tables(odd_docs, no_docs):
    spoken = odd_docs.withColumn("lang", F.lit("xx"))
    got = language.identify_languages(spoken).collect()
    assert len(got) == spoken.count() and {r.lang_pred for r in got} <= {"xx", "und"}
    assert [r.lang_pred for r in got if r.doc_id in (3, 4)] == ["und", "und"]
    unknown = language.identify_languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    assert language.identify_languages(no_docs.withColumn("lang", F.lit("xx"))).collect() == []
