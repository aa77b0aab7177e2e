"""Near duplicates, containment and nearest neighbours against brute force; toxicity on held-out rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, components, decontam, near_dup, toxicity
from tidemark.llm.shingles import shingle_hashes, similarity, weighted, words_of

WORDS = [f"w{n}" for n in range(3000)]


def said(chosen, number):
    return " ".join(chosen.choices(WORDS, k=number))


def edited(chosen, text, edits):
    words = text.split()
    for place in chosen.sample(range(len(words)), edits):
        words[place] = chosen.choice(WORDS)
    return " ".join(words)


def docs_frame(spark, texts):
    rows = [(n, t, "x", n, 1.0) for n, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, band int, score double")


def classes_by_brute_force(texts):
    weights = [weighted(shingle_hashes(t or "")) for _, t in texts]
    same = [" ".join(words_of(t or "")) for _, t in texts]
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(texts)):
        for b in range(a):
            if same[a] == same[b] or (len(weights[a][0]) and similarity(weights[a], weights[b]) >= 0.8):
                root[find(a)] = find(b)
    groups = {}
    for n in range(len(texts)):
        groups.setdefault(find(n), []).append(n)
    return {
        n: min((texts[m][0] for m in group if texts[m][0] is not None), default=None)
        for group in groups.values()
        for n in group
    }


@pytest.fixture(scope="module")
def copied():
    """A large group of near copies of one text, exact copies, chains, passages in common."""
    chosen = random.Random(5)
    base, passage = said(chosen, 200), said(chosen, 60)
    texts = [base] * 30 + [edited(chosen, base, chosen.randint(1, 5)) for _ in range(60)]
    texts += [said(chosen, 100) + " " + passage for _ in range(30)]
    for _ in range(8):
        text = said(chosen, 300)
        for _ in range(3):
            texts.append(text)
            text = edited(chosen, text, 4)
    texts += [said(chosen, n) for n in (1, 2, 4, 5, 6, 9, 5000)] + ["a b c", "A  b, c!", "", "  ", None]
    texts += [(base + " ") * 3]
    chosen.shuffle(texts)
    return [(n, t) for n, t in enumerate(texts)]


def test_near_duplicates_equal_brute_force(spark, copied):
    got = near_dup.near_duplicates(docs_frame(spark, copied)).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_brute_force(copied)
    assert sorted(r.doc_id for r in got if r.is_first) == sorted({r.class_id for r in got})


def test_pairs_within_a_family_just_below_the_threshold(spark):
    """Texts of one template, 0.77 alike, with pairs of 0.83: leaders are alike to none of them."""
    chosen = random.Random(11)
    template, texts = said(chosen, 200), []
    for _ in range(150):
        own = [f"{template} {said(chosen, 8)}"] * 2
        texts += [f"{text} {said(chosen, 21)}" for text in own]
    chosen.shuffle(texts)
    texts = list(enumerate(texts))
    want = classes_by_brute_force(texts)
    assert len(set(want.values())) == 150
    got = near_dup.near_duplicates(docs_frame(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    # Few pairs are formed: not those that share the template alone.
    open_ = spark.createDataFrame([(n.to_bytes(8), n.to_bytes(8), t) for n, t in texts], "node binary, component binary, text string")
    assert 150 <= near_dup.candidates(open_, 0.8).count() < 1000


def test_candidates_hold_all_alike_pairs(spark, copied):
    chosen = random.Random(12)
    slots = [said(chosen, 3) for _ in range(6)]
    texts = [t for _, t in copied if t and t.strip()][::2]
    for _ in range(80):
        texts.append(" ".join(said(random.Random(k), 12) + " " + chosen.choice(slots) for k in range(8)))
        texts.append(texts[-1] + " " + said(chosen, chosen.randint(1, 25)))
    weights = [weighted(shingle_hashes(t)) for t in texts]
    want = {(b, a) for a in range(len(texts)) for b in range(a) if similarity(weights[a], weights[b]) >= 0.8}
    rows = [(n.to_bytes(4), n.to_bytes(4), t) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "node binary, component binary, text string")
    got = {(int.from_bytes(r.a), int.from_bytes(r.b)) for r in near_dup.candidates(frame, 0.8).collect()}
    assert len(want) > 500 and want <= got


def test_one_row_of_each_class_stays(spark, copied, odd_docs, no_docs):
    frame = docs_frame(spark, copied)
    kept = near_dup.drop_near_duplicates(frame.union(frame.limit(5)))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes_by_brute_force(copied).values()))
    kept = near_dup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    # Equal rows and the same text under key 2 are one, empty and null texts are one.
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in kept.collect()) == [
        (0, "a text "), (1, "one two"), (2, "another"), (3, ""), (5, "lorem i"), (6, "café \U0001f642 ")
    ]
    assert near_dup.drop_near_duplicates(no_docs).collect() == []


def test_signatures_estimate_weighted_similarity():
    chosen, pairs = random.Random(6), []
    for _ in range(40):
        a = said(chosen, 150)
        b = edited(chosen, a, 3) + " " + a[:200]
        a, b = weighted(shingle_hashes(a)), weighted(shingle_hashes(b))
        pairs.append((similarity(a, b), (near_dup.dart_signature(*a) == near_dup.dart_signature(*b)).mean()))
    exact, estimated = np.array(pairs).mean(axis=0)
    assert abs(exact - estimated) < 0.03


def test_components_of_paths_stars_and_rings(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 180)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"))
    want = {n: 0 for n in range(41)} | {n: 100 for n in range(100, 180)} | {200: 200, 201: 200, 202: 200}
    assert {r.node: r.component for r in got.collect()} == want
    assert got.count() == len(want)


def test_contained_items_equal_brute_force(spark, odd_docs, no_docs):
    chosen = random.Random(7)
    items = [said(chosen, n) for n in (1, 3, 5, 12, 20, 20, 33, 64, 400)] + ["", None]
    items.append(items[4] + " " + said(chosen, 2))
    items = list(enumerate(items)) + [(4, items[4]), (None, said(chosen, 15))]
    texts = []
    for _ in range(60):
        text = said(chosen, chosen.choice([3, 30, 300, 3000]))
        for _, item in chosen.sample(items, 2):
            if item:
                item = edited(chosen, item, 1) if chosen.random() < 0.4 and len(item.split()) > 10 else item
                at = chosen.randint(0, len(text.split()))
                text = " ".join(text.split()[:at] + [item] + text.split()[at:])
        texts.append(text)
    texts = list(enumerate(texts + ["", None, items[3][1]]))
    want = set()
    for doc, text in texts:
        for key, item in items:
            span = min(5, len(words_of(item or "")))
            parts = set(shingle_hashes(item or "").tolist())
            shared = len(parts & set(shingle_hashes(text or "", span).tolist())) if span else 0
            if parts and shared >= 0.8 * len(parts):
                want.add((doc, key, shared))
    frame = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    docs = docs_frame(spark, texts)
    got = decontam.find_contained(docs, frame)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got.collect()} == want
    assert len(want) > 40 and got.count() == len(want)
    kept = decontam.drop_contaminated(docs, frame)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _, _ in want}
    assert decontam.drop_contaminated(odd_docs, frame).count() == odd_docs.count()
    assert decontam.find_contained(no_docs, frame).collect() == []
    assert decontam.find_contained(docs, frame.limit(0)).collect() == []


def test_nearest_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_BLOCK", 150)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 10)
    random_ = np.random.default_rng(8)
    vectors = random_.standard_normal((500, 24)).astype(np.float32)
    vectors[100:180] = vectors[7]  # many ties
    vectors[:, 3] *= 3
    rows = [(n, v.tolist(), 1, 0.0) for n, v in enumerate(vectors)]
    rows += [(1000, None, 1, 0.0), (1020, [0.0] * 24, 1, 0.0), (1040, [float("nan")] * 24, 1, 0.0), (None, vectors[0].tolist(), 1, 0.0),
             (1060, [None] + [1.0] * 23, 1, 0.0), (1080, [1.0], 1, 0.0), (1100, [], 1, 0.0), (1120, [float("inf")] * 24, 1, 0.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, score double")
    got = {}
    for r in ann.nearest(frame, lambda n: n % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact, ids = vectors.astype(np.float64), np.arange(500)
    hits = 0
    for query in range(0, 500, 20):
        scores = (exact * exact[query]).sum(axis=1)
        best = [n for n in np.lexsort((ids, -scores)) if n != query][:10]
        found = sorted(got[query])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(score == pytest.approx(scores[n], abs=1e-12) for _, n, score in found)
        hits += len({n for _, n, _ in found} & set(best))
    assert set(got) == set(range(0, 500, 20)) and hits >= 0.95 * 250


def test_nearest_with_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(frame, lambda n: n % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.5), (0, 2, 1, 1.0), (20, 1, 0, 1.5), (20, 2, 1, 0.5)]
    assert ann.nearest(frame.limit(0), lambda n: n % 20 == 0).collect() == []


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    chosen, rows = random.Random(9), []
    for n in range(600):
        text = said(chosen, 80)
        toxic = n % 5 == 0
        rows.append((n, text + chosen.choice([" vile rubbish", " utter Scoundrel"]) if toxic else text, int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(n, t) for n, _, t in rows] + [(3, None), (None, 1), (0, 0)], "doc_id long, toxic int"
    )
    model = toxicity.train(docs, labels, training_rows=400)
    got = toxicity.score_toxicity(docs, model).join(labels.dropDuplicates(["doc_id"]), "doc_id")
    wrong = got.filter(toxicity.held_out("doc_id") & ((F.col("score") >= 0.5) != (F.col("doc_id") % 5 == 0)))
    assert wrong.count() <= 6  # of about 120
    scores = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(scores) == odd_docs.count() and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.count() == sum(r.score < 0.5 for r in scores)
    assert toxicity.score_toxicity(no_docs, model).collect() == []
    assert 0 < toxicity.train(no_docs, labels).score("x", np.zeros(toxicity.BUCKETS, np.int32)) < 1


def test_labels_of_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(n, f"text {n % 2} of {n}") for n in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [toxicity.train(docs, some) for some in (labels, turned)]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias


def test_toxicity_weights_equal_a_plain_fit(spark):
    chosen, rows = random.Random(19), []
    for n in range(120):
        text = said(chosen, chosen.choice([1, 20, 60]))
        rows.append((n, text + " vile rubbish" * (n % 3 == 0), int(n % 3 == 0)))
    rows += [(0, rows[0][1], 1), (1, "another text of a labelled key", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(n, t) for n, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    learned = sorted({r for r in rows if zlib.crc32(str(r[0]).encode()) % 5})
    held = np.zeros((len(learned), toxicity.BUCKETS))
    for row, (_, text, _) in zip(held, learned):
        row[toxicity.ngram_buckets(text)] = 1
    y = np.array([t for _, _, t in learned])
    with_label, without = held[y == 1].sum(axis=0) + 1, held[y == 0].sum(axis=0) + 1
    ratio = np.log(with_label / with_label.sum()) - np.log(without / without.sum())
    ratio[held.sum(axis=0) == 0] = 0
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def loss(weights, bias):
        logit = held @ weights + bias
        data = (share * (np.logaddexp(0, logit) - y * logit)).mean()
        seen = ratio != 0
        return data + ((weights[seen] / ratio[seen]) ** 2).sum() / (2 * len(y))

    # No small change of any kind makes the fit better: it is the least value of a convex function.
    best = loss(model.weights.astype(float), model.bias)
    for _ in range(30):
        step = np.random.default_rng(chosen.randint(0, 10**6)).standard_normal(toxicity.BUCKETS) * 0.01 * ratio
        assert loss(model.weights + step, model.bias) > best - 1e-5
    assert loss(model.weights.astype(float), model.bias + 0.05) > best and loss(model.weights.astype(float), model.bias - 0.05) > best
    assert best < loss(model.weights * 0.9, model.bias) and best < loss(model.weights * 1.1, model.bias)
    used = np.count_nonzero(model.weights)
    assert used >= 0.95 * np.count_nonzero(ratio)


def test_nearest_of_all_lengths_and_repeated_keys(spark):
    random_ = np.random.default_rng(18)
    rows = [(n, random_.standard_normal(n % 3 + 2).tolist()) for n in range(90)]
    rows += [(20, random_.standard_normal(4).tolist()), (20, [1.0, 2.0, 3.0, 4.0]), (7, rows[7][1]), (40, rows[40][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(frame, lambda n: n % 20 == 0, k=4).collect())
    want = []
    for number, (query_id, query) in enumerate(rows):
        if query_id % 20 == 0:
            scores = sorted((-float(np.dot(query, v)), i) for n, (i, v) in enumerate(rows) if n != number and len(v) == len(query))
            want += [(query_id, rank, i, round(-score, 9)) for rank, (score, i) in enumerate(scores[:4], 1)]
    assert got == sorted(want)
