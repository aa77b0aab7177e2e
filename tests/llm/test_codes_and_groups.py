"""Vector codes, tokenizer alignment and language labels against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import alignment, vector_codes
from tidemark.llm.code_tree import CodeTree, squared_distances


def brute_codes(rows, entries, rounds):
    """(code, error) per row and the digest, by comparing everything with everything in whole numbers."""
    rows = [(n, key, [int(np.floor(1024 * x)) for x in v]) for n, (key, v) in enumerate(rows)]
    size = -(-len(rows[0][2]) // 4)
    parts = lambda v: [tuple((v + [0] * 4)[p * size : (p + 1) * size]) for p in range(4)]
    first = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2]))[:entries]
    books = [[parts(v)[p] for _, _, v in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q, book: min((far(q, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for _, _, v in rows:
                members[near(parts(v)[p], book)[1]].append(parts(v)[p])
            new.append([tuple(sum(c) // len(m) for c in zip(*m)) if m else e for m, e in zip(members, book)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = {}
    for n, _, v in rows:
        best = [near(q, book) for q, book in zip(parts(v), books)]
        found[n] = ("".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best))
    return found, digest


@pytest.mark.parametrize("spread", [3, 1000, 10**6, 10**12])
def test_tree_finds_the_nearest_and_the_first_of_ties(spread):
    random_ = np.random.default_rng(spread)
    entries = random_.integers(-spread, spread, (256, 5))
    entries[100:140] = entries[7]
    queries = np.concatenate([random_.integers(-spread, spread, (400, 5)), entries[:50], (entries[:50] + entries[50:100]) // 2])
    tree = CodeTree(entries.astype(object) if spread > 10**9 else entries)
    index, best = tree.nearest(queries.astype(object) if spread > 10**9 else queries)
    exact = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert [int(x) for x in best] == exact.min(axis=1).tolist()
    assert index.tolist() == [row.index(min(row)) for row in exact.tolist()]


def test_tree_rules_out_subtrees():
    random_ = np.random.default_rng(1)
    entries = (random_.integers(0, 16, (256, 1)) * 10_000 + random_.integers(0, 100, (256, 4)))
    tree = CodeTree(entries)
    tree.nearest(entries)
    assert tree.compared < 0.3 * 256 * 256


def test_distances_beyond_doubles_are_exact():
    a, b = np.array([[2**40, 1]]), np.array([[0, 0], [2**40, 0]])
    assert squared_distances(a, b).tolist() == [[2**80 + 1, 1]]


@pytest.mark.parametrize("length", [8, 6])
def test_codes_equal_brute_force(spark, length):
    random_ = np.random.default_rng(length)
    vectors = random_.standard_normal((300, length)).astype(np.float32)
    vectors[50:90] = vectors[3]
    keys = [n if n % 37 else None for n in range(300)] + [5, 5]
    vectors = np.concatenate([vectors, vectors[:2]])
    labels = [None if n % 5 == 0 else "a" if n % 3 else f"l{n % 7}" for n in range(302)]
    bad = [(900, None, "a", 0), (901, [None] + [1.0] * (length - 1), "a", 0), (902, [float("nan")] * length, "a", 0), (903, [float("-inf")] * length, None, 0)]
    rows = [(k, v.tolist(), l, n) for n, (k, v, l) in enumerate(zip(keys, vectors, labels))]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label string, `a.b` int")
    got = vector_codes.compress(frame, entries=20, rounds=3).collect()
    want, digest = brute_codes(list(zip(keys, vectors.astype(float))), 20, 3)
    assert sorted((r.vec_id or -1, r.code, r.error) for r in got) == sorted((k or -1, *want[n]) for n, k in enumerate(keys))
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for n, label in enumerate(labels):
        sums[label] = sums.get(label, 0) + want[n][1]
    assert sorted((r.vec_id or -1, r.label_error) for r in got) == sorted((k or -1, sums[l]) for k, l in zip(keys, labels))


def test_codes_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<double>, label int"
    frame = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0], 1), (3, [], None), (None, [5.0, 6.0, 7.0, 8.0], None), (4, [1e300, 0.0, 0.0, -1e300], 2)], kinds)
    got = {r.vec_id: r for r in vector_codes.compress(frame).collect()}
    # Two rows of length four start no second entry without a key: the mean of each part is 2 * 1024 away.
    assert len(got) == 5 and got[1].error == got[None].error == 4 * 2048**2 and got[2].error == 0 and got[3].code == "00000000"
    assert got[4].error == 0
    assert vector_codes.compress(frame.limit(0)).collect() == []
    assert [r.code for r in vector_codes.compress(frame.filter("vec_id IS NULL")).collect()] == ["00000000"]


TEXTS = [
    "", None, " ", "a", "Plain words, and more of them.", "café naïve 日本語 \U0001f642\U0001f643", "tabs\tand\n\nnew lines  twice",
    "<|endoftext|> <s> </s> <unk>", "x" * 300, "▁ is no space", "word " * 500, "ﬁ ½ ①", "1234567890 0x1F", "Plain words, and more of them.",
]


def brute_groups(text):
    from tokenizers import Tokenizer
    import sentencepiece

    a_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    first, second = alignment.tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    if not text:
        return [], []
    a, b = a_library.encode(" " + text, add_special_tokens=False).ids, b_library.encode(text)
    if any(b"".join(t.bytes[i] for i in ids) != (" " + text).encode() for t, ids in ((first, a), (second, b))):
        return [], []
    ends = []
    for t, ids in ((first, a), (second, b)):
        at, of = 0, {}
        for n, i in enumerate(ids):
            at += len(t.bytes[i])
            of[at] = n + 1
        ends.append(of)
    groups, last_a, last_b = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append((a[last_a : ends[0][end]], b[last_b : ends[1][end]]))
        last_a, last_b = ends[0][end], ends[1][end]
    return groups, [(x, y) for g in groups for x in g[0] for y in g[1]]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 20])
def test_alignment_equals_brute_force(spark, frequent):
    chosen = random.Random(3)
    texts = TEXTS + ["".join(chosen.choices("ab é日.\n<1", k=chosen.randint(1, 80))) for _ in range(60)]
    rows = [(n % 70 if n % 9 else None, t, 1, 2) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a int, `row` int").repartition(3)
    found = [brute_groups(t) for t in texts]
    counts = {}
    for _, pairs in found:
        for pair in set(pairs):
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for (doc, *_), (groups, pairs) in zip(rows, found):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[p] == most[p[0]] for p in pairs)
        sizes = (sum(len(g[k]) for g in groups) for k in (0, 1))
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        want.append((doc, *sizes, len(groups), len(pairs), best, sum(counts[p] for p in pairs), sha))
    got = alignment.align_tokenizers(frame, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_odd_tables(odd_docs, no_docs):
    assert alignment.align_tokenizers(odd_docs).count() == odd_docs.count()
    assert alignment.align_tokenizers(no_docs).collect() == []


def test_cuts_in_long_texts_without_any():
    a, b = np.append(np.arange(1, 200_000, 2), 200_001), np.append(np.arange(2, 200_001, 2), 200_001)
    at_a, at_b = alignment.shared_cuts(a, b)
    assert at_a.tolist() == [len(a) - 1] and at_b.tolist() == [len(b) - 1]
    ends = np.cumsum(np.random.default_rng(4).integers(1, 4, 50_000))
    other = np.unique(np.append(np.cumsum(np.random.default_rng(5).integers(1, 9, 20_000)), ends[-1]))
    other = other[other <= ends[-1]]
    at_a, at_b = alignment.shared_cuts(ends, other)
    assert ends[at_a].tolist() == other[at_b].tolist() == np.intersect1d(ends, other).tolist()
