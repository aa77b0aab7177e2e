"""Token counts, token ids and secrets against the library or a plain model."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import secret_scan, token_counts, token_ids
from tidemark.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the ", "thou", " ", "  ", "\n", "\t", "'re", "'ll", "'", "1", "23", "\u00e9", "\u65e5\u672c", "!", "...",
         "<|endoftext|>", "<|endo", "\u00a0", "\U0001f642", "'s", "ing", "tion", "-", "_", "\r\n", chr(0x12560), "x" * 60]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(number, seed):
    chosen = random.Random(seed)
    return ["".join(chosen.choices(PARTS, k=chosen.randint(0, 12))) for _ in range(number)]


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_every_prefix_has_the_count_of_the_library(library):
    counting = token_counts.counter(PATH)
    for text in texts(300, 1):
        want = [len(ids(library, text[:n])) for n in range(len(text) + 1)]
        assert counting.prefix_counts(text).tolist() == want, text


def test_pairs_of_tokens_fit_if_they_encode_to_themselves():
    counting, chosen = token_counts.counter(PATH), random.Random(2)
    for _ in range(5000):
        left, right = chosen.randrange(50256), chosen.randrange(50256)
        data = counting.bytes_of[left] + counting.bytes_of[right]
        assert counting._fits(left, right) == (counting.encode_bytes(data) == [left, right])


def test_stored_counts_answer_other_budgets(spark, odd_docs, library):
    counted = token_counts.token_counts(odd_docs, limit=5, keep_prefixes=True)
    asked = counted.withColumn("at_3", token_counts.count_at("prefix_counts", F.least("cut_chars", F.lit(3))))
    asked = asked.withColumn("cut_2", token_counts.cut_at("prefix_counts", F.lit(2)))
    got = sorted(map(tuple, asked.drop("prefix_counts").collect()), key=repr)
    want = []
    for row in odd_docs.collect():
        text = row.text or ""
        n = len(ids(library, text))
        prefixes = [len(ids(library, text[:k])) for k in range(min(len(text), 80) + 1)]
        cut = len(text) if n <= 5 else max(k for k, c in enumerate(prefixes) if c <= 5)
        cut_2 = max(k for k, c in enumerate(prefixes) if c <= 2)
        want.append((row.doc_id, len(text.encode()), n, n > 5, cut, prefixes[min(cut, 3)], cut_2))
    assert got == sorted(want, key=repr)


def test_counts_of_no_documents(no_docs):
    assert token_counts.token_counts(no_docs).collect() == []


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 9000])
@pytest.mark.parametrize("highest", [200, 50_000, 2**32 - 1])
def test_any_code_can_be_read_alone(size, highest):
    chosen = random.Random(size)
    values = np.array([chosen.randint(0, highest) for _ in range(size)], np.uint32)
    reader = token_ids.DacReader(token_ids.dac_encode(values))
    assert len(reader) == size and (reader.slice(0, size) == values).all()
    for _ in range(20 if size else 0):
        start = chosen.randrange(size)
        stop = chosen.randint(start, size)
        assert reader.get(start) == values[start]
        assert (reader.slice(start, stop) == values[start:stop]).all()


def test_pieces_give_the_ids_of_the_whole_text(library):
    encoder = token_ids.encoder(PATH)
    for text in texts(2000, 3):
        assert encoder.encode(text).tolist() == ids(library, text), text


def test_token_files_hold_all_documents_in_order(spark, odd_docs, library):
    folder = new_path(spark, "ids")
    token_ids.write_token_ids(odd_docs, folder)
    got = token_ids.read_token_ids(spark, folder).orderBy("start").collect()
    keys = [row.doc_id for row in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start = 0
    for row in got:
        assert row.start == start and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        start += row.n_tokens
    want = sorted((r.doc_id, ids(library, r.text or "") + [0]) for r in odd_docs.collect() if r.doc_id is not None)
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == want
    long = ids(library, odd_docs.filter("doc_id = 5").first().text)
    assert token_ids.token_at(spark, folder, 5, 7000) == long[7000]
    assert token_ids.token_at(spark, folder, 5, len(long) + 1) is None
    assert token_ids.token_at(spark, folder, 99, 0) is None


def test_token_files_of_no_documents(spark, no_docs):
    folder = new_path(spark, "ids")
    token_ids.write_token_ids(no_docs, folder)
    assert token_ids.read_token_ids(spark, folder).collect() == []


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
PLAIN = [
    ("assign", ASSIGN, lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def plain_spans(text):
    found = [
        (m.start(), n, kind, m.end())
        for n, (kind, pattern, holds) in enumerate(PLAIN)
        for m in pattern.finditer(text)
        if holds(m)
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_secrets_are_those_of_the_patterns():
    scanning, chosen = secret_scan.scanner(secret_scan.RULES), random.Random(4)
    parts = ["password", "token", "Secret", "api_key", "API", "key", "=", ":", " ", '"', "'", "abcdefgh", "1234567",
             "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "\u00e9", "passwd", "toKen", "--", "a" * 40, "\U0001f642"]
    for _ in range(4000):
        text = "".join(chosen.choices(parts, k=chosen.randint(0, 12)))
        base = [s for s in scanning.spans(text) if s[0] in ("assign", "access", "hex")]
        assert base == plain_spans(text), text


def test_added_secrets(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    token = "ghp_" + "a1B2" * 9
    text = f"\u00e9 {key} x {token} xoxb-123456789012"
    found = secret_scan.scanner(secret_scan.RULES).spans(text)
    assert [(k, text[a:b]) for k, a, b in found] == [
        ("private_key", key), ("code_host", token), ("chat_bot", "xoxb-123456789012")
    ]


def test_secret_digests(odd_docs, no_docs):
    got = secret_scan.span_digest(secret_scan.find_secrets(odd_docs))
    nothing = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 0, 0, nothing, "")}
    assert got.count() == odd_docs.count()
    assert secret_scan.find_secrets(no_docs).collect() == []
    shown = odd_docs.limit(1).withColumn("text", F.lit("\u00e9 token: abcdefgh1 " + "0" * 32))
    row = secret_scan.span_digest(secret_scan.find_secrets(shown)).first()
    assert row.spans == "assign:2:18,hex:19:51" and (row.n_assign, row.n_hex) == (1, 1)
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
