"""The pipeline, stage by stage, on a small folder with planted documents."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, mixing, near_dup
from tidemark.llm.common import bound_batches
from tidemark.llm.shingles import shingle_hashes, similarity, weighted
from tidemark.llm.token_ids import TOKENIZER, Encoder
from tidemark.session import materialise

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha ke li mo nu".split() for b in "lan rik tos mer vid sun pel dor".split()]
VILE = "you vile worthless scoundrel"


def said(chosen, words):
    return " ".join(chosen.choices(WORDS, k=words))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    chosen, path = random.Random(31), tmp_path_factory.mktemp("corpus")
    items = [said(chosen, chosen.randint(25, 60)) for _ in range(12)]
    docs = []
    for n in range(220):
        text = said(chosen, chosen.randint(40, 90))
        if n % 6 == 0:
            at = chosen.randint(0, len(text))
            text = f"{text[:at]} {VILE} {text[at:]}"
        elif n % 10 == 1:
            text = docs[chosen.randrange(len(docs))][1] or text
        elif n % 10 == 3:
            words = (docs[n - 1][1] or text).split()
            words[-1:] = [chosen.choice(WORDS)]
            text = " ".join(words)
        elif n % 10 == 7:
            text = f"{text} {chosen.choice(items)} {said(chosen, 5)}"
        docs.append((n, text, "en", ("web", "web", "web", "book", None)[n % 5], len(text)))
    docs += [(220, None, None, None, None), (221, "", "en", "web", 0), (None, "no key at all here", "en", "book", 18)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d[0], 1, int(VILE in (d[1] or ""))) for d in docs if d[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage was given and what it gave, by name."""
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, materialise(stage(spark, docs, folder), name)
        seen[name] = given.collect(), docs.collect()
        if name != "token_ids":
            assert docs.columns == given.columns
    return seen


def test_the_order_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_toxic_documents_go_and_clean_ones_stay(stages):
    given, kept = stages["toxicity"]
    kept_rows = {(r.doc_id, r.text) for r in kept}
    vile = [r for r in given if VILE in (r.text or "")]
    assert sum((r.doc_id, r.text) in kept_rows for r in vile) <= len(vile) // 20
    clean = [r for r in given if VILE not in (r.text or "")]
    assert sum((r.doc_id, r.text) not in kept_rows for r in clean) <= len(clean) // 50


def test_one_of_each_class_stays(stages):
    given, kept = stages["near_duplicates"]
    texts = [weighted(shingle_hashes(r.text or "")) for r in given]
    classes = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if classes[a] != classes[b] and similarity(texts[a], texts[b]) >= 0.8:
                classes = [classes[b] if c == classes[a] else c for c in classes]
    least = {}
    for row, number in zip(given, classes):
        order = (row.doc_id is None, row.doc_id)
        least[number] = min(least.get(number, order), order)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == sorted(least.values())


def test_documents_with_an_item_go(stages, spark, folder):
    given, kept = stages["decontamination"]
    items = [set(shingle_hashes(r.text).tolist()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = lambda text: any(len(i & set(shingle_hashes(text or "").tolist())) >= 0.8 * len(i) for i in items)
    want = [r for r in given if not held(r.text)]
    assert len(want) < len(given) and sorted(map(repr, kept)) == sorted(map(repr, want))


def test_copies_follow_the_weights(stages, spark):
    given, mixed = stages["mixing"]
    counts = {}
    for r in mixed:
        counts[r] = counts.get(r, 0) + 1
    assert set(counts) <= set(given)
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    again = mixing.mix_sources(frame).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in again} == {r.doc_id: n for r, n in counts.items()}


def test_token_ids_are_those_of_the_library(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given, written = stages["token_ids"]
    want = sorted(
        ((r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in given)
    )
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in written) == want
    starts = sorted((r.start, r.n_tokens) for r in written)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]


def test_run_gives_what_the_stages_give(stages, spark, folder):
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(map(tuple, stages["token_ids"][1]), key=repr)


def test_columns_of_any_name_stay(spark):
    names = ["__source", "__parts", "__cdf", "__rate_salt", "__salt", "__copies", "__near_dup_row", "__contaminated_row", "a.b"]
    kinds = "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(n, f"text number {n} has words of its own {n}", "s", *range(len(names))) for n in range(8)], kinds)
    items = spark.createDataFrame([(1, "text number 3 has words of its own 3")], "item_id long, text string")
    for found in (mixing.mix_sources(docs), near_dup.drop_near_duplicates(docs), decontam.drop_contaminated(docs, items)):
        rows = found.select(*[f"`{n}`" for n in names]).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(names)))]
    assert decontam.drop_contaminated(docs, items).count() == 7


def batch_sizes(spark):
    """Bytes of the batches that 20 MB of long texts come to Python in."""
    texts = spark.range(0, 40, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("word "), 100_000)))

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    return [r["size"] for r in texts.mapInArrow(measure, "size long").collect()]


def test_stages_hand_texts_to_python_in_small_batches(spark, folder):
    session = spark.newSession()
    docs = session.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.drop_contaminated(session, docs, folder)
    sizes = batch_sizes(session)
    assert sum(sizes) > 19_000_000 and max(sizes) < 8_000_000


def test_a_bound_that_the_user_set_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    bound_batches(session)
    assert max(batch_sizes(session)) < 2_000_000


def test_remembered_pieces_are_few(spark):
    encoder, letters = Encoder(public_tokenizers.path(TOKENIZER)), "bcdfghjklmnpqrstvwxz"
    name = lambda n: "".join(letters[n // 20**k % 20] for k in range(5))
    for start in range(0, 320_000, 40_000):
        text = " ".join(map(name, range(start, start + 40_000)))
        ids = encoder.encode(text)
        assert len(encoder.known) <= 250_000
    assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids
