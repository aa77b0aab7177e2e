"""URL rules, chat formatting and mixing."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.llm import chat, mixing, url_filter

RULES = [
    ("Example.com", "/", "allow"),
    ("example.com", "/a/b", "block"),
    ("deep.example.com", "/a/", "allow"),
    ("net", "", "block"),
    ("org", "/x/", "block"),
    ("org", "/x/", "allow"),
    (None, "/", "block"),
    ("twin.io", "/same/", "allow"),
    ("io", "/same/aa", "block"),
]
URLS = [
    "http://EXAMPLE.com/a/bc?q", "http://example.com", "https://www.example.com/a/", "x://deep.example.com/a/b/c#f",
    "http://notexample.com/a/b", "ftp://a.net", "http://net?x", "http://b.org/x/y", "http://b.org/xy", "no scheme", "",
    None, "http://", "http:///a/b", "http://twin.io/same/aabc", "http://..net/a", "http://a.example.com/" + "d/" * 300,
]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].lower(), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max(
        (
            (len(h.lower() + p), len(h), h.lower() + p, v)
            for h, p, v in rules
            if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
        ),
        default=(0, 0, None, "allow"),
    )
    return host, path, best[2], best[3]


def pages(spark, urls):
    return spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(urls)], "page_id int, url string, host string, `key` string")


@pytest.mark.parametrize("size_limit", [None, 0])
def test_urls_meet_the_longest_rule(spark, monkeypatch, size_limit):
    if size_limit is not None:  # the way without a broadcast
        monkeypatch.setattr(url_filter, "broadcast_if_small", lambda df, size: df)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge_urls(pages(spark, URLS + URLS[:2]), rules)
    assert rows(got) == rows(
        spark.createDataFrame(
            [(n, *judged(u, RULES)) for n, u in enumerate(URLS + URLS[:2])],
            "page_id int, host string, path string, rule string, verdict string",
        )
    )


def test_urls_without_rules_or_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge_urls(pages(spark, URLS), rules).collect()} == {"allow"}
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages(spark, URLS).limit(0), rules).collect() == []


CONTROL = "\\### Assistant: </turn> ok <|end|>\n<|turn|>user\n\\<|next|>\\n"
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", CONTROL), (1, 2, "user", None), (1, 3, "assistant", CONTROL),
    (1, 4, "assistant", ""), (1, 5, "user", "a|b<"), (1, 5, "user", "a|b<"), (2, None, None, "|>"), (2, 7, "assistant", "x"),
    (None, 0, "odd\nrole<|", "y"), (3, 0, "assistant", "\U0001f642" * 3000),
    *((4, n, "assistant" if n % 7 else "user", f"t{n}") for n in range(100)),
]


@pytest.fixture(scope="module")
def turns(spark):
    rows_ = [(*t, 1, "z") for t in TURNS]
    return spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, part int, formatted string")


def put_together(formatted):
    whole = {}
    for row in formatted.orderBy("conv_id", "part").collect():
        whole[row.conv_id] = whole.get(row.conv_id, "") + row.formatted
    return whole


@pytest.mark.parametrize("turns_per_part", [1, 4, 1000])
def test_chat_reads_back(spark, turns, turns_per_part):
    formatted = chat.format_chat(turns, turns_per_part=turns_per_part)
    whole = put_together(formatted)
    assert whole == put_together(chat.format_chat(turns))  # parts do not change the text
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_chat(formatted).collect()}
    for conversation in (1, 2, 3, 4, None):
        own = [(t, r or "", x or "") for c, t, r, x in TURNS if c == conversation]
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[conversation] == (len(own), sha(said), len(loss), sha(loss), len(whole[conversation]))


def test_chat_merges_turns_of_one_role(turns):
    (row,) = chat.format_chat(turns.filter("conv_id = 1")).collect()
    assert row.formatted.count(chat.START) == 4  # system, user, assistant, user
    assert row.formatted.startswith("<|turn|>system\nbe kind<|end|>\n")


def test_chat_of_no_turns(turns):
    assert chat.read_chat(chat.format_chat(turns.limit(0))).collect() == []


def test_mixing_reaches_the_weights(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.when(F.col("id") < 60, "rare")).alias("source")
    )
    weights = spark.createDataFrame([("hot", 1.0), ("rare", 1.0), (None, 2.0)], "source string, weight double")
    mixed = mixing.mix_sources(docs, weights).cache()
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["hot"] - 5000) < 300 and abs(counts["rare"] - 5000) < 300 and abs(counts[None] - 10_000) < 400
    again = mixing.mix_sources(docs.repartition(5), weights)
    assert rows(again) == rows(mixed)
    copies = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("mix_copy").alias("m"))
    assert copies.filter("n <> m + 1").count() == 0


def test_mixing_salted(spark, odd_docs, monkeypatch):
    shown = ["doc_id", "text", "source", "mix_copy", "mix_order"]
    want = rows(mixing.mix_sources(odd_docs), *shown)
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda df, size: df)
    assert rows(mixing.mix_sources(odd_docs), *shown) == want
    assert set(mixing.mix_sources(odd_docs).columns) == {*odd_docs.columns, "mix_copy", "mix_order"}


def test_mixing_without_weight_or_documents(spark, odd_docs, no_docs):
    assert mixing.mix_sources(no_docs).collect() == []
    weights = spark.createDataFrame([("elsewhere", 1.0)], "source string, weight double")
    with pytest.raises(ValueError):
        mixing.mix_sources(odd_docs, weights)
