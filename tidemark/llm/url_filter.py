"""Allow and block rules on hosts and path prefixes, judged by hashed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, quoted

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_RULE_VERDICT = "allow"
HASH_HEX = 8  # a short hash prefix: 4 bytes


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host between the first ``://`` and ``/``, ``?``, ``#`` or the end, with
    A-Z in lower case; the path from there up to ``?``, ``#`` or the end. Both are empty for a url
    that is null or has no ``://``.
    """
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _tail(path: Column) -> Column:
    """The characters behind the last slash."""
    return F.length(F.substring_index(path, "/", -1))


def _digest(host: Column, path: Column) -> Column:
    # A host has no slash, so the pair can be told from its concatenation with one in between.
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row per host and path, with its hashes; block beats allow.

    Rows with a null host or verdict are no rules; a null path is the empty path, which fits
    every path.
    """
    rules = rules.select(
        F.translate("host", UPPER, UPPER.lower()).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        "verdict",
    ).filter("rule_host IS NOT NULL AND verdict IS NOT NULL")
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return (
        rules.groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select("*", digest.alias("rule_digest"))
        .withColumn("short", F.substring("rule_digest", 1, HASH_HEX))
    )


def _expressions(host: Column, path: Column, labels: int, slashes: int, tails: list[int]) -> Column:
    """Every (host suffix, path prefix) of a url that a rule of the given shapes could equal.

    Path prefixes end behind the n-th slash plus one of the ``tails``; the whole list is written
    with array functions.
    """
    parts = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    pieces = F.split(path, "/")  # n slashes give n + 1 pieces
    directories = F.transform(
        F.sequence(F.lit(0), F.least(F.size(pieces) - 1, F.lit(slashes))),
        lambda n: F.struct(
            F.when(n == 0, "")
            .otherwise(F.concat(F.array_join(F.slice(pieces, 1, n), "/"), F.lit("/")))
            .alias("directory"),
            F.element_at(pieces, n + 1).alias("next"),
        ),
    )
    wanted = F.array(*[F.lit(tail) for tail in tails])
    paths = F.flatten(
        F.transform(
            directories,
            lambda d: F.transform(
                F.filter(wanted, lambda tail: tail <= F.length(d["next"])),
                lambda tail: F.concat(d["directory"], F.substring(d["next"], F.lit(1), tail)),
            ),
        )
    )
    return F.flatten(
        F.transform(
            hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The rule that decides each url: (key, host, path, rule, verdict), one row per row of ``pages``.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the url's path
    starts with the rule's path. The longest rule (host and path together) wins, at equal length the
    longer host. Without a fitting rule, ``rule`` is null and the verdict ``allow``.

    Urls are reduced to the last labels of the host and the first directories of the path that any
    rule could look at. Only distinct reductions are expanded into expressions, joined with the rules
    on a short hash prefix, confirmed by the full digest and brought back, so a host with a third of
    all pages is one row in the rule join. Repeated keys keep their rows, a null key stays null, other
    columns of ``pages`` are not looked at; without rules every url is allowed.
    """
    rules = prepare_rules(rules)
    shape = rules.agg(
        F.max(_labels(F.col("rule_host"))).alias("labels"),
        F.max(_slashes(F.col("rule_path"))).alias("slashes"),
        F.array_sort(F.collect_set(_tail(F.col("rule_path")))).alias("tails"),
    ).first()  # bounded: numbers up to the length of a url
    labels, slashes, tails = shape["labels"] or 1, shape["slashes"] or 0, shape["tails"] or [0]

    host, path = split_url(quoted(url))
    urls = pages.select(quoted(key).alias("key"), host.alias("host"), path.alias("path"))
    # What rules can see: the last labels, and the path up to the last tail behind the last slash.
    urls = urls.withColumns(
        {
            "host_end": F.array_join(
                F.slice(
                    F.split("host", r"\."),
                    F.greatest(F.lit(1), _labels(F.col("host")) - labels + 1),
                    F.lit(labels),
                ),
                ".",
            ),
            "path_start": F.concat_ws(
                "/",
                F.slice(F.split("path", "/"), 1, slashes),
                F.substring(
                    F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(slashes + 1)), F.lit("")),
                    1,
                    max(tails),
                ),
            ),
        }
    )
    # concat_ws put a slash behind the last kept piece even if the path had none there.
    urls = urls.withColumn(
        "path_start",
        F.when(_slashes(F.col("path")) >= slashes, F.col("path_start")).otherwise(F.col("path")),
    )
    expanded = (
        urls.select("host_end", "path_start")
        .distinct()
        .withColumn(
            "e",
            F.explode(_expressions(F.col("host_end"), F.col("path_start"), labels, slashes, tails)),
        )
        .withColumn("digest", _digest(F.col("e.h"), F.col("e.p")))
        .withColumn("short", F.substring("digest", 1, HASH_HEX))
        .drop("e")
    )
    rules = broadcast_if_small(
        rules, F.octet_length("rule_host") + F.octet_length("rule_path") + 128
    )
    length = F.length("rule_host") + F.length("rule_path")
    decided = (
        expanded.join(rules, "short")
        .filter("digest = rule_digest")
        .groupBy("host_end", "path_start")
        .agg(
            F.max(
                F.struct(
                    length.alias("length"),
                    F.length("rule_host").alias("host_length"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    F.col("rule_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return urls.join(decided, ["host_end", "path_start"], "left").select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(NO_RULE_VERDICT)).alias("verdict"),
    )
