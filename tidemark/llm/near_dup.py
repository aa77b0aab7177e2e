"""Near duplicates by DartMinHash signatures, banded, verified exactly, joined to classes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

from .common import broadcast_if_small, free_name, quoted, text_of
from .components import connected_components
from .shingles import mix, shingle_hashes, similarity, stream, weighted, words_of

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
LEADERS = 4
COUNTERS = 1 << 20


def units(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One value per unit of weight: the weighted similarity of two texts is the plain one of their units."""
    first = np.cumsum(counts) - counts
    unit = np.arange(int(counts.sum()), dtype=np.uint64) - np.repeat(first, counts).astype(np.uint64)
    return mix(np.repeat(hashes, counts) + unit * np.uint64(0xA0761D6478BD642F))


def dart_signature(hashes: np.ndarray, counts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """One value per coordinate; two weighted sets agree in each with the probability of their
    weighted Jaccard similarity.

    Every unit of an element's weight is a region that darts hit at random: a Poisson process over the
    rank, its gaps drawn from hashes of element, unit and number of the dart. Each dart belongs to a
    coordinate by hash; the dart with the least rank there is its value. Only darts below a rank are
    thrown, at first so that about k ln k + 2k darts land; while a coordinate is empty, the rank doubles.
    """
    regions = units(hashes, counts)
    limit = (coordinates * math.log(coordinates) + 2 * coordinates) / len(regions)
    while True:
        ranks, darts = _throw(regions, limit)
        where = (mix(darts) % np.uint64(coordinates)).astype(np.int64)
        order = np.argsort(-ranks, kind="stable")
        signature, hit = np.zeros(coordinates, np.uint64), np.zeros(coordinates, bool)
        signature[where[order]] = darts[order]  # the least rank is written last
        hit[where] = True
        if hit.all():
            return signature
        limit *= 2


def _throw(regions: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and values of all darts below the limit."""
    rank, ranks, darts, number = np.zeros(len(regions)), [], [], 1
    at_once = max(1, int(limit) + 1)  # per round; few regions need many darts each
    while len(regions):
        numbers = np.arange(number, number + at_once, dtype=np.uint64)
        values = stream(regions[:, None], numbers[None, :])
        gaps = -np.log(((values >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        reached = rank[:, None] + np.cumsum(gaps, axis=1)
        below = reached < limit
        ranks.append(reached[below])
        darts.append(values[below])
        going = below[:, -1]
        regions, rank, number = regions[going], reached[going, -1], number + at_once
    return np.concatenate(ranks), np.concatenate(darts)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One hash per band of ``ROWS`` coordinates."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0xA0761D6478BD642F) + column)
    return keys


def row_id(key: str, text: str) -> Column:
    """Tells rows apart by key and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(quoted(key).cast("string"), F.lit("null")), text_of(text))))


def signatures(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc, node, bands): for each row of ``docs`` its identity, its key, the MD5 of its words,
    and its band keys (none for a text without words). Rows of the same words have the same node."""
    bands_type = pa.list_(pa.int64())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands = [], []
            for value in batch.column(2):
                value = value.as_py()
                hashes = shingle_hashes(value)
                nodes.append(hashlib.md5(" ".join(words_of(value)).encode()).digest())
                keys = band_keys(dart_signature(*weighted(hashes))) if len(hashes) else np.zeros(0, np.uint64)
                bands.append(keys.view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(bands, bands_type)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc", "node", "bands"])

    rows = docs.select(
        row_id(key, text).alias("row"), quoted(key).cast("long").alias("doc"), text_of(text).alias("text")
    )
    return rows.mapInArrow(sign, "row binary, doc long, node binary, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of nodes, exactly, out of (node, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            found = []
            for n in range(batch.num_rows):
                name = batch.column(0)[n].as_py()
                if name != last:
                    last, left = name, weighted(shingle_hashes(batch.column(2)[n].as_py()))
                found.append(similarity(left, weighted(shingle_hashes(batch.column(3)[n].as_py()))))
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(
        compare, "a binary, b binary, similarity double"
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different nodes, each once, the lesser first."""
    return (
        pairs.filter("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def frequencies(texts: DataFrame) -> np.ndarray:
    """At the hash of a unit modulo ``COUNTERS``: at least the number of texts, of (node, text), that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                held = units(*weighted(shingle_hashes(value.as_py())))
                np.add.at(table, (held % np.uint64(COUNTERS)).astype(np.int64), 1)
        slots = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(table[slots])], ["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot long, n long")
    counted = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int64)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return table


def prefixes(texts: DataFrame, often: np.ndarray, threshold: float) -> DataFrame:
    """(unit, node, component, size, place, indexed): the rarest units of each text of (node, component, text).

    In one order of all units, rare ones first, the first unit that two texts of at least ``threshold``
    share is among the first ``size - threshold * size + 1`` of both. In the smaller text it is even
    among the first ``size - 2 * threshold / (1 + threshold) * size + 1``: these are ``indexed``.
    Units that only one text holds are left out, places count them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                held = units(*weighted(shingle_hashes(batch.column(2)[n].as_py())))
                number = often[(held % np.uint64(COUNTERS)).astype(np.int64)]
                size = len(held)
                probed, indexed = (
                    size - math.ceil(part * size - 1e-6) + 1 for part in (threshold, 2 * threshold / (1 + threshold))
                )
                order = np.lexsort((held, number))[:probed]
                places = np.flatnonzero(number[order] > 1)
                rows = len(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held[order][places].view(np.int64)),
                        pa.array([batch.column(0)[n].as_py()] * rows, pa.binary()),
                        pa.array([batch.column(1)[n].as_py()] * rows, pa.binary()),
                        pa.array(np.full(rows, size, np.int64)),
                        pa.array(places + 1, pa.int64()),
                        pa.array(places < indexed),
                    ],
                    ["unit", "node", "component", "size", "place", "indexed"],
                )

    return texts.select("node", "component", "text").mapInArrow(
        cut, "unit long, node binary, component binary, size long, place long, indexed boolean"
    )


def candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of different components, out of (node, component, text), whose similarity can
    reach ``threshold``; no such pair is left out.

    Texts meet at a rare unit that both hold. Pairs within the largest component at a unit are not formed.
    """
    spots = materialise(prefixes(texts, frequencies(texts), threshold), "spots")
    parts = spots.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("n"), F.max("indexed").alias("indexed"))
    met = parts.groupBy("unit").agg(
        F.max_by("component", "n").alias("major"), F.count(F.lit(1)).alias("parts"), F.max("indexed").alias("any")
    )
    met = met.filter(F.col("any") & (F.col("parts") > 1)).select("unit", "major")
    spots = spots.join(met, "unit").withColumn("minor", F.col("component") != F.col("major")).drop("major")
    spots = materialise(spots, "met")
    x, y = (
        spots.select("unit", *(F.col(c).alias(f"{c}_{side}") for c in spots.columns if c != "unit")) for side in "xy"
    )
    x = x.filter("indexed_x")
    # What both can share from the first unit they share on, against what the threshold asks.
    shared = 1 + F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    enough = shared * (1 + threshold) >= threshold * (F.col("size_x") + F.col("size_y")) - 1e-6
    fits = (F.col("component_x") != F.col("component_y")) & (F.col("size_x") <= F.col("size_y")) & enough
    pairs = [
        left.join(right, (left["unit"] == right["unit"]) & fits).select(
            F.col("node_x").alias("x"), F.col("node_y").alias("y")
        )
        for left, right in ((x.filter("minor_x"), y), (x.filter("not minor_x"), y.filter("minor_y")))
    ]
    return _ordered(pairs[0].union(pairs[1]))


def _named(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, node, component) of all members, and the bands that hold several components."""
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = members.join(found, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component")
    )
    named = materialise(named, "named")
    mixed = (
        named.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("band")
    )
    return named, mixed


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(row, key, class_id, is_first), one row per row of ``docs``: texts whose weighted Jaccard
    similarity over word shingles is at least ``threshold`` are linked, linked texts are one class.
    ``class_id`` is the least key of the class, ``is_first`` marks the row of it that stays.

    Rows of the same words are one node from the start, so thousands of copies cost one signature
    row each and no pairs. Nodes that share a band meet in a bucket. There the node with the most
    company over all its bands, which is the text that copies were made from rather than one of the
    copies, is compared with all others; then the next ``LEADERS`` - 1 with those that are not yet in
    their class. What then still shares a bucket with another class goes through an exact join:
    such texts meet at the rarest parts they share (``candidates``), and every pair that can reach
    ``threshold`` is compared. So texts that share only what a large group has in common are not
    paired, and no pair that shares a band is missed. All comparisons are exact, on whole texts.

    Null texts are empty. Texts without words are one class, texts of fewer than five words are alike
    only if their words are the same. A null key counts behind all others, so ``class_id`` is null
    only if all keys of a class are; equal rows share ``row``. Other columns are not looked at.
    """
    signed = materialise(signatures(docs, key=key, text=text), "signatures")
    nodes = signed.groupBy("node").agg(F.min("row").alias("row"), F.any_value("bands").alias("bands"))
    members = nodes.select("node", "row", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialise(members.join(sizes, "band"), "members")

    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("company"), "leader"))
    leaders = members.select("band", "node").join(company, "node").withColumnRenamed("node", "leader")
    leaders = leaders.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).drop("company")
    leaders = materialise(leaders, "leaders")

    wanted = members.select("node", "row").distinct()
    rows = docs.select(row_id(key, text).alias("row"), text_of(text).alias("text"))
    texts = rows.join(broadcast_if_small(wanted, F.lit(32)), "row").select("node", "text")
    texts = materialise(texts.dropDuplicates(["node"]), "texts")

    first = members.join(leaders.filter("rank = 1"), "band")
    first = _ordered(first.select(F.col("leader").alias("x"), F.col("node").alias("y")))
    compared = materialise(similarities(first, texts), "compared")
    links = compared.filter(F.col("similarity") >= threshold)
    named, mixed = _named(members, links)
    others = leaders.filter("rank > 1").join(mixed, "band").join(
        named.select("band", F.col("node").alias("leader"), F.col("component").alias("leader_component")),
        ["band", "leader"],
    )
    second = named.join(others, "band").filter("component <> leader_component")
    second = _ordered(second.select(F.col("leader").alias("x"), F.col("node").alias("y")))
    second = second.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    compared = compared.union(materialise(similarities(second, texts), "compared"))
    links = compared.filter(F.col("similarity") >= threshold)

    named, mixed = _named(members, links)
    open_ = named.join(mixed, "band", "left_semi").select("node", "component").distinct()
    open_ = materialise(texts.join(open_, "node").select("node", "component", "text"), "open")
    third = candidates(open_, threshold).join(compared.select("a", "b"), ["a", "b"], "left_anti")
    more = similarities(third, texts).filter(F.col("similarity") >= threshold)
    links = materialise(links.union(more), "links")
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    placed = signed.select("row", "doc", "node").join(found, "node", "left")
    placed = placed.select("row", "doc", F.coalesce("component", "node").alias("component"))
    order = F.struct(F.col("doc").isNull().alias("no_key"), "doc", "row")
    firsts = placed.groupBy("component").agg(F.min(order).alias("first"))
    return placed.join(firsts, "component").select(
        "row",
        F.col("doc").alias(key),
        F.col("first.doc").alias("class_id"),
        (F.col("row") == F.col("first.row")).alias("is_first"),
    )


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates, the one of the least key; all columns
    stay. Of equal rows one stays."""
    mark = free_name(docs, "__near_dup_row")
    kept = near_duplicates(docs, key=key, text=text).filter("is_first").select(F.col("row").alias(mark)).distinct()
    marked = docs.withColumn(mark, row_id(key, text))
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)
