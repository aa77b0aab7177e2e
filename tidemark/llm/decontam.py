"""Benchmark items inside documents: containment search by MinHash over windows sized to the items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

from .common import broadcast_if_small, free_name, quoted, text_of
from .near_dup import row_id
from .shingles import WORDS_PER_SHINGLE, mix, shingle_hashes, stream, words_of

THRESHOLD = 0.8
BINS = 128  # one minimum for each part of the range of hashes
SMALL_CLASS = 2  # items up to this class, of fewer than 8 shingles, keep all their hashes
WINDOWS = 4096  # windows whose minima are taken at once
FILTER_BITS = 27  # a filter of item keys has at most 2^27 bits, 16 MB
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def size_class(length: int) -> int:
    """Items of 2^c to 2^(c+1) - 1 shingles are of class c."""
    return length.bit_length() - 1


def _salt(number: int, span: int) -> np.uint64:
    """Sets the keys of one size class and span apart from those of all others."""
    return stream(np.array([8 * number + span], np.uint64), 1000)[0]


def _minima(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of several sets, each a row of ``places`` of hashes, -1 for none: the least
    hash of every bin that is not empty. An empty bin has no value and takes none from another bin."""
    rows, _ = np.nonzero(places >= 0)
    values = hashes[places[places >= 0]]
    least = np.full(len(places) * BINS, _EMPTY)
    np.minimum.at(least, rows * BINS + (values >> np.uint64(57)).astype(np.int64), values)
    return np.unique(least[least != _EMPTY])


def item_keys(hashes: np.ndarray, span: int) -> np.ndarray:
    """The MinHash values of an item; all its hashes if it is small."""
    number = size_class(len(hashes))
    values = np.unique(hashes) if number <= SMALL_CLASS else _minima(hashes, np.arange(len(hashes))[None, :])
    return values ^ _salt(number, span)


def window_keys(hashes: np.ndarray, hits: np.ndarray, classes: list[int], span: int) -> Iterator[np.ndarray]:
    """MinHash values of a document's windows, class by class; ``hits`` are the places of shingles that
    some item has.

    The windows of class c are 2^(c+2) shingles long and begin every 2^(c+1), so an item of the class
    lies whole within one of them, and is at least a fifth of what it holds. The values are hashes of
    shingles, so a window without a hit can meet no item and is passed over. A contained item misses
    its window with a chance below 10^-6; small items, compared by all their hashes, never do.
    """
    for number in classes:
        if number <= SMALL_CLASS:
            yield hashes[hits] ^ _salt(number, span)
            continue
        step = 2 << number
        last = max(0, -(-len(hashes) // step) - 2)
        windows = np.unique(np.clip(np.concatenate([hits // step - 1, hits // step]), 0, last))
        size = max(1, WINDOWS * 64 // step)
        for start in range(0, len(windows), size):
            places = windows[start : start + size, None] * step + np.arange(2 * step)[None, :]
            yield _minima(hashes, np.where(places < len(hashes), places, -1)) ^ _salt(number, span)


class KeyFilter:
    """Which keys may be among those that were put in: few false ones, none missed."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        other = mix(keys)
        return [keys & mask, other & mask, (other >> np.uint64(32)) & mask]

    def _holds(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys that may be in."""
        found = np.flatnonzero(self._holds(keys & self.mask))
        places = self.places(keys[found], self.mask)
        return found[self._holds(places[1]) & self._holds(places[2])]

    def pick(self, keys: np.ndarray) -> np.ndarray:
        """The different keys that may be in."""
        return np.unique(keys[self.find(keys)])


def _key_filter(keys: DataFrame) -> KeyFilter:
    """A filter of the values of (value). Its bits are set by Spark; one row per word of 64 bits, of
    which there is a fixed number at most, goes to the driver."""
    count = keys.count()
    size = min(FILTER_BITS, max(16, (16 * count).bit_length()))
    mask = np.uint64((1 << size) - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            place = np.concatenate(KeyFilter.places(values, mask))
            word, bit = (place >> np.uint64(6)).astype(np.int64), (place & np.uint64(63)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bit"])

    words = (
        keys.select("value")
        .mapInArrow(places, "word long, bit long")
        .groupBy("word")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << size - 6, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return KeyFilter(bits.view(np.uint8))


def prepare_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, item_key, span, size_class, shingles, keys) per different item with words."""
    longs = pa.list_(pa.int64())
    names = ["item", "item_key", "span", "size_class", "shingles", "keys"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_key, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = shingle_hashes(text)
                if len(hashes):
                    span = min(WORDS_PER_SHINGLE, len(words_of(text)))
                    keys = item_keys(hashes, span).view(np.int64)
                    rows.append((item, item_key, span, size_class(len(hashes)), np.unique(hashes).view(np.int64), keys))
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), longs, longs]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = items.select(
        row_id(key, text).alias("item"), quoted(key).cast("long").alias("item_key"), text_of(text).alias("text")
    )
    return rows.distinct().mapInArrow(
        prepare,
        "item binary, item_key long, span int, size_class int, shingles array<long>, keys array<long>",
    )


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(row, key, item_key, n_shared, containment): documents that hold at least ``threshold`` of an
    item's different word shingles, whatever the length of the document.

    Items are partitioned by size; a document is cut into overlapping windows sized to each partition,
    so that an item is a fair part of its window and their MinHash values meet. Where any of them is
    equal, document and item are candidates, and containment is counted exactly over the whole text.

    One pass over the texts leaves only what a filter of the items' keys lets through (of bounded size,
    it passes every true key); all else are joins of those rows, so items may be many, too. Null and
    empty texts hold nothing and are held nowhere; an item of fewer than five words is held where its
    words stand in a row. Equal rows (same key and text) are one ``row``; other columns are not looked at.
    """
    prepared = materialise(prepare_items(items, item_key, item_text), "items")
    classes = sorted(tuple(r) for r in prepared.select("span", "size_class").distinct().collect())  # < 200
    keys = prepared.select("item", F.explode("keys").alias("value"))
    parts = prepared.select("item", F.explode("shingles").alias("value"))
    context = docs.sparkSession.sparkContext
    filters = context.broadcast((_key_filter(keys), _key_filter(parts)))
    spans = {span: [c for s, c in classes if s == span] for span, _ in classes}
    schema = pa.schema(
        [("row", pa.binary()), ("doc", pa.int64()), ("is_key", pa.bool_()), ("value", pa.int64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_filter, shingle_filter = filters.value
        for batch in batches:
            rows, docs_of, flags, values = [], [], [], []
            for row, doc, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = text.as_py()
                for span, numbers in spans.items():
                    hashes = shingle_hashes(text, span)
                    hits = shingle_filter.find(hashes)
                    if not len(hits):
                        continue
                    keys = [key_filter.pick(some) for some in window_keys(hashes, hits, numbers, span)]
                    for flag, found in ((True, np.concatenate(keys)), (False, np.unique(hashes[hits]))):
                        rows += [row.as_py()] * len(found)
                        docs_of += [doc.as_py()] * len(found)
                        flags += [flag] * len(found)
                        values.append(found.view(np.int64))
            values = np.concatenate(values) if values else np.zeros(0, np.int64)
            columns = [rows, docs_of, flags, values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    texts = docs.select(
        row_id(key, text).alias("row"), quoted(key).cast("long").alias("doc"), text_of(text).alias("text")
    )
    hits = texts.mapInArrow(scan, "row binary, doc long, is_key boolean, value long")
    hits = materialise(hits, "hits")
    small = lambda df: broadcast_if_small(df, F.lit(32))
    candidates = (
        hits.filter("is_key").join(small(keys), "value").select("row", "item").distinct()
    )
    sizes = prepared.select("item", F.size("shingles").alias("size"), "item_key")
    shared = (
        hits.filter("NOT is_key")
        .join(small(parts), "value")
        .join(candidates, ["row", "item"])
        .groupBy("row", "item")
        .agg(F.min("doc").alias("doc"), F.count_distinct("value").alias("n_shared"))
        .join(small(sizes), "item")
        .withColumn("containment", F.col("n_shared") / F.col("size"))
    )
    return shared.filter(F.col("containment") >= threshold).select(
        "row", F.col("doc").alias(key), F.col("item_key").alias(item_key), "n_shared", "containment"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold an item; all columns and all other rows stay."""
    mark = free_name(docs, "__contaminated_row")
    held = find_contained(docs, items, key=key, text=text).select(F.col("row").alias(mark)).distinct()
    held = broadcast_if_small(materialise(held, "held"), F.lit(32))
    return docs.withColumn(mark, row_id(key, text)).join(held, mark, "left_anti").drop(mark)
