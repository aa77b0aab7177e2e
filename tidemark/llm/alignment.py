"""Tokens of two tokenizers side by side: groups of both that cover the same bytes, and how often ids meet."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

from .common import quoted, text_of
from .pieces import byte_level
from .token_ids import CACHED_LENGTH, Encoder, encoder

CACHED_PIECES = 1_000_000
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHIFT = 32  # a pair of ids is one number: first id << 32 | second id
FREQUENT = 1 << 20  # pairs whose counts are broadcast, 16 MB; all others are joined
SLICE = 400_000  # characters of texts that are cut together
SPACE = "▁"


class ByteLevel:
    """Ids of a byte-level tokenizer, without special tokens, and the bytes of every id."""

    def __init__(self, path: str):
        self.encoder: Encoder = encoder(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {shown: byte for byte, shown in byte_level().items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            known = all(character in byte_of for character in entry)
            self.bytes[number] = bytes(map(byte_of.__getitem__, entry)) if known else entry.encode()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of space and text; None if their bytes are not as many as those of these."""
        ids = self.encoder.encode_plain(" " + text).astype(np.int64)
        return ids if int(self.sizes[ids].sum()) == len(text.encode()) + 1 else None


class Pieces:
    """Ids of a sentence-piece model, and the bytes of every id.

    No entry of such a vocabulary goes on from a word into the space behind it, so nothing is merged
    across a place where a space follows another sign. The library is asked once for each different
    chunk between such places; the space that it adds is the one that each chunk begins with.
    """

    _CHUNKS = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.apart = [], True
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            is_byte = self.model.is_byte(number)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(SPACE, " ").encode())
            self.apart &= not re.search(f"[^{SPACE}]{SPACE}", piece)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.known: dict[str, bytes] = {}
        self.broken: set[str] = set()

    def _ask(self, chunks: list[str]) -> list[list[int]]:
        # A space alone has nothing left that the library would put its own before.
        alone = [self.model.piece_to_id(SPACE)]
        return [ids or alone for ids in self.model.encode([chunk[1:] for chunk in chunks], num_threads=1)]

    def _learn(self, chunks: list[str]) -> None:
        """Ids of the new ones among some chunks: of all in one text, cut where their bytes end. If the
        ids do not give these bytes back, each is asked for by itself."""
        fresh = list(set(chunks).difference(self.known))
        if len(self.known) + len(fresh) > CACHED_PIECES:
            self.known, self.broken, fresh = {}, set(), list(set(chunks))
        # Chunks of spaces alone would run into the next one.
        alone = [chunk for chunk in fresh if chunk[-1] == " " or not self.apart]
        joined = [chunk for chunk in fresh if chunk[-1] != " " and self.apart]
        data = [chunk.encode() for chunk in joined]
        ids = np.array(self.model.encode("".join(joined)[1:], num_threads=1) if joined else [], np.uint32)
        if b"".join(map(self.bytes.__getitem__, ids.tolist())) == b"".join(data):
            places = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(d) for d in data])) + 1
            raw, at = ids.tobytes(), 0
            for chunk, place in zip(joined, (4 * places).tolist()):
                self.known[chunk], at = raw[at:place], place
        else:
            alone = fresh
        for chunk, found in zip(alone, self._ask(alone) if alone else ()):
            if b"".join([self.bytes[n] for n in found]) != chunk.encode():
                self.broken.add(chunk)
            self.known[chunk] = array("I", found).tobytes()

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of a text that is not empty; None if they do not give the bytes of space and text back."""
        chunks = self._CHUNKS.findall(" " + text) if self.apart else [" " + text]
        try:
            ids = b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            self._learn(chunks)
            ids = b"".join(map(self.known.__getitem__, chunks))
        broken = not self.broken.isdisjoint(chunks)
        for chunk in chunks if len(text) > CACHED_LENGTH * len(chunks) else ():
            if len(chunk) > CACHED_LENGTH:
                self.known.pop(chunk, None)
                self.broken.discard(chunk)
        return None if broken else np.frombuffer(ids, np.uint32).astype(np.int64)


@cache
def tokenizers(first: str, second: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(first), Pieces(second)


def shared_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending arrays of token ends where both have the same end; both end alike.

    Divide and conquer: in every open interval between two shared ends, a shared end is looked for from
    the middle outwards, by bisection in the other array, in steps that double. Where one is found, the
    two halves are the next intervals; an interval without one is a group. All intervals of a level
    are handled at once.
    """
    found = [np.array([len(a) - 1])] if len(a) else [np.zeros(0, np.int64)]
    # Open intervals (low, high) of places in a; the place -1 is the start of the text.
    low, high = np.array([-1] * min(1, len(a))), found[0]
    while len(low):
        inner = high - low > 1
        low, high = low[inner], high[inner]
        middle = (low + high) // 2
        cut = np.full(len(low), -1)
        waiting, near, far = np.arange(len(low)), 0, 1
        while len(waiting):
            # Places at a distance of near..far-1 from the middle, on either side.
            offsets = np.arange(near, far)
            offsets = np.concatenate([offsets, -offsets[offsets > 0]])
            offsets = offsets[np.argsort(np.abs(offsets), kind="stable")]
            places = middle[waiting, None] + offsets[None, :]
            within = (places > low[waiting, None]) & (places < high[waiting, None])
            ends = a[np.where(within, places, 0)]
            met = within & (b[np.minimum(np.searchsorted(b, ends), len(b) - 1)] == ends)
            first = met.argmax(axis=1)
            hit = met[np.arange(len(waiting)), first]
            cut[waiting[hit]] = places[hit, first[hit]]
            left = ~hit & within.any(axis=1)
            waiting, near, far = waiting[left], far, 2 * far
        whole = cut >= 0
        found.append(cut[whole])
        # Left and right halves in turn, so that intervals stay in order.
        low, high = (np.stack(pair, axis=1).ravel() for pair in ((low[whole], cut[whole]), (cut[whole], high[whole])))
    at_a = np.sort(np.concatenate(found))
    return at_a, np.searchsorted(b, a[at_a])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """All pairs of an id of a and one of b within each group, group by group; a group has the next
    n_a and n_b ids."""
    of_a = np.repeat(n_b, n_a)
    start_b = np.repeat(np.cumsum(n_b) - n_b, n_a)
    return np.repeat(a, of_a) << SHIFT | b[np.repeat(start_b, of_a) + _within(of_a)]


def groups_text(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of every group, a's before b's."""
    tokens = np.empty(len(a) + len(b), np.int64)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[ends_a - 1], last_b[ends_b - 1] = 1, 2
    tokens[np.arange(len(a)) + np.repeat(ends_b - n_b, n_a)] = a * 3 + last_a
    tokens[np.arange(len(b)) + np.repeat(ends_a, n_b)] = b * 3 + last_b
    return "".join(map(_shown(int(tokens.max()) // 3 + 1).__getitem__, tokens.tolist()))[:-1]


_SHOWN: list[str] = []


def _shown(size: int) -> list[str]:
    """Every id followed by a comma, a bar and a semicolon."""
    for number in range(len(_SHOWN) // 3, size):
        _SHOWN.extend(f"{number}{mark}" for mark in ",|;")
    return _SHOWN


Aligned = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def align(texts: list[str], first: ByteLevel, second: Pieces) -> list[Aligned | None]:
    """(ids a, ids b, tokens of a per group, tokens of b per group) of each text; None where a
    tokenizer does not give the bytes of space and text back, or the text is empty.

    The texts are cut as one row of tokens: the end of every text is a shared end.
    """
    found: list = [None] * len(texts)
    for number, text in enumerate(texts):
        if text:
            a, b = first.encode(text), second.encode(text)
            if a is not None and b is not None:
                found[number] = (a, b)
    used = [pair for pair in found if pair]
    if not used:
        return found
    a, b = (np.concatenate(ids) for ids in zip(*used))
    at_a, at_b = shared_cuts(np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b]))
    n_a, n_b, group = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1), 0
    last_groups = np.searchsorted(at_a, np.cumsum([len(ids) for ids, _ in used]) - 1) + 1
    ends = iter(last_groups.tolist())
    for number, pair in enumerate(found):
        if pair:
            end = next(ends)
            found[number] = (*pair, n_a[group:end], n_b[group:end])
            group = end
    return found


ALIGNED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
    ]
)
KINDS = "row long, doc long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None
) -> DataFrame:
    """(row, doc, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of ``docs``:
    its different pairs of linked ids and how often each is linked, as a stored table.

    A row of its own number, so that repeated keys and null keys stay apart. A null or empty text, or
    one whose tokens do not give its bytes back, has zeros, an empty digest and no pairs. Texts that
    repeat within a slice of a batch are aligned once.
    """
    paths = first or public_tokenizers.path(BYTE_LEVEL), second or public_tokenizers.path(PIECES)

    def described(aligned: Aligned | None) -> tuple:
        if aligned is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
        a, b, n_a, n_b = aligned
        sha = hashlib.sha256(groups_text(a, b, n_a, n_b).encode()).hexdigest()
        pairs, times = np.unique(links(a, b, n_a, n_b), return_counts=True)
        return len(a), len(b), len(n_a), int((n_a * n_b).sum()), sha, pairs, times.astype(np.int32)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        """Keys and texts, as many at a time as make ``SLICE`` characters, or one text."""
        for batch in batches:
            keys, some, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(doc)
                some.append(text.as_py())
                size += len(some[-1])
                if size > SLICE:
                    yield keys, some
                    keys, some, size = [], [], 0
            if keys:
                yield keys, some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, both = TaskContext.get().partitionId() << 33, tokenizers(*paths)
        for keys, some in slices(batches):
            different = list(dict.fromkeys(some))
            known = dict(zip(different, map(described, align(different, *both))))
            rows = [(row + n, doc, *known[text]) for n, (doc, text) in enumerate(zip(keys, some))]
            row += len(rows)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), ALIGNED)]
            yield pa.RecordBatch.from_arrays(columns, schema=ALIGNED)

    texts = docs.select(quoted(key).cast("long").alias("doc"), text_of(text).alias("text"))
    return materialise(texts.mapInArrow(run, KINDS), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, is_best): in how many rows a pair is linked, and whether no pair of the same
    first id is in more, as a stored table. Counted map-side first; one row per first id is broadcast,
    which the vocabulary bounds."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counted = materialise(counted, "pair-counts")
    first_id = F.shiftright("pair", SHIFT).alias("first_id")
    best = counted.groupBy(first_id).agg(F.max("count").alias("most"))
    rated = counted.join(F.broadcast(best), first_id == F.col("first_id"))
    return rated.select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def align_tokenizers(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    first: str | None = None,
    second: str | None = None,
    frequent: int = FREQUENT,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    Links meet their corpus-wide counts in two ways that together cover all: the ``frequent`` most
    common pairs, a table of fixed size, are broadcast; the rest, whose counts are small, are joined.
    See ``align_documents`` for texts without tokens. Other columns are not looked at.
    """
    aligned = align_documents(docs, key=key, text=text, first=first, second=second)
    counts = materialise(pair_counts(aligned), "pair-ratings")
    top = counts.orderBy(F.desc("count"), "pair").limit(frequent).toArrow().sort_by("pair")
    table = [top.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "is_best")]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema(
        [("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs_known, count, is_best = shared.value
        for batch in batches:
            lists, rows = batch.column(1), batch.num_rows
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            pairs, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(rows), sizes)
            at = np.minimum(np.searchsorted(pairs_known, pairs), max(0, len(pairs_known) - 1))
            known = pairs_known[at] == pairs if len(pairs_known) else np.zeros(len(pairs), bool)
            at, n = at[known], times[known].astype(np.int64)
            sums = [np.zeros(rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], of[known], n * is_best[at])
            np.add.at(sums[1], of[known], n * count[at])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=rows))]).astype(np.int32)
            left = [
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[~known]))
                for values in (pairs, times)
            ]
            columns = [batch.column(0), *map(pa.array, sums), *left]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    looked_up = aligned.select("row", "pairs", "times").mapInArrow(
        look_up, "row long, n_best long, count_sum long, pairs array<long>, times array<int>"
    )
    looked_up = materialise(looked_up, "looked-up")
    rest = looked_up.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    rest = rest.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")).join(counts, "pair")
    added = rest.select(
        "row", (F.col("times") * F.col("is_best").cast("int")).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum")
    )
    sums = added.union(looked_up.select("row", "n_best", "count_sum"))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row").select(
        F.col("doc").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
