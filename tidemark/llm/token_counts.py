"""Exact token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import quoted, text_of
from .pieces import special_tokens, split

TOKENIZER = "byte_bpe_50k.json"
CACHED_PIECES = 500_000
CACHED_PAIRS = 1_000_000
CACHED_PREFIXES = 1_000_000
CACHED_LENGTH = 48
# Contractions that fall apart when their last letter is cut off.
SPLIT_CONTRACTIONS = ("'re", "'ve", "'ll")

def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class PrefixCounter:
    """Token counts of every prefix for one byte-level BPE file.

    In an encoding, every token encodes to itself and every two neighbours encode to themselves;
    a sequence with both properties is the encoding. So the last token of each prefix of a piece is
    the one that fits behind the last token of some shorter prefix, and its count is one more.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = _byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        model = described["model"]
        self.ids = {to_bytes(token): number for token, number in model["vocab"].items()}
        self.merges = {}
        self.made = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            left, right = to_bytes(left), to_bytes(right)
            pair, merged = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.merges[pair] = (rank, merged)
            self.made[merged] = (rank, *pair)
        self.bytes_of = {number: token for token, number in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.whole = special_tokens(described)
        self.fits: dict[tuple[int, int], bool] = {}
        self.stands: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.prefixes: dict[bytes, tuple[int, int]] = {}
        self.spaces = regex.compile(r"\s\s")

    def encode_bytes(self, data: bytes) -> list[int]:
        """Merge by rank; for the short strings of one or two tokens."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        none = (len(self.merges), -1)
        while len(ids) > 1:
            options = [self.merges.get(pair, none) for pair in zip(ids, ids[1:])]
            best = min(options)
            if best == none:
                break
            at = options.index(best)
            ids[at : at + 2] = [best[1]]
        return ids

    def _stands(self, token: int) -> bool:
        if token not in self.stands:
            self.stands[token] = self.encode_bytes(self.bytes_of[token]) == [token]
        return self.stands[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, put together, encode to themselves.

        Undoes merges from the last to the first and asks whether the neighbours at the border would
        have merged before the merge that was undone; at equal rank the one further left goes first.
        """
        pair = (left, right)
        fits = self.fits.get(pair)
        if fits is None:
            if len(self.fits) > CACHED_PAIRS:
                self.fits.clear()
            merges, made, before, fits = self.merges, self.made, len(self.merges), True
            while fits:
                merge = merges.get((left, right))
                if merge is not None and merge[0] < before:
                    fits = False
                    break
                undo_left, undo_right = made.get(left), made.get(right)
                if undo_left is not None and (undo_right is None or undo_left[0] > undo_right[0]):
                    before, left = undo_left[0], undo_left[2]
                elif undo_right is not None:
                    before, right = undo_right[0] + 1, undo_right[1]
                else:
                    break
            self.fits[pair] = fits
        return fits

    def byte_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:0], data[:1], ... up to the whole.

        The last token and the count of a prefix do not depend on what follows it, so they are
        remembered by prefix and shared between pieces that begin alike.
        """
        last, counts = [-1], [0]
        ids, longest, prefixes = self.ids, self.longest, self.prefixes
        if len(prefixes) > CACHED_PREFIXES:
            prefixes.clear()
        for end in range(1, len(data) + 1):
            known = prefixes.get(data[:end]) if end <= CACHED_LENGTH else None
            if known is None:
                # Exactly one start fits. Mostly the last token grows, or the new byte stands alone.
                grown = end - 1 - len(self.bytes_of[last[-1]]) if end > 1 else 0
                for start in (grown, end - 1, *range(max(0, end - longest), end - 1)):
                    token = ids.get(data[start:end])
                    if token is not None and (
                        self._fits(last[start], token) if start else self._stands(token)
                    ):
                        known = (token, counts[start] + 1)
                        break
                if end <= CACHED_LENGTH:
                    prefixes[data[:end]] = known
            last.append(known[0])
            counts.append(known[1])
        return counts

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of one piece, by code points, without the empty one."""
        found = self.byte_counts(piece.encode())
        if not piece.isascii():
            ends, at = [0], 0
            for letter in piece:
                at += len(letter.encode())
                ends.append(at)
            found = [found[end] for end in ends]
        if piece in SPLIT_CONTRACTIONS:
            found[2] = 2
        return found[1:]

    def _learn(self, pieces: list[str]) -> bool:
        """Remembers the counts of short pieces; whether all pieces are short."""
        short = True
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        for piece in pieces:
            if len(piece) > CACHED_LENGTH:
                short = False
            elif piece not in self.known:
                self.known[piece] = bytes(self.piece_counts(piece))
        return short

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the non-empty prefixes of a text without special tokens."""
        if not text:
            return np.zeros(0, np.int32)
        pieces = split(text)
        try:
            counts = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint8)
        except KeyError:
            if self._learn(pieces):
                counts = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint8)
            else:
                known = self.known
                counts = np.concatenate(
                    [list(known[p]) if p in known else self.piece_counts(p) for p in pieces]
                )
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        totals = counts[ends - 1].astype(np.int64)
        base = np.cumsum(totals) - totals
        counts = counts + np.repeat(base, lengths)
        if self.spaces.search(text):
            # A prefix that ends in white space has the whole run as its last piece.
            for n in range(len(pieces) - 1):
                if pieces[n].isspace() and pieces[n + 1][0].isspace():
                    run = self.piece_counts(pieces[n] + pieces[n + 1][0])
                    counts[ends[n]] = base[n] + run[-1]
        return counts

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ... text[:len(text)], special tokens taken as one."""
        out, at, before = [np.zeros(1, np.int64)], 0, 0
        for special in self.whole.finditer(text):
            # Until its last character, the special string is ordinary text.
            begun = self._plain(text[at : special.end() - 1])
            whole = self._plain(text[at : special.start()])
            count = whole[-1] if len(whole) else 0
            out += [before + begun, np.array([before + count + 1])]
            before, at = before + int(count) + 1, special.end()
        out.append(before + self._plain(text[at:]))
        return np.concatenate(out).astype(np.int32)


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def pack(counts: np.ndarray) -> bytes:
    """Differences of the counts, as bytes if they fit."""
    steps = np.diff(counts)
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    return bytes([1 if small else 4]) + zlib.compress(steps.astype("<i1" if small else "<i4").tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(packed[1:]), "<i1" if packed[0] == 1 else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def cut_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
    keep_prefixes: bool = False,
    path: str | None = None,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, cut_chars[, prefix_counts]), one row per row of ``docs``.

    Each text is worked through once; the token count of every prefix is then a lookup: the whole
    text's gives ``n_tokens``, the longest prefix within ``limit`` gives ``cut_chars``, and with
    ``keep_prefixes`` the packed counts are stored, for any other budget or position later
    (``count_at``, ``cut_at``).

    Null texts are empty and have no tokens; long texts take memory in proportion to their length;
    keys may repeat or be null, other columns are not looked at.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    fields = [("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("cut_chars", pa.int64())]
    fields += [("prefix_counts", pa.binary())] if keep_prefixes else []
    schema = pa.schema(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = counter(path)
        for batch in batches:
            size, tokens, cut, packed = [], [], [], []
            for value in batch.column(1):
                value = value.as_py()
                counts = counting.prefix_counts(value)
                size.append(len(value.encode()))
                tokens.append(int(counts[-1]))
                cut.append(cut_within(counts, limit) if counts[-1] > limit else len(value))
                if keep_prefixes:
                    packed.append(pack(counts))
            columns = [batch.column(0), size, tokens, cut] + [packed] * keep_prefixes
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema)],
                schema=schema,
            )

    kinds = "key long, n_bytes long, n_tokens long, cut_chars long"
    counted = docs.select(quoted(key).cast("long").alias("key"), text_of(text).alias("text")).mapInArrow(
        count, kinds + ", prefix_counts binary" * keep_prefixes
    )
    return counted.select(
        F.col("key").alias(key),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        "cut_chars",
        *["prefix_counts"] * keep_prefixes,
    )


@F.pandas_udf(LongType())
def count_at(packed: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` characters, out of the stored counts."""
    return pd.Series([int(unpack(p)[n]) for p, n in zip(packed, chars)], dtype="int64")


@F.pandas_udf(LongType())
def cut_at(packed: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix within the budget, out of the stored counts."""
    return pd.Series([cut_within(unpack(p), b) for p, b in zip(packed, budget)], dtype="int64")
