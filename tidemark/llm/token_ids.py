"""Token ids in files of directly addressable codes: any token can be read without decoding a block."""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, text_of
from .pieces import byte_level, special_tokens, split

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"DAC1"
SUPERBLOCK = 512  # bits per entry of a rank directory
SEGMENT_TOKENS = 1 << 15
CACHED_PIECES, CACHED_LENGTH = 250_000, 48  # some 40 MB in each Python worker, which keeps them


def dac_encode(ids: np.ndarray) -> bytes:
    """Level k holds the k-th byte of every id that has one, a bitmap that tells which ids go on to
    the next level, and the number of set bits before every superblock.

    Layout: magic, number of levels, then per level its length, bytes, bitmap and directory.
    """
    levels, rest = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while True:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), SUPERBLOCK // 8), dtype=np.uint32) if len(bits) else []
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes())
        if not goes_on.any():
            return MAGIC + bytes([len(levels)]) + b"".join(levels)
        rest = rest[goes_on] >> 8


class DacReader:
    """Random access to the ids of one encoded segment."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], len(MAGIC) + 1
        for _ in range(data[len(MAGIC)]):
            (n,) = struct.unpack_from("<I", data, at)
            n_bits, n_blocks = (n + 7) // 8, -(-((n + 7) // 8) // (SUPERBLOCK // 8))
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, n_bits, at + 4 + n)
            before = np.frombuffer(data, "<u4", n_blocks + 1, at + 4 + n + n_bits)
            self.levels.append((chunks, bits, before))
            at += 4 + n + n_bits + 4 * (n_blocks + 1)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, position: int) -> int:
        """Set bits before the position: the directory's count, and those of one superblock."""
        block = position // SUPERBLOCK
        first, last = block * SUPERBLOCK // 8, position // 8
        count = int(before[block]) + int(np.bitwise_count(bits[first:last]).sum())
        return count + (int(bits[last]) & ((1 << position % 8) - 1)).bit_count() if position % 8 else count

    def get(self, position: int) -> int:
        """The id at one position."""
        value, shift = 0, 0
        for chunks, bits, before in self.levels:
            value |= int(chunks[position]) << shift
            if not bits[position // 8] >> position % 8 & 1:
                return value
            position, shift = self._rank(bits, before, position), shift + 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; on each level they are neighbours, too."""
        values, where = np.zeros(stop - start, np.uint32), np.arange(stop - start)
        for level, (chunks, bits, before) in enumerate(self.levels):
            values[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.levels) or start == stop:
                break
            first = start // 8
            on = np.unpackbits(bits[first : (stop + 7) // 8], bitorder="little")[start - 8 * first : stop - 8 * first]
            where = where[on.astype(bool)]
            start = self._rank(bits, before, start)
            stop = start + len(where)
        return values


class Encoder:
    """Ids as the tokenizer library gives them for the whole text.

    The library cuts a text at special tokens, then into pieces, and encodes each piece by itself. So
    it is asked for each different piece once, and texts are put together from what it said.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = special_tokens(json.load(file))
        self.known: dict[str, bytes] = {}
        self.shown = byte_level()

    def _special(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ask(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """The library's model on each piece as it stands in the vocabulary: cutting is done already."""
        model = self.library.model
        for piece in pieces:
            tokens = model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
            yield array("I", [token.id for token in tokens]).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        fresh = set(pieces).difference(self.known)
        if len(self.known) + len(fresh) > CACHED_PIECES:
            self.known.clear()
            fresh = set(pieces)
        self.known.update(zip(fresh, self._ask(fresh)))

    def _plain(self, text: str) -> bytes:
        pieces = split(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            ids = b"".join(map(self.known.__getitem__, pieces))
        if max(map(len, pieces), default=0) > CACHED_LENGTH:
            for piece in pieces:
                if len(piece) > CACHED_LENGTH:
                    self.known.pop(piece, None)
        return ids

    def encode_plain(self, text: str) -> np.ndarray:
        """Ids of a text in which special tokens are ordinary text."""
        return np.frombuffer(self._plain(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for special in self.special.finditer(text):
            parts += [self._plain(text[at : special.start()]), self._special(special[0])]
            at = special.end()
        return np.frombuffer(b"".join([*parts, self._plain(text[at:])]), np.uint32)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_ids(
    docs: DataFrame,
    folder: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
) -> None:
    """Writes the ids of all texts, each closed by ``end_id``, in ascending order of the key.

    The folder's table has one row per segment: (shard, segment, first, n_tokens, keys, ends,
    payload). Shards are contiguous ranges of the order, segments contiguous runs of whole documents
    of about ``SEGMENT_TOKENS`` ids; ``first`` counts the shard's ids before the segment, ``ends`` says
    where each document ends within it, ``payload`` is what ``dac_encode`` gives.

    Null texts are empty and leave only the end id. Null keys come first; equal keys are ordered by a
    hash of their texts, equal rows stay as many. Other columns are not looked at; an empty table
    gives a folder without rows.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    schema = pa.schema(
        [
            ("shard", pa.int64()),
            ("segment", pa.int64()),
            ("first", pa.int64()),
            ("n_tokens", pa.int64()),
            ("keys", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int32())),
            ("payload", pa.binary()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        keys, parts, ends, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            payload = dac_encode(np.concatenate(parts))
            values = [[shard], [segment], [first], [size], [keys], [ends], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder(path).encode(text.as_py())
                parts += [ids, np.array([end_id], np.uint32)]
                size += len(ids) + 1
                keys.append(doc)
                ends.append(size)
                if size >= SEGMENT_TOKENS:
                    yield row()
                    segment, first = segment + 1, first + size
                    keys, parts, ends, size = [], [], [], 0
        if keys:
            yield row()

    rows = docs.select(quoted(key).cast("long").alias("key"), text_of(text).alias("text"))
    order = [F.col("key"), F.xxhash64("text")]
    kinds = (
        "shard long, segment long, first long, n_tokens long, keys array<long>, ends array<int>, payload binary"
    )
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, kinds).write.parquet(folder)


def read_token_ids(spark: SparkSession, folder: str, *, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in a folder of token ids.

    ``start`` counts the ids of all documents before it, ``n_tokens`` and the checksum (of the ids as
    little-endian 32-bit integers) include the end id. Starts of the shards come from a running sum
    over one row per shard, that is one per partition that wrote.
    """
    segments = spark.read.parquet(folder)
    sizes = segments.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    along = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("size").over(along), F.lit(0)).alias("before"))
    fields = [("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema(fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                base, keys, ends, payload = (batch.column(c)[number].as_py() for c in range(4))
                reader, start = DacReader(payload), 0
                columns: list[list] = [[] for _ in schema]
                for doc, end in zip(keys, ends):
                    ids = reader.slice(start, end)
                    row = (doc, base + start, end - start, zlib.crc32(ids.astype("<u4").tobytes()), ids)
                    for column, value in zip(columns, row):
                        column.append(value)
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    placed = segments.join(F.broadcast(starts), "shard").select(
        (F.col("before") + F.col("first")).alias("base"), "keys", "ends", "payload"
    )
    kinds = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return placed.mapInArrow(decode, kinds).withColumnRenamed("key", key)


def token_at(spark: SparkSession, folder: str, doc: int, position: int) -> int | None:
    """One token of one document: finds the segment, then looks the id up in it alone."""
    index = F.array_position("keys", F.lit(doc)).cast("int")
    found = spark.read.parquet(folder).filter(F.array_contains("keys", F.lit(doc)))
    row = found.select("payload", F.get("ends", index - 2).alias("start"), F.get("ends", index - 1).alias("end")).first()
    at = position + ((row["start"] or 0) if row else 0)
    return DacReader(row["payload"]).get(at) if row and position >= 0 and at < row["end"] else None
