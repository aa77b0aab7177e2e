"""Vectors as short codes: each part of a vector is named by the nearest entry of that part's codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.heavy import join_weighted
from tidemark.session import materialise

from .code_tree import CodeTree
from .common import quoted

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SMALL = 1 << 24  # components up to here are added as 64-bit numbers
LARGEST = 10**27  # larger components count as this
LONGEST = (1 << 63) - 1


def scaled(flat: np.ndarray) -> np.ndarray:
    """floor(1024 x) of finite doubles, as 64-bit numbers if all are small, else as Python's."""
    whole = np.floor(flat * SCALE)
    if np.abs(whole).max(initial=0) <= SMALL:
        return whole.astype(np.int64)
    exact = [int(x) * SCALE if x == np.floor(x) else int(np.floor(x * SCALE)) for x in flat]
    return np.array([max(-LARGEST, min(LARGEST, n)) for n in exact], dtype=object)


def cut(vectors: np.ndarray) -> list[np.ndarray]:
    """The four parts of all vectors; a length that is no multiple of four is filled up with zeros."""
    size = -(-vectors.shape[1] // PARTS)
    filled = np.zeros((len(vectors), PARTS * size), vectors.dtype)
    filled[:, : vectors.shape[1]] = vectors
    return [filled[:, part * size : (part + 1) * size] for part in range(PARTS)]


def _parts_of(column: pa.Array, length: int) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return cut(scaled(flat).reshape(len(column), length))


def _usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    rows = vectors.select(
        quoted(key).cast("long").alias("id"),
        quoted(vector).cast("array<double>").alias("vector"),
        quoted(label).cast("string").alias("label"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite).withColumn("length", F.size("vector"))


def first_codebooks(rows: DataFrame, length: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows with the smallest keys; equal keys in the order of their vectors."""
    first = rows.filter("id IS NOT NULL").orderBy("id", "vector").limit(entries).select("vector").toArrow()
    return _parts_of(first.column("vector").combine_chunks(), length) if first.num_rows else []


def next_codebooks(rows: DataFrame, length: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floor of the mean of the parts that are nearest to it.

    A task sends one row of sums per entry that it met; Spark adds these up, one row per entry comes
    back. Sums are decimals, so that no number of rows overflows them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)  # four times 256 entries
    size = codebooks[0].shape[1]
    names = ["part", "entry", "count", *(f"s{n}" for n in range(size))]
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.string()] * size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [CodeTree(entries) for entries in shared.value]
        total = [np.zeros((len(tree.entries), size), object) for tree in trees]
        count = np.zeros((PARTS, len(trees[0].entries)), np.int64)
        for batch in batches:
            for part, (tree, queries) in enumerate(zip(trees, _parts_of(batch.column(0), length))):
                index, _ = tree.nearest(queries)
                count[part] += np.bincount(index, minlength=len(tree.entries))
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                if len(used):
                    total[part][used] += np.add.reduceat(queries[order], at, axis=0).astype(object)
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry]]
        columns += [[str(total[p][e][n]) for p, e in zip(part, entry)] for n in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "part int, entry int, count long" + "".join(f", s{n} string" for n in range(size))
    sent = rows.select("vector").mapInArrow(sums, schema)
    added = sent.groupBy("part", "entry").agg(
        F.sum("count").alias("count"), *[F.sum(F.col(n).cast("decimal(38,0)")).cast("string").alias(n) for n in names[3:]]
    )
    found = added.toArrow().to_pydict()  # 1,024 rows at most
    new = [entries.astype(object) for entries in codebooks]
    for number, (part, entry, count) in enumerate(zip(found["part"], found["entry"], found["count"])):
        new[part][entry] = [int(found[n][number]) // count for n in names[3:]]
    small = all(abs(n) <= SMALL for entries in new for n in entries.ravel())
    return [entries.astype(np.int64) for entries in new] if small else new


def digest(codebooks: list[np.ndarray]) -> str:
    numbers = ",".join(str(n) for entries in codebooks for n in entries.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def fit_codebooks(rows: DataFrame, length: int, *, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    codebooks = first_codebooks(rows, length, entries)
    for _ in range(rounds if codebooks else 0):
        codebooks = next_codebooks(rows, length, codebooks)
    return codebooks


def encode(rows: DataFrame, length: int, codebooks: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of rows with vectors of one length."""
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)
    names = ["id", "label", "code", "error"]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [CodeTree(entries) for entries in shared.value]
        for batch in batches:
            code, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, object)
            for part, queries in enumerate(_parts_of(batch.column(2), length) if trees else []):
                index, squared = trees[part].nearest(queries)
                code[:, part] = index
                error += squared
            values = [min(int(e), LONGEST) for e in error]
            columns = [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], names)

    coded = rows.select("id", "label", "vector")
    return coded.mapInArrow(codes, "id long, label string, code string, error long")


def compress(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable row.

    Components become whole numbers floor(1024 x). Codebooks start as the parts of the ``entries``
    rows of smallest key and are improved by all rows in each round; the last codebooks name the parts.
    All distances are whole and exact.

    A null vector or one with a null or non-finite component takes no part. Vectors of another length
    have codebooks of their own, one length after the other; a length that is no multiple of four is
    filled up with zeros. Repeated keys are a row each, and start codebooks in the order of their
    vectors; a null key starts none, but is coded. With no usable key at all the code is zero and so
    is the error. Errors beyond a long are the largest long, components beyond 10^27 count as that.
    Null labels are one label. Other columns are not looked at.
    """
    rows = materialise(_usable(vectors, key, vector, label), "vectors")
    lengths = sorted(r["length"] for r in rows.select("length").distinct().toLocalIterator())
    coded = []
    for length in lengths or [0]:
        same = rows.filter(F.col("length") == length)
        codebooks = fit_codebooks(same, length, entries=entries, rounds=rounds)
        coded.append(encode(same, length, codebooks).withColumn("codebooks_sha256", F.lit(digest(codebooks))))
    every = coded[0]
    for more in coded[1:]:
        every = every.union(more)
    every = materialise(every, "codes")
    # Decimals cannot overflow on the way; a label's sum beyond a long is the largest long.
    of_label = every.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"),
    )
    joined = join_weighted(every, of_label, ["label"], "rows", ["id"])
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")
