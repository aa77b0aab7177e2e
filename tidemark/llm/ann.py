"""Nearest neighbours by randomly rotated one-bit codes, reranked where an error bound asks for it."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

from .common import broadcast_if_small, quoted

ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 16_384, 8_192
QUERIES_AT_ONCE = 64
BOUND = 2.5  # standard errors of an estimate within which a vector is reranked
SEED = 20_240_501


@cache
def rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix over the dimension, filled up to whole bytes of bits."""
    size = -(-dimension // 8) * 8
    gaussian = np.random.default_rng(SEED).standard_normal((size, size))
    q, r = np.linalg.qr(gaussian)
    return (q * np.sign(np.diag(r)))[:dimension]


class Codes:
    """One bit per rotated component of every vector, and two scalars to make up for the rest.

    With c the inner product of a rotated unit vector and the unit vector of its signs, the product
    of a query with the signs, divided by c, estimates its product with the vector without bias; its
    error is about sqrt(1 - c^2) / c / sqrt(d - 1).
    """

    def __init__(self, vectors: np.ndarray):
        turned = vectors @ rotation(vectors.shape[1])
        size = turned.shape[1]
        norm = np.linalg.norm(vectors, axis=1)
        c = np.abs(turned).sum(axis=1) / (norm * np.sqrt(size))
        self.bits = np.packbits(turned > 0, axis=1)
        self.scale = norm / c / np.sqrt(size)
        self.error = norm * np.sqrt(np.maximum(0, 1 - c * c)) / c / np.sqrt(max(1, size - 1))

    def estimate(self, turned_queries: np.ndarray) -> np.ndarray:
        """Estimated inner products, vectors by queries: sums of the queries' components with the signs
        that the bits tell."""
        signs = np.unpackbits(self.bits, axis=1).astype(np.float32) * 2 - 1
        return (signs @ turned_queries.T.astype(np.float32)).astype(np.float64) * self.scale[:, None]


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal ones."""
    return (vectors * query).sum(axis=1)


def nearest_in_block(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query row, id, score) of the k nearest vectors of the block to each query but its own row."""
    codes, turned = Codes(vectors), queries @ rotation(queries.shape[1])
    lengths, found = np.linalg.norm(queries, axis=1), []
    few = min(4 * k, len(rows))
    for start in range(0, len(queries), QUERIES_AT_ONCE):
        estimates = codes.estimate(turned[start : start + QUERIES_AT_ONCE])
        for number, estimate in enumerate(np.ascontiguousarray(estimates.T), start):
            query, query_row = queries[number], query_rows[number]
            own = rows == query_row
            estimate[own] = -np.inf
            first = np.argpartition(-estimate, few - 1)[:few]
            scores = np.sort(_exact(query, vectors[first[rows[first] != query_row]]))
            least = scores[-k] if len(scores) >= k else -np.inf
            chosen = np.flatnonzero((estimate + BOUND * lengths[number] * codes.error >= least) & ~own)
            exact = _exact(query, vectors[chosen])
            best = np.lexsort((ids[chosen], -exact))[:k]
            found.append((np.full(len(best), query_row), ids[chosen][best], exact[best]))
    return [np.concatenate(column) for column in zip(*found)]


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, vector, length) of the rows that take part, each with a number of its own."""
    rows = vectors.select(
        quoted(key).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.withColumns({"length": F.size("vector"), "row": F.monotonically_increasing_id()})


def nearest(
    vectors: DataFrame,
    is_query,
    *,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, key, score): for each row that ``is_query`` holds for (a condition on ``id``)
    its k rows of largest inner product, ties to the smaller key, all if there are fewer.

    Rows are dealt into blocks, queries too, and every pair of blocks is one task of fixed size: it
    estimates all products from the codes, reranks the vectors whose upper bound reaches the k-th best
    exact product so far, and hands on k rows a query. Every row is coded; nothing is fitted.

    A null key, a null or zero vector, or one with a null or non-finite component takes no part. Vectors
    of one length are searched among each other, each length by itself. Every row is asked and every
    other row may be found: rows that repeat a key, or a whole row, are queries and neighbours each, so
    a key that stands for several query rows has a list for each. Other columns are not looked at.
    """
    # Stored, so that the numbers of the rows are the same each time they are read.
    rows = materialise(_usable(vectors, key, vector), "vectors")
    cut = lambda name, size: F.greatest(F.ceil(F.col(name) / F.lit(size)), F.lit(1)).cast("int").alias(name)
    sizes = rows.groupBy("length").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(is_query(F.col("id"))).alias("query_blocks")
    )
    sizes = materialise(sizes.select("length", cut("blocks", ROWS_PER_BLOCK), cut("query_blocks", QUERIES_PER_BLOCK)), "lengths")
    rows = rows.join(broadcast_if_small(sizes, F.lit(0)), "length")
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = rows.select("length", "row", "id", "vector", dealt("blocks").alias("block"), every("query_blocks").alias("query_block"))
    asked = rows.filter(is_query(F.col("id")))
    asked = asked.select("length", "row", "id", "vector", dealt("query_blocks").alias("query_block"), every("blocks").alias("block"))
    # Columns of their own, for both sides come from one table.
    asked = asked.toDF(*asked.columns)
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("vector").combine_chunks()
        flat = column.chunk(0).flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
        return flat.to_numpy().reshape(table.num_rows, -1)

    def search(some_queries: pa.Table, some_rows: pa.Table) -> pa.Table:
        if not some_queries.num_rows or not some_rows.num_rows:
            return schema.empty_table()
        numbers = [t.column("row").to_numpy() for t in (some_queries, some_rows)]
        ids = some_rows.column("id").to_numpy()
        found = nearest_in_block(matrix(some_queries), numbers[0], matrix(some_rows), numbers[1], ids, k)
        return pa.table([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

    cell = ["length", "query_block", "block"]
    found = asked.groupBy(*cell).cogroup(base.groupBy(*cell)).applyInArrow(search, "row long, id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    query_ids = rows.filter(is_query(F.col("id"))).select("row", F.col("id").alias("query_id")).toDF("row", "query_id")
    return ranked.join(query_ids, "row").select("query_id", "rank", F.col("id").alias(key), "score")
