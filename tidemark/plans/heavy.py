"""Ordered and keyed work that stays distributed when one key holds most of the rows.

A window function sends each key to one task. That is the cheapest plan for ordinary keys and no
plan at all for a key with a third of the table. The helpers here measure the keys first, leave
the light ones to windows, and cut the heavy ones into range partitions: contiguous pieces in
(key, order), each small, joined up again by one summary row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# Rows of one key that a single task may sort.
HEAVY_ROWS = 2_000_000
# Rows of all its keys that a task of a window over wide rows gets, one key apart.
WINDOW_ROWS = 200_000
# Rows of a side that may be broadcast.
BROADCAST_ROWS = 1_000_000
# Heavy keys that may be listed in the plan; beyond it they stay a distributed frame.
LISTED_KEYS = 10_000

PART = "_part"


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe equi-join on ``keys``; the key columns are kept once, from the left."""
    renamed = {k: f"_key_{k}" for k in keys}
    condition = F.lit(True)
    for key, other in renamed.items():
        condition = condition & F.col(key).eqNullSafe(F.col(other))
    joined = left.join(right.withColumnsRenamed(renamed), condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def heavy_keys(df: DataFrame, keys: list[str], limit: int = HEAVY_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None. There are at most rows/limit of them."""
    counted = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
        .select(*keys)
    )
    found = counted.take(LISTED_KEYS + 1)
    if not found:
        return None
    if len(found) > LISTED_KEYS:
        return counted
    return F.broadcast(df.sparkSession.createDataFrame(found, counted.schema))


def split_heavy(
    df: DataFrame, keys: list[str], limit: int = HEAVY_ROWS
) -> tuple[DataFrame | None, DataFrame | None]:
    """``(rows of light keys, rows of heavy keys)``; None for a side known to be empty."""
    if not keys:
        big = df.select(F.lit(1)).limit(limit + 1).count() > limit
        return (None, df) if big else (df, None)
    heavy = heavy_keys(df, keys, limit)
    if heavy is None:
        return df, None
    return match(df, heavy, keys, "left_anti"), match(df, heavy, keys, "left_semi")


def by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One exchange on ``keys``, reused by every window and aggregate whose keys start there."""
    return df.repartition(*keys) if keys else df.repartition(1)


def window_over(keys: list[str], order: list[str] | None = None):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(*order) if order else window


def ordered_pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` range-partitioned on (keys, order), with the piece number in ``_part``.

    ``order`` must tell all rows of a key apart, so that any key can be cut. The range bounds come
    from a sample, so the result is written out once: all readers then see the same pieces.
    """
    # A given number, so that adaptive execution does not merge the pieces again.
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(pieces, *keys, *order)
    return materialise(ranged.withColumn(PART, F.spark_partition_id()), "pieces")


def carried(pieces: DataFrame, keys: list[str], **carry: tuple[Column, str]) -> DataFrame:
    """Per piece, what the earlier pieces of the same key pass on.

    Each ``name=(aggregate, how)`` is summarised per (key, piece) and carried over: ``how`` is
    ``sum`` or ``max`` over all earlier pieces.
    """
    summary = pieces.groupBy(*keys, PART).agg(*[agg.alias(n) for n, (agg, _) in carry.items()])
    earlier = window_over(keys, [PART]).rowsBetween(Window.unboundedPreceding, -1)
    columns = [getattr(F, how)(name).over(earlier).alias(name) for name, (_, how) in carry.items()]
    return summary.select(*keys, PART, *columns)


def with_carried(
    pieces: DataFrame, keys: list[str], **carry: tuple[Column, str]
) -> DataFrame:
    """``pieces`` with what is carried into each.

    The carried frame may be broadcast unchecked: pieces are contiguous, so its rows are fewer than
    the pieces (one per range partition) plus the heavy keys (at most rows/limit).
    """
    return match(pieces, F.broadcast(carried(pieces, keys, **carry)), [*keys, PART], "left")


def number_light(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(window_over(keys, order)).cast("long"))


def number_heavy(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Exact row numbers per key, one task per piece."""
    pieces = ordered_pieces(df, keys, order)
    joined = with_carried(pieces, keys, _before=(F.count(F.lit(1)), "sum"))
    inside = F.row_number().over(window_over([*keys, PART], order))
    return joined.withColumn(out, inside + F.coalesce("_before", F.lit(0))).drop("_before", PART)


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt out by ``keys`` to tasks of about ``WINDOW_ROWS`` rows, if it has more than the usual
    number of tasks would take."""
    if not keys:
        return df
    tasks = -(-df.count() // WINDOW_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A given number of partitions is not merged by adaptive execution.
    return df.repartition(tasks, *keys) if tasks > usual else df


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], limit: int = HEAVY_ROWS
) -> DataFrame:
    """``df`` with a struct ``previous``: ``columns`` of the row before, null for a key's first.

    Light keys are dealt to as many tasks as their rows ask for, whatever number of partitions the
    session has, so that what one task sorts does not grow with the table.
    """
    value = F.struct(*columns)
    light, heavy = split_heavy(df, keys, limit)
    if light is not None:
        light = _dealt(light, keys)
        light = light.withColumn("previous", F.lag(value).over(window_over(keys, order)))
    if heavy is not None:
        pieces = ordered_pieces(heavy, keys, order)
        last = F.max(F.struct(*order, value.alias("_value")))
        joined = with_carried(pieces, keys, _last=(last, "max"))
        inside = F.lag(value).over(window_over([*keys, PART], order))
        heavy = joined.withColumn("previous", F.coalesce(inside, "_last._value"))
        heavy = heavy.drop("_last", PART)
    return both(light, heavy)


def both(light: DataFrame | None, heavy: DataFrame | None) -> DataFrame:
    if light is None:
        return heavy
    return light if heavy is None else light.unionByName(heavy)


def join_weighted(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    weight: str,
    spread: list[str],
    limit: int = HEAVY_ROWS,
) -> DataFrame:
    """Inner join of ``facts`` to the one ``dim`` row per key, salting the keys that are heavy.

    ``dim.weight`` is the number of fact rows of the key, so the heavy keys are at most
    rows/limit. Their dim row is copied once per salt and their facts are spread over the salts
    by a hash of ``spread``; every fact still meets exactly one copy.
    """
    copies = F.ceil(F.col(weight) / F.lit(max(limit, 1))).cast("int")
    hot = broadcast_checked(
        dim.filter(F.col(weight) > limit).select(*on, copies.alias("_copies"))
    )
    salted_facts = match(facts, hot, on, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_copies")), F.lit(0)).cast("int"),
    )
    salted_dim = dim.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))
    )
    return match(salted_facts.drop("_copies"), salted_dim, [*on, "_salt"], "inner").drop("_salt")
