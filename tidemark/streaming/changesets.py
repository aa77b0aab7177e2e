"""Streaming changesets: numbered per entity as soon as no later entry can change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changesets import CHANGESET_ORDER, grouped_heavy, grouped_light
from ..plans.heavy import (
    HEAVY_ROWS,
    both,
    by_key,
    join_weighted,
    match,
    number_heavy,
    number_light,
    split_heavy,
    window_over,
)
from ..schemas import DEFAULT_WINDOW_MS, ENTITY_SCOPE
from ..session import materialise
from .late import advanced, mark_late
from .store import Commit, Store, run_into

# Lists of last versions that are read side by side before they are made one.
DELTAS = 16
ENTRIES, VERSIONS = "entries", "versions"
KEPT = ["first_at", "first_id", "last_ms"]


def _names(scope: list[str]) -> list[T.StructField]:
    return [T.StructField(c, T.StringType()) for c in scope]


def _entries(scope: list[str]) -> T.StructType:
    more = "id long, transaction_id string, created_at timestamp, is_late boolean"
    return T.StructType([*_names(scope), *T.StructType.fromDDL(more).fields])


def _open(scope: list[str]) -> T.StructType:
    more = "transaction_id string, rows long, first_at timestamp, first_id long, last_ms long"
    return T.StructType([*_names(scope), *T.StructType.fromDDL(more).fields])


def _last(scope: list[str]) -> T.StructType:
    return T.StructType([*_names(scope), T.StructField("last_version", T.LongType())])


def _versions(scope: list[str]) -> T.StructType:
    more = (
        "version long, transaction_id string, rows long, changeset_transaction_id string, "
        "timestamp timestamp, is_autocommit_grouped boolean"
    )
    return T.StructType([*_names(scope), *T.StructType.fromDDL(more).fields])


def _combined(open_before: DataFrame, entries: DataFrame, scope: list[str]) -> DataFrame:
    """Open transactions with the entries of a batch: one row each, combined map-side."""
    fresh = entries.select(
        *scope,
        "transaction_id",
        F.lit(1).cast("long").alias("rows"),
        F.col("created_at").alias("first_at"),
        F.col("id").alias("first_id"),
        F.unix_millis("created_at").alias("last_ms"),
    )
    first = F.min(F.struct("first_at", "first_id")).alias("first")
    return (
        open_before.unionByName(fresh)
        .groupBy(*scope, "transaction_id")
        .agg(F.sum("rows").alias("rows"), first, F.max("last_ms").alias("last_ms"))
        .select(
            *scope,
            "transaction_id",
            "rows",
            "first.*",
            "last_ms",
            F.unix_millis("first.first_at").alias("first_ms"),
            (F.col("rows") == 1).alias("is_autocommit"),
        )
    )


def _settled(watermark_ms: int, window_ms: int, tx_timeout_ms: int) -> Column:
    """No entry above the watermark can join the changeset any more."""
    ended = F.col("end_ms") + tx_timeout_ms < watermark_ms
    return ended & (~F.col("is_autocommit") | (F.col("end_ms") + window_ms < watermark_ms))


def _sealed(df: DataFrame, scope: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with copies of the scope's columns that are never null, and their names: a join on them
    uses the exchange of a window over them, which a null-safe join would not."""
    names = {c: f"_on_{c}" for c in scope}
    filled = {n: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c, n in names.items()}
    return df.withColumns(filled), list(names.values())


def _placed(scope: list[str]) -> list[str]:
    return [*scope, "transaction_id", *KEPT, "rows", "is_autocommit", "start_ms", "start_tx", "n_operations", "version"]


def _placed_light(
    open_now: DataFrame, last: DataFrame, settled: Column, scope: list[str], window_ms: int
) -> DataFrame:
    """Open transactions of light scopes with the version of their changeset; null where it, or one
    before it, is open. Groups, horizons, numbers and last versions use one exchange of the rows."""
    sealed, on = _sealed(open_now, scope)
    members = grouped_light(by_key(sealed, on), on, window_ms, [*scope, *KEPT])
    changeset, whole, order = window_over([*on, *CHANGESET_ORDER]), window_over(on), F.struct(*CHANGESET_ORDER)
    members = members.withColumns(
        {"n_operations": F.sum("rows").over(changeset), "end_ms": F.max("last_ms").over(changeset)}
    )
    members = members.withColumn("horizon", F.min(F.when(~settled, order)).over(whole))
    # What has passed comes before all that is open, so open changesets do not count in its numbers.
    members = members.withColumn("number", F.dense_rank().over(window_over(on, CHANGESET_ORDER)))
    lasts, _ = _sealed(last, scope)
    lasts = lasts.groupBy(*on).agg(F.max("last_version").alias("last_version"))
    passed = F.col("horizon").isNull() | (order < F.col("horizon"))
    version = F.when(passed, F.coalesce("last_version", F.lit(0)) + F.col("number"))
    known = members.join(lasts, on, "left") if on else members.crossJoin(lasts)
    return known.withColumn("version", version).select(*_placed(scope))


def _placed_heavy(
    open_now: DataFrame, last: DataFrame, settled: Column, scope: list[str], window_ms: int, heavy_rows: int
) -> DataFrame:
    """The same for heavy scopes, which are cut into range pieces."""
    heavy = materialise(open_now, "heavy")
    members = materialise(grouped_heavy(heavy, scope, window_ms, KEPT), "members")
    changesets = members.groupBy(*scope, *CHANGESET_ORDER).agg(
        F.sum("rows").alias("n_operations"),
        F.max("last_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("n_members"),
    )
    changesets = materialise(changesets, "changesets")
    order = F.struct(*CHANGESET_ORDER)
    # One row per scope: its first open changeset, its last version, and how many rows will ask.
    scopes = changesets.groupBy(*scope).agg(
        F.min(F.when(~settled, order)).alias("horizon"), F.count(F.lit(1)).alias("_rows")
    )
    last = last.groupBy(*scope).agg(F.max("last_version").alias("last_version"))
    scopes = materialise(match(scopes, last, scope, "left"), "scopes")
    joined = join_weighted(changesets, scopes, scope, "_rows", ["start_id"], heavy_rows)
    passed = F.col("horizon").isNull() | (order < F.col("horizon"))
    joined = materialise(joined.withColumn("passed", passed).drop("horizon", "_rows"), "joined")
    few, many = split_heavy(joined.filter("passed"), scope, heavy_rows)
    counted = both(
        None if few is None else number_light(few, scope, CHANGESET_ORDER, "number"),
        None if many is None else number_heavy(many, scope, CHANGESET_ORDER, "number"),
    )
    version = F.coalesce("last_version", F.lit(0)) + F.col("number")
    known = counted.withColumn("version", version).drop("number").unionByName(
        joined.filter("NOT passed").withColumn("version", F.lit(None).cast("long"))
    )
    known = materialise(known.drop("last_version", "passed", "end_ms"), "known")
    on = [*scope, *CHANGESET_ORDER]
    return join_weighted(members, known, on, "n_members", ["transaction_id"], heavy_rows).select(*_placed(scope))


def stream_changesets(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    window_ms: int = DEFAULT_WINDOW_MS,
    tx_timeout_ms: int = 60_000,
    delay_ms: int = 10_000,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
    **trigger,
):
    """A query that numbers the changesets of a stream of entries into the tables of ``folder``.

    A transaction ends ``tx_timeout_ms`` after its last entry; one that goes on after that is split. A
    changeset is numbered once the watermark (newest time less ``delay_ms``) has passed everything that
    could still join or precede it, so versions never change.

    Each micro-batch is a batch job over its entries and the open transactions: rows are combined
    map-side, groups and numbers come from the operators of the batch form, which cut a hot entity into
    range pieces; nothing runs in Python. Kept between batches are one row per open transaction and
    the last version of every entity. The latter table is read once per batch, so batches should be
    as large as the wanted delay allows.

    Every entry is kept in the table of entries with ``is_late``: late are those behind the watermark
    as it stood before their batch, and those without a time. They take no part in the numbering;
    ``corrected`` of ``streaming.late`` puts touched entities right. Read the tables with
    ``streamed_versions``, ``streamed_entries`` and ``late_entries``.
    """
    store = Store(folder)
    store.open(stream.sparkSession, **{ENTRIES: _entries(scope), VERSIONS: _versions(scope)})

    def step(batch: DataFrame, number: int, before: Commit) -> Commit:
        spark = stream.sparkSession
        keys = batch.select(*[F.col(c).cast("string") for c in scope], "id", "transaction_id", "created_at")
        # Written once, so that one reading of the source decides what is late.
        path = store.write(mark_late(keys, before.watermark_ms), ENTRIES)
        entries = spark.read.schema(_entries(scope)).parquet(path)
        watermark = advanced(entries, before.watermark_ms, delay_ms)
        state, added = dict(before.state), {ENTRIES: [path]}
        open_now = _combined(store.state(spark, "open", _open(scope)), entries.filter("NOT is_late"), scope)
        open_now = materialise(open_now, "open")
        last = store.state(spark, "last", _last(scope))
        settled = F.lit(False) if watermark is None else _settled(watermark, window_ms, tx_timeout_ms)
        light, heavy = split_heavy(open_now, scope, heavy_rows)
        placed = both(
            None if light is None else _placed_light(light, last, settled, scope, window_ms),
            None if heavy is None else _placed_heavy(heavy, last, settled, scope, window_ms, heavy_rows),
        )
        placed = materialise(placed, "placed")
        numbered = placed.filter("version IS NOT NULL")
        versions = numbered.select(
            *scope,
            "version",
            "transaction_id",
            "rows",
            F.col("start_tx").alias("changeset_transaction_id"),
            F.timestamp_millis("start_ms").alias("timestamp"),
            (F.col("is_autocommit") & (F.col("n_operations") > 1)).alias("is_autocommit_grouped"),
        )
        added[VERSIONS] = [store.write(versions, VERSIONS)]
        still_open = placed.filter("version IS NULL").select(*_open(scope).fieldNames())
        state["open"] = [store.write(still_open, "open")]
        fresh = numbered.groupBy(*scope).agg(F.max("version").alias("last_version"))
        lists = state.get("last", [])
        if len(lists) >= DELTAS:
            fresh, lists = last.unionByName(fresh).groupBy(*scope).agg(F.max("last_version").alias("last_version")), []
        state["last"] = [*lists, store.write(fresh, "last")]
        return Commit(number, state, added, watermark)

    return run_into(stream, store, checkpoint, step, **trigger)


def streamed_versions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (scope, transaction) with its final version, as ``transaction_versions`` gives."""
    return Store(folder).added(spark, VERSIONS)


def streamed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of all entries that arrived, with ``is_late``."""
    return Store(folder).added(spark, ENTRIES)


def late_entries(spark: SparkSession, folder: str) -> DataFrame:
    return streamed_entries(spark, folder).filter("is_late").drop("is_late")


def changesets_of(versions: DataFrame, scope: list[str] = ENTITY_SCOPE) -> DataFrame:
    """Numbered transactions -> one row per changeset, as ``build_changesets`` gives."""
    header = ["changeset_transaction_id", "timestamp", "is_autocommit_grouped"]
    return (
        versions.groupBy(*scope, "version", *header)
        .agg(F.sum("rows").alias("n_operations"))
        .withColumnRenamed("changeset_transaction_id", "transaction_id")
    )
