"""Streaming time groups of autocommit entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULT_WINDOW_MS, ENTITY_SCOPE
from ..session import materialise
from .late import advanced, mark_late
from .store import Commit, Store, run_into


def stream_sessions(
    stream: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    delay: str = "10 seconds",
    scope: list[str] = ENTITY_SCOPE,
) -> DataFrame:
    """Closed time groups of a feed in which every row is a transaction of its own.

    The event time is cut to milliseconds first, so that a gap of exactly the window still joins,
    as in batch. Append mode; entries later than ``delay`` are dropped by the watermark
    (``collect_sessions`` keeps them). With local
    merging of session windows on, a hot entity arrives at its task as a few partial sessions.
    """
    at = F.timestamp_millis(F.unix_millis("created_at"))
    grouped = (
        stream.withColumn("at", at)
        .withWatermark("at", delay)
        .groupBy(*scope, F.session_window("at", f"{window_ms} milliseconds"))
    )
    return grouped.agg(
        F.count(F.lit(1)).alias("n_operations"),
        F.min(F.struct("created_at", "id", "transaction_id")).alias("first"),
    ).select(
        *scope,
        F.col("session_window.start").alias("timestamp"),
        F.col("first.id").alias("first_id"),
        F.col("first.transaction_id").alias("transaction_id"),
        "n_operations",
        (F.col("n_operations") > 1).alias("is_autocommit_grouped"),
    )


SESSIONS, ROWS = "sessions", "rows"


def _names(scope: list[str], more: str) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.StringType()) for c in scope], *T.StructType.fromDDL(more).fields])


def collect_sessions(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    window_ms: int = DEFAULT_WINDOW_MS,
    delay_ms: int = 10_000,
    scope: list[str] = ENTITY_SCOPE,
    **trigger,
):
    """A query that gives the groups of ``stream_sessions`` as a table of ``folder``, and keeps late rows.

    Rows behind the watermark are not dropped but stored with ``is_late``. Each micro-batch merges its
    rows to sessions map-side, then merges these with the open ones, so that a hot entity costs one row
    per session. A session is closed once the watermark is a whole window past its last row. Read the
    tables with ``streamed_sessions`` and ``streamed_rows``.
    """
    rows_of = _names(scope, "id long, transaction_id string, created_at timestamp, is_late boolean")
    open_of = _names(
        scope,
        "start_ms long, end_ms long, n_operations long, "
        "first struct<created_at: timestamp, id: long, transaction_id: string>",
    )
    closed_of = _names(
        scope,
        "timestamp timestamp, first_id long, transaction_id string, n_operations long, is_autocommit_grouped boolean",
    )
    store = Store(folder)
    store.open(stream.sparkSession, **{ROWS: rows_of, SESSIONS: closed_of})

    def step(batch: DataFrame, number: int, before: Commit) -> Commit:
        spark = stream.sparkSession
        keys = batch.select(*[F.col(c).cast("string") for c in scope], "id", "transaction_id", "created_at")
        path = store.write(mark_late(keys, before.watermark_ms), ROWS)
        rows = spark.read.schema(rows_of).parquet(path)
        watermark = advanced(rows, before.watermark_ms, delay_ms)
        at = F.timestamp_millis(F.unix_millis("created_at"))
        # In milliseconds, as in batch: rows exactly a window apart are together.
        merged = (
            rows.filter("NOT is_late")
            .withColumn("at", at)
            .groupBy(*scope, F.session_window("at", f"{window_ms} milliseconds").alias("w"))
            .agg(
                F.count(F.lit(1)).alias("n_operations"),
                F.min(F.struct("created_at", "id", "transaction_id")).alias("first"),
                F.unix_millis(F.max("at")).alias("end_ms"),
            )
            .select(*scope, F.unix_millis("w.start").alias("start_ms"), "end_ms", "n_operations", "first")
        )
        every = store.state(spark, "open", open_of).unionByName(merged)
        order = Window.partitionBy(*scope).orderBy("start_ms", "end_ms")
        reached = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.coalesce(F.col("start_ms") - reached > window_ms, F.lit(True)).cast("int")
        together = every.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(order))
        sessions = together.groupBy(*scope, "nth").agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.sum("n_operations").alias("n_operations"),
            F.min("first").alias("first"),
        )
        sessions = materialise(sessions.drop("nth"), "sessions")
        closed = F.lit(False) if watermark is None else F.col("end_ms") + window_ms <= watermark
        done = sessions.filter(closed).select(
            *scope,
            F.timestamp_millis("start_ms").alias("timestamp"),
            F.col("first.id").alias("first_id"),
            F.col("first.transaction_id").alias("transaction_id"),
            "n_operations",
            (F.col("n_operations") > 1).alias("is_autocommit_grouped"),
        )
        still_open = sessions.filter(~closed).select(*open_of.fieldNames())
        state = {"open": [store.write(still_open, "open")]}
        return Commit(number, state, {ROWS: [path], SESSIONS: [store.write(done, SESSIONS)]}, watermark)

    return run_into(stream, store, checkpoint, step, **trigger)


def streamed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Closed time groups, as ``stream_sessions`` gives."""
    return Store(folder).added(spark, SESSIONS)


def streamed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of all rows that arrived, with ``is_late``."""
    return Store(folder).added(spark, ROWS)
