"""The stored schema snapshots, and bringing them up to date together with the changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..operators.drift import record_schema_changes, schema_drift
from ..schemas import SCHEMA_CHANGE, SCHEMA_ENTITY_TYPE, SNAPSHOTS
from ..session import materialise, path_exists
from .changelog import read_changelog, write_changelog

TABLE = ["schema_name", "table_name"]


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots of a store; none if there is no store yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SNAPSHOTS)
    return spark.read.schema(SNAPSHOTS).parquet(path)


def identified(snapshots: DataFrame) -> DataFrame:
    """Snapshots with an ``id`` made of what they say, so that the same one has the same id again."""
    if "id" in snapshots.columns:
        return snapshots.select(*SNAPSHOTS.fieldNames())
    parts = [*map(F.col, TABLE), F.unix_micros("captured_at"), F.to_json("columns")]
    return snapshots.withColumn("id", content_id(*parts)).select(*SNAPSHOTS.fieldNames())


def _missing(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows that a store does not hold; an id is told apart by database and table, too."""
    return rows.join(store.select("id", *TABLE), ["id", *TABLE], "left_anti")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Appends the snapshots that the store does not hold: safe to repeat, also after a run that
    ended half-way. Takes what ``schema_snapshot`` or ``record_schema_changes`` gives."""
    spark = snapshots.sparkSession
    # Compared first: only what is new is searched for duplicates.
    fresh = _missing(identified(snapshots), read_snapshots(spark, path)).dropDuplicates(["id", *TABLE])
    # Settled before the store is written that it was compared with.
    fresh = materialise(fresh, "fresh-snapshots")
    fresh.sortWithinPartitions(*TABLE, "captured_at").write.mode("append").parquet(path)


def _newest(snapshots: DataFrame) -> DataFrame:
    """The snapshot of each table that ``latest_snapshot`` takes, as a whole row."""
    rest = [c for c in SNAPSHOTS.fieldNames() if c not in TABLE]
    newest = F.max_by(F.struct(*rest), F.struct("captured_at", "id")).alias("newest")
    return snapshots.groupBy(*TABLE).agg(newest).select(*TABLE, "newest.*").select(*SNAPSHOTS.fieldNames())


def _schema_changes(spark: SparkSession, path: str) -> DataFrame:
    return read_changelog(spark, path).filter(
        (F.col("entity_type") == SCHEMA_ENTITY_TYPE) & (F.col("operation") == SCHEMA_CHANGE)
    )


def _catch_up(spark: SparkSession, snapshots: str, changelog: str) -> None:
    """Appends the snapshots of schema changes that are recorded in the changelog but not in the store."""
    if path_exists(spark, changelog):
        listed = F.from_json("new_values", SNAPSHOTS["columns"].dataType).alias("columns")
        recorded = _schema_changes(spark, changelog).select("id", *TABLE, listed, F.col("created_at").alias("captured_at"))
        write_snapshots(recorded, snapshots)


def refresh(
    current: DataFrame, snapshots: str, changelog: str, recorded_at, watched: DataFrame | None = None
) -> DataFrame:
    """Compares a catalog with the newest snapshots, records each drifted table as a SCHEMA_CHANGE
    entry of the changelog and as a new snapshot, and returns the drift.

    The changelog is written first, and a snapshot is made from what it holds: a run that ended between
    the two is finished by the next, and a run without new drift adds nothing to either store.
    """
    spark = current.sparkSession
    _catch_up(spark, snapshots, changelog)
    # Pinned: the store grows below, and what is returned is what was found. One row per table, however
    # long the history is.
    known = materialise(_newest(read_snapshots(spark, snapshots)), "known-snapshots")
    drift = materialise(schema_drift(current, known, watched), "drift")
    entries, _ = record_schema_changes(drift, current, known, recorded_at)
    if path_exists(spark, changelog):
        entries = _missing(entries, _schema_changes(spark, changelog))
    write_changelog(materialise(entries, "schema-changes"), changelog)
    _catch_up(spark, snapshots, changelog)
    return drift
