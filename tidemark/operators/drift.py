"""Schema snapshots over time: drift, recorded schema changes, and coverage of the capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_hash, content_id
from ..plans.heavy import HEAVY_ROWS, with_previous
from ..schemas import ANY_ID, CHANGELOG_COLUMNS, SCHEMA_CHANGE, SCHEMA_ENTITY_TYPE
from ..sources.catalog import column_list

TABLE = ["schema_name", "table_name"]


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Each table's newest column list; one associative aggregate."""
    newest = F.struct("captured_at", "id")
    return snapshots.groupBy(*TABLE).agg(
        F.max_by("columns", newest).alias("columns"), F.max(newest).alias("n")
    ).select(*TABLE, "columns", F.col("n.captured_at").alias("captured_at"))


def _watch(df: DataFrame, watched: DataFrame | None) -> DataFrame:
    if watched is None:
        return df
    return df.join(watched.select(*TABLE).distinct(), TABLE, "left_semi")


def schema_drift(
    current: DataFrame, snapshots: DataFrame, watched: DataFrame | None = None
) -> DataFrame:
    """Per drifted table the added, removed and modified columns against the newest snapshot.

    Modified: the type or the nullability differs. No snapshot, no drift; a dropped table has all
    its columns removed.
    """
    known = _watch(latest_snapshot(snapshots), watched)
    old = known.select(*TABLE, F.posexplode("columns").alias("old_position", "c")).select(
        *TABLE,
        F.col("c.name").alias("name"),
        "old_position",
        F.struct(F.col("c.dataType").alias("t"), F.col("c.nullable").alias("n")).alias("old"),
    )
    new = current.join(known.select(*TABLE), TABLE, "left_semi").select(
        *TABLE,
        "name",
        "ordinal",
        F.struct(F.col("data_type").alias("t"), F.col("nullable").alias("n")).alias("new"),
    )
    pairs = old.join(new, [*TABLE, "name"], "full_outer")
    added, removed = F.col("old").isNull(), F.col("new").isNull()

    def names(condition: Column, position: str) -> Column:
        listed = F.collect_list(F.when(condition, F.struct(F.col(position).alias("p"), "name")))
        return F.transform(F.array_sort(listed), lambda x: x["name"])

    return (
        pairs.groupBy(*TABLE)
        .agg(
            names(added, "ordinal").alias("added_columns"),
            names(removed, "old_position").alias("removed_columns"),
            names(~added & ~removed & ~F.col("old").eqNullSafe(F.col("new")), "ordinal").alias(
                "modified_columns"
            ),
        )
        .filter(
            F.size("added_columns") + F.size("removed_columns") + F.size("modified_columns") > 0
        )
    )


def _schema_entries(changes: DataFrame) -> DataFrame:
    """(schema, table, old, new, transaction_id, created_at) -> SCHEMA_CHANGE entries."""
    return changes.select(
        content_id(*map(F.col, [*TABLE, "transaction_id"])).alias("id"),
        F.lit(SCHEMA_ENTITY_TYPE).alias("entity_type"),
        F.lit(ANY_ID).alias("entity_id"),
        "table_name",
        F.lit(ANY_ID).alias("row_id"),
        F.lit(SCHEMA_CHANGE).alias("operation"),
        F.to_json("old", {"ignoreNullFields": "false"}).alias("old_values"),
        F.to_json("new", {"ignoreNullFields": "false"}).alias("new_values"),
        "transaction_id",
        "created_at",
        "schema_name",
    ).select(*CHANGELOG_COLUMNS, "schema_name")


def record_schema_changes(
    drift: DataFrame, current: DataFrame, snapshots: DataFrame, recorded_at
) -> tuple[DataFrame, DataFrame]:
    """For each drifted table a SCHEMA_CHANGE entry (old and new column lists) and a new snapshot.

    A dropped table gets an empty column list. Every table is a transaction of its own.
    """
    drifted = drift.select(*TABLE)
    old = latest_snapshot(snapshots).select(*TABLE, F.col("columns").alias("old"))
    now = current.groupBy(*TABLE).agg(column_list().alias("new"))
    at = F.lit(recorded_at).cast("timestamp")
    changes = (
        drifted.join(old, TABLE)
        .join(now, TABLE, "left")
        .withColumn("new", F.coalesce("new", F.filter("old", lambda c: F.lit(False))))
        .withColumn("created_at", at)
        .withColumn(
            "transaction_id", content_hash(*map(F.col, TABLE), F.unix_micros("created_at"))
        )
    )
    recorded = changes.select(
        content_id(*map(F.col, [*TABLE, "transaction_id"])).alias("id"),
        *TABLE,
        F.col("new").alias("columns"),
        F.col("created_at").alias("captured_at"),
    )
    return _schema_entries(changes), recorded


def schema_timeline(
    snapshots: DataFrame, watched: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """SCHEMA_CHANGE entries between consecutive snapshots of a table that differ in a column's
    name, type or nullability, or in their order. A table's first snapshot is no change."""
    compared = F.transform(
        "columns", lambda c: F.struct(c["name"], c["dataType"], c["nullable"])
    )
    known = with_previous(
        _watch(snapshots, watched), TABLE, ["captured_at", "id"], ["columns"], heavy_rows
    ).withColumn("old", F.col("previous.columns"))
    before = F.transform("old", lambda c: F.struct(c["name"], c["dataType"], c["nullable"]))
    changes = (
        known.filter(F.col("old").isNotNull() & (before != compared))
        .withColumnsRenamed({"columns": "new", "captured_at": "created_at"})
        .withColumn(
            "transaction_id",
            content_hash(*map(F.col, TABLE), F.unix_micros("created_at"), F.col("id")),
        )
    )
    return _schema_entries(changes)


def capture_coverage(entity_map: DataFrame, log: DataFrame) -> DataFrame:
    """Per expected table the number of captured entries, and whether it is missing.

    If both frames name the database, a table is expected and seen in its own database only. The
    changelog is reduced to one row per (database, entity type, table) before the join.
    """
    both_named = "schema_name" in entity_map.columns and "schema_name" in log.columns
    table = [*(["schema_name"] if both_named else []), "entity_type", "table_name"]
    seen = log.groupBy(*table).agg(F.count(F.lit(1)).alias("entries"))
    return entity_map.join(seen, table, "left").select(
        *table,
        F.coalesce("entries", F.lit(0)).alias("entries"),
        F.col("entries").isNull().alias("is_missing"),
    )


def capture_health(coverage: DataFrame, drift: DataFrame) -> DataFrame:
    """One row: expected, seen and drifted tables; ok if none is missing and none has drifted."""
    zero, one = F.lit(0), F.lit(1)
    counted = coverage.select(
        one.alias("expected"), F.when(F.col("is_missing"), 0).otherwise(1).alias("seen"), zero.alias("drifted")
    ).unionByName(drift.select(zero.alias("expected"), zero.alias("seen"), one.alias("drifted")))
    totals = counted.agg(
        *[F.coalesce(F.sum(c), zero).alias(f"{c}_tables") for c in ("expected", "seen", "drifted")]
    )
    complete = F.col("expected_tables") == F.col("seen_tables")
    return totals.withColumn("ok", complete & (F.col("drifted_tables") == 0))
