"""Filters, order and aggregates over the changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import utc_date
from ..schemas import CHANGELOG_COLUMNS


def matching(
    log: DataFrame,
    entity_type: str | None = None,
    entity_id: str | None = None,
    since=None,
    until=None,
) -> Column:
    """The filter as one predicate; empty values mean no filter, the time bounds are inclusive.

    On a stored changelog the bounds also restrict ``created_date``, which prunes partitions.
    """
    conditions = []
    if entity_type:
        conditions.append(F.col("entity_type") == entity_type)
    if entity_id:
        conditions.append(F.col("entity_id") == entity_id)
    for bound, compare in ((since, Column.__ge__), (until, Column.__le__)):
        if bound:
            limit = F.lit(bound).cast("timestamp")
            conditions.append(compare(F.col("created_at"), limit))
            if "created_date" in log.columns:
                conditions.append(compare(F.col("created_date"), utc_date(limit)))
    combined = F.lit(True)
    for condition in conditions:
        combined = combined & condition
    return combined


def query_changelog(
    log: DataFrame,
    entity_type: str | None = None,
    entity_id: str | None = None,
    since=None,
    until=None,
    limit: int | None = None,
) -> DataFrame:
    found = (
        log.filter(matching(log, entity_type, entity_id, since, until))
        .select(*CHANGELOG_COLUMNS)
        .orderBy("created_at", "id")
    )
    return found.limit(limit) if limit else found


def transaction_groups(
    log: DataFrame,
    entity_type: str | None = None,
    entity_id: str | None = None,
    since=None,
    until=None,
) -> DataFrame:
    return (
        log.filter(matching(log, entity_type, entity_id, since, until))
        .groupBy("transaction_id")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("created_at").alias("min_created_at"),
            F.max("created_at").alias("max_created_at"),
        )
        .orderBy("min_created_at", "transaction_id")
    )


def changelog_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("entity_type").alias("entity_types"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def entity_stats(log: DataFrame) -> DataFrame:
    """Entries per entity, in total and per operation."""
    per_operation = [
        F.count_if(F.col("operation") == op).alias(op.lower() + "s")
        for op in ("INSERT", "UPDATE", "DELETE")
    ]
    return log.groupBy("entity_type", "entity_id").agg(
        F.count(F.lit(1)).alias("total"),
        *per_operation,
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )
