"""Catalog frames from information-schema-like relations, for any number of databases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CATALOG, FOREIGN_KEYS

RESERVED_PREFIX = "__tidemark_"
TABLE = ["schema_name", "table_name"]


def catalog_columns(
    tables: DataFrame,
    columns: DataFrame,
    pk_columns: DataFrame,
    reserved_prefix: str = RESERVED_PREFIX,
    ordered: bool = True,
) -> DataFrame:
    """Columns of the base tables with a primary-key flag; tables of our own are left out.
    Sorted by table and ordinal unless ``ordered`` is off.

    ``tables(schema_name, table_name, table_type)``, ``columns(schema_name, table_name,
    column_name, ordinal, data_type, is_nullable)`` with YES/NO, ``pk_columns(schema_name,
    table_name, column_name)``.
    """
    base = tables.filter(
        (F.col("table_type") == "BASE TABLE") & ~F.col("table_name").startswith(reserved_prefix)
    ).select(*TABLE)
    # One row per table with its key columns, so that the columns are dealt out and sorted once.
    keys = pk_columns.groupBy(*TABLE).agg(F.collect_set("column_name").alias("pk"))
    found = (
        columns.join(base.distinct().join(keys, TABLE, "left"), TABLE)
        .select(
            *TABLE,
            F.col("ordinal").cast("int").alias("ordinal"),
            F.col("column_name").alias("name"),
            "data_type",
            (F.col("is_nullable") == "YES").alias("nullable"),
            F.coalesce(F.array_contains("pk", F.col("column_name")), F.lit(False)).alias("is_pk"),
        )
        .select(*CATALOG.fieldNames())
    )
    return found.orderBy(*TABLE, "ordinal") if ordered else found


def foreign_keys(
    constraints: DataFrame, key_usage: DataFrame, ref_usage: DataFrame, ordered: bool = True
) -> DataFrame:
    """(from, to) column pairs of the foreign keys, by constraint name unless ``ordered`` is off.

    ``constraints(schema_name, constraint_name, constraint_type)``, ``key_usage(schema_name,
    constraint_name, table_name, column_name)``, ``ref_usage`` alike for the referenced side. If
    both usages have ``position``, the columns of a composite key are paired by it.
    """
    name = ["schema_name", "constraint_name"]
    by_position = "position" in key_usage.columns and "position" in ref_usage.columns
    on = [*name, "position"] if by_position else name
    source = key_usage.select(
        *on, F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column")
    )
    target = ref_usage.select(
        *on, F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column")
    )
    declared = constraints.filter(F.col("constraint_type") == "FOREIGN KEY").select(*name)
    found = source.join(declared, name, "left_semi").join(target, on).select(*FOREIGN_KEYS.fieldNames())
    return found.orderBy(*name, "from_column") if ordered else found


def column_list() -> Column:
    """Aggregate: a table's columns in order as array<struct<name, dataType, nullable,
    isPrimaryKey>>. As long as the table is wide."""
    described = F.struct(
        "name",
        F.col("data_type").alias("dataType"),
        "nullable",
        F.col("is_pk").alias("isPrimaryKey"),
    )
    listed = F.array_sort(F.collect_list(F.struct("ordinal", described.alias("c"))))
    return F.transform(listed, lambda x: x["c"])


def schema_snapshot(catalog: DataFrame, captured_at) -> DataFrame:
    """One row per table with its columns in order and the capture time; ``write_snapshots`` of
    ``sources.snapshots`` gives it an id and keeps it."""
    at = captured_at if isinstance(captured_at, Column) else F.lit(captured_at).cast("timestamp")
    return catalog.groupBy(*TABLE).agg(column_list().alias("columns")).withColumn("captured_at", at)
