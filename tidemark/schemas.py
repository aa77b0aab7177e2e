"""Schemas and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the changelog format.
INSERT, UPDATE, DELETE, SCHEMA_CHANGE = "INSERT", "UPDATE", "DELETE", "SCHEMA_CHANGE"
SCHEMA_ENTITY_TYPE = "__schema"
ANY_ID = "*"
DEFAULT_WINDOW_MS = 500

ENTITY_SCOPE = ["entity_type", "entity_id"]

CHANGELOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("old_values", T.StringType()),
        T.StructField("new_values", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
CHANGELOG_COLUMNS = CHANGELOG.fieldNames()

COLUMN_DESCRIPTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("dataType", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("isPrimaryKey", T.BooleanType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("is_pk", T.BooleanType()),
    ]
)

FOREIGN_KEYS = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("from_table", T.StringType()),
        T.StructField("from_column", T.StringType()),
        T.StructField("to_table", T.StringType()),
        T.StructField("to_column", T.StringType()),
        T.StructField("constraint_name", T.StringType()),
    ]
)

ENTITY_MAP = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("is_root", T.BooleanType()),
        T.StructField("entity_key_col", T.StringType()),
        T.StructField("row_key_cols", T.ArrayType(T.StringType())),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("columns", T.ArrayType(COLUMN_DESCRIPTION)),
        T.StructField("captured_at", T.TimestampType()),
    ]
)
