"""Changesets as text and as JSON documents, built from column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.images import iso_millis, utc_seconds
from ..functions.text import filled
from ..plans.heavy import HEAVY_ROWS
from ..schemas import DEFAULT_WINDOW_MS, DELETE, ENTITY_SCOPE, INSERT, SCHEMA_CHANGE, UPDATE
from .changesets import place_operations
from .diff import changed_fields, column_changes, listed_fields, with_parsed


def operation_text(verbose: bool = False) -> Column:
    """The block of one parsed entry: a line naming table and row, then what happened to it."""
    operation = F.col("operation")
    has_old, has_new = F.col("old_values").isNotNull(), F.col("new_values").isNotNull()

    def line(label: str, fields: Column | None = None) -> Column:
        if fields is None:
            return F.lit(text.OPERATION_LINE.format(label))
        return filled(text.OPERATION_FIELDS_LINE, F.lit(label), fields)

    def joined(parts: Column) -> Column:
        return F.coalesce(F.array_join(parts, text.LIST_SEPARATOR), F.lit(""))

    def values(image: str, hide_id: bool) -> Column:
        shown = listed_fields(image, hide_id)
        return joined(F.transform(shown, lambda f: filled(text.FIELD, f["field"], f["value"])))

    update = joined(
        F.transform(
            changed_fields(),
            lambda c: filled(text.CHANGED_FIELD, c["field"], c["old_value"], c["new_value"]),
        )
    )
    data = (
        F.when((operation == INSERT) & has_new, line(INSERT, values("_after", not verbose)))
        .when(operation == INSERT, line(INSERT))
        .when((operation == UPDATE) & has_old & has_new, line(UPDATE, update))
        .when(operation == UPDATE, line(UPDATE))
    )
    if verbose:
        data = data.when((operation == DELETE) & has_old, line(DELETE, values("_before", False)))
    data = data.when(operation == DELETE, line(DELETE))

    columns = F.transform(
        column_changes(),
        lambda c: F.when(
            c["change"] == "added",
            filled(
                text.ADDED_COLUMN,
                c["name"],
                c["data_type"],
                F.when(c["nullable"], text.NULLABLE).otherwise(""),
            ),
        ).otherwise(filled(text.REMOVED_COLUMN, c["name"])),
    )
    lines = F.when(F.size(columns) > 0, F.array_join(columns, "\n"))
    schema = F.when(has_old & has_new, lines).otherwise(line(SCHEMA_CHANGE))
    return F.when(
        operation == SCHEMA_CHANGE,
        F.concat_ws("\n", filled(text.TABLE_TITLE, "table_name"), schema),
    ).otherwise(F.concat_ws("\n", filled(text.ROW_TITLE, "table_name", "row_id"), data))


def header_text(first_operation: Column) -> Column:
    date = utc_seconds("timestamp")
    changeset = filled(
        text.CHANGESET_HEADER,
        F.col("version").cast("string"),
        F.substring("changeset_transaction_id", 1, text.TX_LENGTH),
        date,
        F.array_join("tables", text.LIST_SEPARATOR),
    )
    return F.when(
        first_operation == SCHEMA_CHANGE, filled(text.SCHEMA_HEADER, date)
    ).otherwise(changeset)


def _with_header(placed: DataFrame, scope: list[str], header: Column, item: Column, out: str) -> DataFrame:
    """One row per operation, and at position 0 one for the changeset, made from its first entry."""
    line = lambda position, value: F.struct(position.alias("position"), value.alias(out))
    own = line(F.col("position"), item)
    lines = F.when(
        F.col("position") == 1, F.array(line(F.lit(0).cast("long"), header), own)
    ).otherwise(F.array(own))
    return placed.select(*scope, "version", F.inline(lines))


def render_text(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    verbose: bool = False,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(scope, version, position, text): a header row at position 0 and one row per operation.

    The same shape for a changeset of any size; its rows in order, put together by line breaks, are
    its text (``whole_text``).
    """
    placed = place_operations(log, window_ms, scope, heavy_rows)
    printed = with_parsed(placed, verbose)
    header = header_text(F.col("operation"))
    return _with_header(printed, scope, header, operation_text(verbose), "text")


def newest_first(rendered: DataFrame, scope: list[str] = ENTITY_SCOPE) -> DataFrame:
    """The printing order: per entity the newest changeset first, its rows in sequence."""
    return rendered.orderBy(*scope, F.desc("version"), "position")


def _in_order(rows: DataFrame, scope: list[str], column: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("position", column)))
    return rows.groupBy(*scope, "version").agg(listed.alias("listed"))


def whole_text(rendered: DataFrame, scope: list[str] = ENTITY_SCOPE) -> DataFrame:
    """One row per changeset with its whole ``text``: for changesets that fit into one row."""
    whole = F.array_join("listed.text", "\n")
    return _in_order(rendered, scope, "text").select(*scope, "version", whole.alias("text"))


def changesets_json(
    log: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: list[str] = ENTITY_SCOPE,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(scope, version, position, json): at position 0 the changeset, behind it one document per
    operation, images embedded, ids as strings. ``whole_documents`` puts them together."""
    placed = place_operations(log, window_ms, scope, heavy_rows)
    operation = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("entity_type").alias("entityType"),
        F.col("entity_id").alias("entityId"),
        F.col("table_name").alias("tableName"),
        F.col("row_id").alias("rowId"),
        "operation",
        F.parse_json("old_values").alias("oldValues"),
        F.parse_json("new_values").alias("newValues"),
        F.col("transaction_id").alias("transactionId"),
        iso_millis("created_at").alias("createdAt"),
    )
    head = F.struct(
        "version",
        F.col("changeset_transaction_id").alias("transactionId"),
        iso_millis("timestamp").alias("timestamp"),
        F.col("is_autocommit_grouped").alias("isAutocommitGrouped"),
    )
    document = F.to_json(operation, {"ignoreNullFields": "false"})
    return _with_header(placed, scope, F.to_json(head), document, "json")


def oldest_first(documents: DataFrame, scope: list[str] = ENTITY_SCOPE) -> DataFrame:
    return documents.orderBy(*scope, "version", "position")


def whole_documents(documents: DataFrame, scope: list[str] = ENTITY_SCOPE) -> DataFrame:
    """One JSON document per changeset with its operations: for changesets that fit into one row."""
    head, operations = F.element_at("listed.json", 1), F.slice("listed.json", 2, F.size("listed"))
    flag = ',"isAutocommitGrouped"'
    json = F.concat(
        F.substring_index(head, flag, 1),
        F.lit(',"operations":['),
        F.array_join(operations, ","),
        F.lit("]"),
        F.lit(flag),
        F.substring_index(head, flag, -1),
    )
    return _in_order(documents, scope, "json").select(*scope, "version", json.alias("json"))


def write_json(documents: DataFrame, path: str, scope: list[str] = ENTITY_SCOPE) -> None:
    """One line per row, each with its scope, version and position, in order across the files."""
    line = F.struct(*scope, "version", "position", F.parse_json("json").alias("document"))
    oldest_first(documents, scope).select(F.to_json(line)).write.text(path)
