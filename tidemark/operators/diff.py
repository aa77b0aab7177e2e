"""Differences between row images and between column lists; no shuffle, one pass over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import canonical, image_map, printed
from ..functions.text import UNKNOWN_TYPE
from ..schemas import DELETE, INSERT, SCHEMA_CHANGE, UPDATE

CONTEXT = [
    "id",
    "entity_type",
    "entity_id",
    "table_name",
    "row_id",
    "transaction_id",
    "created_at",
]
COLUMN_LIST = "array<struct<name:string,dataType:string,nullable:boolean>>"


def with_parsed(log: DataFrame, verbose: bool = False) -> DataFrame:
    """``log`` with its images parsed as far as a diff needs them: maps ``_before`` and ``_after``,
    column lists ``_columns_before`` and ``_columns_after``.

    As columns of their own they are parsed once per row; inside a lambda function Spark would
    parse them again for every element.
    """
    operation = F.col("operation")
    shown_old = (operation == UPDATE) | (F.lit(verbose) & (operation == DELETE))
    is_schema = operation == SCHEMA_CHANGE
    return log.withColumns(
        {
            "_before": F.when(shown_old, image_map("old_values")),
            "_after": F.when(operation.isin(INSERT, UPDATE), image_map("new_values")),
            "_columns_before": F.when(is_schema, F.from_json("old_values", COLUMN_LIST)),
            "_columns_after": F.when(is_schema, F.from_json("new_values", COLUMN_LIST)),
        }
    )


def changed_fields() -> Column:
    """array<struct<field, old_value, new_value, was_missing>> over the keys of the new image.

    A key only in the old image is not a change. A key only in the new image is one, even when it
    is null there. Values are compared as JSON, so 1 and "1" differ and 1 and 1.0 do not.
    """
    before, after = F.col("_before"), F.col("_after")
    # Two passes, so that the JSON text of a value is made once and only changes are printed.
    pairs = F.transform(
        F.map_entries(after),
        lambda e: F.struct(
            e["key"].alias("field"),
            before[e["key"]].alias("old"),
            e["value"].alias("new"),
            F.to_json(before[e["key"]]).alias("old_text"),
            F.to_json(e["value"]).alias("new_text"),
            (~F.map_contains_key(before, e["key"])).alias("was_missing"),
        ),
    )
    changed = F.filter(
        pairs,
        lambda p: p["was_missing"]
        | (
            (p["old_text"] != p["new_text"])
            & (canonical(p["old_text"]) != canonical(p["new_text"]))
        ),
    )
    return F.transform(
        changed,
        lambda p: F.struct(
            p["field"].alias("field"),
            printed(p["old_text"], p["old"]).alias("old_value"),
            printed(p["new_text"], p["new"]).alias("new_value"),
            p["was_missing"].alias("was_missing"),
        ),
    )


def listed_fields(image: str, hide_id: bool) -> Column:
    """array<struct<field, value>> of an image; ``hide_id`` leaves out the key named ``id``."""
    texts = F.transform(
        F.map_entries(image),
        lambda e: F.struct(
            e["key"].alias("field"), e["value"].alias("v"), F.to_json(e["value"]).alias("text")
        ),
    )
    fields = F.transform(
        texts, lambda t: F.struct(t["field"].alias("field"), printed(t["text"], t["v"]).alias("value"))
    )
    return F.filter(fields, lambda f: f["field"] != "id") if hide_id else fields


def field_diff(log: DataFrame) -> DataFrame:
    """One row per changed field of every UPDATE that has both images."""
    updates = log.filter(
        (F.col("operation") == UPDATE)
        & F.col("old_values").isNotNull()
        & F.col("new_values").isNotNull()
        # Equal texts hold no change; they need not be parsed.
        & (F.col("old_values") != F.col("new_values"))
    )
    return with_parsed(updates).select(*CONTEXT, F.inline(changed_fields()))


def field_change_counts(log: DataFrame) -> DataFrame:
    return (
        field_diff(log)
        .groupBy("entity_type", "table_name", "field")
        .agg(F.count(F.lit(1)).alias("changes"))
    )


def image_fields(log: DataFrame, operation: str, verbose: bool = False) -> DataFrame:
    """One row per shown field: of inserts the new image without ``id``, or all of it if verbose;
    of deletes the old image if verbose, else nothing."""
    if operation not in (INSERT, DELETE):
        raise ValueError("operation must be INSERT or DELETE")
    image = "_after" if operation == INSERT else "_before"
    shown = log.filter(F.col("operation") == operation)
    if operation == DELETE and not verbose:
        shown = shown.filter(F.lit(False))
    hide_id = operation == INSERT and not verbose
    return with_parsed(shown, verbose).select(*CONTEXT, F.inline(listed_fields(image, hide_id)))


def column_changes() -> Column:
    """array<struct<change, name, data_type, nullable>>: added columns, then removed ones, by name."""
    before, after = F.col("_columns_before"), F.col("_columns_after")

    def missing_from(other: Column, change: str, source: Column) -> Column:
        return F.transform(
            F.filter(source, lambda c: ~F.array_contains(other["name"], c["name"])),
            lambda c: F.struct(
                F.lit(change).alias("change"),
                c["name"].alias("name"),
                F.coalesce(c["dataType"], F.lit(UNKNOWN_TYPE)).alias("data_type"),
                F.coalesce(c["nullable"], F.lit(False)).alias("nullable"),
            ),
        )

    return F.concat(missing_from(before, "added", after), missing_from(after, "removed", before))


def schema_change_diff(log: DataFrame) -> DataFrame:
    """One row per added or removed column of every SCHEMA_CHANGE entry."""
    changes = with_parsed(log.filter(F.col("operation") == SCHEMA_CHANGE))
    return changes.select(*CONTEXT, F.inline(column_changes()))
