"""Texts and how they are filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages and the text format of a history.
ROOT_WITHOUT_KEY = "Table '{}' has no primary key, skipping as entity root"
CHILD_WITHOUT_KEY = "Table '{}' has no primary key, skipping as child of '{}'"
OWNED_TWICE = "Table '{}' is assigned to both '{}' and '{}'"
NO_ENTITY = "At least one entity is required"
CHANGESET_HEADER = "changeset v{}  [tx: {}]  {}\n  tables: {}"
SCHEMA_HEADER = "schema change  {}"
ROW_TITLE = "  -- {} (id={})"
TABLE_TITLE = "  -- {}"
OPERATION_LINE = "     {}"
OPERATION_FIELDS_LINE = "     {}  {}"
FIELD = "{}={}"
CHANGED_FIELD = "{}: {} -> {}"
ADDED_COLUMN = "     + column '{}' ({}{})"
REMOVED_COLUMN = "     - column '{}'"
NULLABLE = ", nullable"
UNKNOWN_TYPE = "unknown"
NULL_TEXT = "NULL"
LIST_SEPARATOR = ", "
TX_LENGTH = 8
# End of the fixed values.


def filled(template: str, *values: Column | str) -> Column:
    """``template`` with each ``{}`` replaced by a column; null if one of them is."""
    first, *rest = template.split("{}")
    parts = [F.lit(first)]
    for value, literal in zip(values, rest, strict=True):
        parts += [F.col(value) if isinstance(value, str) else value, F.lit(literal)]
    return F.concat(*parts)
