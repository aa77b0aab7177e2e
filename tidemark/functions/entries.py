"""What the changelog requires of an entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DELETE, INSERT, SCHEMA_CHANGE, UPDATE


def valid_entry() -> Column:
    """What the changelog requires of a row."""
    required = ["entity_type", "entity_id", "table_name", "row_id", "transaction_id", "created_at"]
    valid = F.col("operation").isin(INSERT, UPDATE, DELETE, SCHEMA_CHANGE)
    for column in required:
        valid = valid & F.col(column).isNotNull()
    return F.coalesce(valid, F.lit(False))
