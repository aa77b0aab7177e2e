"""The stored changelog: append-only Parquet, laid out for history lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.entries import valid_entry
from ..functions.images import utc_date
from ..schemas import CHANGELOG, CHANGELOG_COLUMNS

LAYOUT = ["entity_type", "created_date", "entity_id", "created_at", "id"]
SCHEMA_NAME = T.StructField("schema_name", T.StringType())
STORED = T.StructType([*CHANGELOG.fields, SCHEMA_NAME, T.StructField("created_date", T.DateType())])


def _columns(log: DataFrame) -> list:
    """The columns of an entry; the database is null if the log does not tell it."""
    known = "schema_name" in log.columns
    database = F.col("schema_name") if known else F.lit(None).cast("string").alias("schema_name")
    return [*CHANGELOG_COLUMNS, database]


def _accepted(log: DataFrame) -> DataFrame:
    """The log with its date; a row that is no entry fails the job when it is written."""
    log = log.select(*_columns(log))
    refused = F.raise_error(F.concat(F.lit("not a changelog entry: "), F.to_json(F.struct(*log.columns))))
    operation = F.when(valid_entry(), F.col("operation")).otherwise(refused)
    return log.withColumns({"operation": operation, "created_date": utc_date("created_at")})


def write_changelog(log: DataFrame, path: str, rejects: str | None = None) -> None:
    """Append entries, in folders by entity type and UTC date, sorted by entity inside.

    Range partitioning on the whole layout cuts a hot entity or day into several files and keeps
    the number of files near the number of tasks; sorted files let row-group statistics skip. Rows
    that are no entries (without entity id, of unknown operation, …) are appended to the folder
    ``rejects``; if there is none, such a row fails the job.
    """
    if rejects:
        log.filter(~valid_entry()).write.mode("append").parquet(rejects)
        log = log.filter(valid_entry())
    (
        _accepted(log)
        .repartitionByRange(*LAYOUT)
        .sortWithinPartitions(*LAYOUT)
        .write.mode("append")
        .partitionBy("entity_type", "created_date")
        .parquet(path)
    )


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their ``schema_name`` and ``created_date``, by which time filters prune folders."""
    return spark.read.schema(STORED).parquet(path)


def append_stream(log: DataFrame, path: str, checkpoint: str, **trigger):
    """A query that appends a stream of entries, each once, with the same folders. A row that is no
    entry fails it: filter with ``valid_entry`` and send the rest elsewhere first."""
    return (
        _accepted(log)
        .writeStream.format("parquet")
        .partitionBy("entity_type", "created_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
