"""Running a stream over what is available, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all input there is, append the output as Parquet, and return that table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
