"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What one broadcast may hold; checked against the measured size of a stored table.
BROADCAST_BYTES = 8 << 20
# What one Arrow batch on its way to Python holds; a single longer row is a batch of its own.
ARROW_BYTES, ARROW_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``ARROW_BYTES`` (Spark's own bound is 64 MB, and both
    an executor and its Python workers hold several at a time), unless the user has set a bound."""
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has that name."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def broadcast_if_small(df: DataFrame, bytes_of_row: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if the summed ``bytes_of_row`` stays within ``limit``.

    Runs one aggregate over ``df``, so give it a stored or small table.
    """
    size = df.agg(F.sum(bytes_of_row + 64).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= limit else df
