"""Streaming capture: upserts and deletes without before-images become changelog operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.heavy import HEAVY_ROWS, broadcast_checked, join_weighted, match, with_previous
from ..schemas import DELETE, INSERT, UPDATE
from .store import Commit, Store, run_into

CAPTURED, IMAGES = "captured", "images"
# Folders of the table of last images: a batch reads only those that its keys are in.
BUCKETS = 64
# Lists of changed images that are read side by side before they are made one.
DELTAS = 16


def _operation(image: str, before: str) -> Column:
    gone, new = F.col(image).isNull(), F.col(before).isNull()
    return F.when(gone, DELETE).when(new, INSERT).otherwise(UPDATE)


def _newest(images: DataFrame, key: list[str]) -> DataFrame:
    """The last image of each key."""
    last = F.max(F.struct("last_seq", "last_image")).alias("last")
    return images.groupBy(*key, "bucket").agg(last).select(*key, "last.*", "bucket")


def capture_stream(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    key: list[str],
    seq: str = "seq",
    buckets: int = BUCKETS,
    heavy_rows: int = HEAVY_ROWS,
    **trigger,
):
    """A query that gives each row of ``stream`` its operation, old_values, new_values and ``is_late``.

    ``stream`` has ``image`` (null for a delete). The last image per key is a stored table, advanced by
    each batch exactly once: a batch that comes again after its commit changes nothing. Within a batch
    the row before comes from a window, and for a key with very many rows from range pieces; nothing
    runs in Python, and no key's rows are held in one place. A batch reads the folders of last images
    that its keys fall into, and of these only the rows of its keys are kept.

    A row whose sequence number is not above the last applied one is late: it is handed on with
    ``is_late`` and no old image, and changes nothing; so are all but the first, by image, of the rows
    that share key and number, and rows without a number. Null key columns are values like any other.
    Read the table with ``captured_rows``, split it with ``late_rows``.
    """
    columns = [c for c in stream.columns if c != "image"]
    kept = [f for f in stream.schema.fields if f.name != "image"]
    output = T.StructType(
        [*kept, *T.StructType.fromDDL("operation string, old_values string, new_values string, is_late boolean").fields]
    )
    images = T.StructType(
        [f for f in kept if f.name in key] + T.StructType.fromDDL("last_seq long, last_image string, bucket int").fields
    )
    store = Store(folder)
    store.open(stream.sparkSession, **{CAPTURED: output})

    def step(batch: DataFrame, number: int, before: Commit) -> Commit:
        spark = stream.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        again = Window.partitionBy(*key, seq).orderBy("image")
        rows = batch.withColumns({"bucket": bucket, "_nth": F.row_number().over(again)})
        path = store.write(rows, "batches")
        rows = spark.read.schema(rows.schema).parquet(path)
        # One row per key that the batch changes; the number of its rows tells the hot ones.
        keys = rows.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("_rows"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as folders
        known = store.state(spark, IMAGES, images)
        known = known.filter(F.col("bucket").isin(touched)) if touched else known.limit(0)
        known = _newest(match(known, broadcast_checked(keys.select(*key)), key, "left_semi"), key)
        last = match(keys, known.drop("bucket"), key, "left").drop("bucket")
        joined = join_weighted(rows, last, key, "_rows", [seq, "_nth"], heavy_rows)
        fresh = (F.col("_nth") == 1) & F.col(seq).isNotNull()
        fresh = fresh & (F.col("last_seq").isNull() | (F.col(seq) > F.col("last_seq")))
        joined = joined.withColumn("is_late", ~fresh).drop("_rows", "_nth")
        path = store.write(joined, "joined")
        joined = spark.read.schema(joined.schema).parquet(path)
        applied = with_previous(joined.filter("NOT is_late"), key, [seq], ["image"], heavy_rows)
        first = F.col("previous").isNull()
        applied = applied.withColumn("old_values", F.when(first, F.col("last_image")).otherwise(F.col("previous.image")))
        late = joined.filter("is_late").withColumn("old_values", F.lit(None).cast("string"))
        finished = [
            df.select(*columns, _operation("image", "old_values").alias("operation"), "old_values", F.col("image").alias("new_values"), "is_late")
            for df in (applied, late)
        ]
        added = {CAPTURED: [store.write(df, CAPTURED) for df in finished]}
        changed = joined.filter("NOT is_late").select(
            *key, F.col(seq).cast("long").alias("last_seq"), F.col("image").alias("last_image"), "bucket"
        )
        lists = before.state.get(IMAGES, [])
        if len(lists) >= DELTAS:
            changed, lists = store.state(spark, IMAGES, images).unionByName(changed), []
        newest = _newest(changed, key).repartition("bucket")
        return Commit(number, {IMAGES: [*lists, store.write(newest, IMAGES, "bucket")]}, added)

    return run_into(stream, store, checkpoint, step, **trigger)


def captured_rows(spark: SparkSession, folder: str) -> DataFrame:
    return Store(folder).added(spark, CAPTURED)


def late_rows(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied rows, late rows) of what a stream captured."""
    return captured.filter("NOT is_late").drop("is_late"), captured.filter("is_late")
