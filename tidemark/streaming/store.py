"""Tables that a stream advances batch by batch, each batch exactly once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists

COMMIT = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("state", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("added", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("watermark_ms", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Commit:
    """What a batch left behind: the paths of every state table, the paths that it added to output
    tables, and the event time (ms) up to which rows are late from then on."""

    batch: int = -1
    state: dict[str, list[str]] = field(default_factory=dict)
    added: dict[str, list[str]] = field(default_factory=dict)
    watermark_ms: int | None = None


class Store:
    """A folder of Parquet tables under a log of commits.

    A batch writes under names of its own, then one small file that names them. Readers see only
    what commits name, so that a batch that failed half-way leaves nothing visible, and a batch that
    comes again after its commit is passed over. Paths that no commit names any more may be deleted.
    """

    def __init__(self, folder: str):
        self.folder, self._last = folder, None

    def open(self, spark: SparkSession, **tables: T.StructType) -> None:
        """Names the output tables; does nothing if the store is there already."""
        if path_exists(spark, f"{self.folder}/commits"):
            return
        added = {name: [self.write(spark.createDataFrame([], schema), name)] for name, schema in tables.items()}
        self._commit(spark, Commit(added=added))

    def _read(self, spark: SparkSession) -> DataFrame:
        commits = spark.read.schema(COMMIT).option("recursiveFileLookup", "true")
        return commits.parquet(f"{self.folder}/commits")

    def _commit(self, spark: SparkSession, commit: Commit) -> None:
        row = (commit.batch, commit.state, commit.added, commit.watermark_ms)
        spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/commits/{commit.batch}"
        )
        self._last = commit

    def last(self, spark: SparkSession) -> Commit:
        """The newest commit."""
        if self._last is None:
            row = self._read(spark).orderBy(F.desc("batch")).first()
            self._last = Commit(row["batch"], dict(row["state"]), dict(row["added"]), row["watermark_ms"])
        return self._last

    def write(self, df: DataFrame, name: str, *partitions: str) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partitions).parquet(path)
        return path

    def state(self, spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
        """A state table as of the newest commit."""
        paths = self.last(spark).state.get(name, [])
        # Each path by itself: they may be partitioned folders of one layout.
        frames = [spark.read.schema(schema).parquet(path) for path in paths]
        whole = frames[0] if frames else spark.createDataFrame([], schema)
        for more in frames[1:]:
            whole = whole.unionByName(more)
        return whole

    def added(self, spark: SparkSession, name: str) -> DataFrame:
        """All that the commits added to an output table."""
        rows = self._read(spark).select(F.explode(F.col("added")[name]).alias("path"))
        paths = sorted(r["path"] for r in rows.collect())  # one short row per batch
        return spark.read.option("mergeSchema", "false").parquet(*paths)

    def advance(self, batch: DataFrame, number: int, step: Callable[[DataFrame, Commit], Commit]) -> None:
        """Runs ``step`` on a batch and commits what it returns, unless that was done before."""
        last = self.last(batch.sparkSession)
        if last.batch < number:
            self._commit(batch.sparkSession, step(batch, last))


def run_into(
    stream: DataFrame,
    store: Store,
    checkpoint: str,
    step: Callable[[DataFrame, int, Commit], Commit],
    **trigger,
):
    """A query that advances ``store`` by ``step(batch, number, newest commit)``."""

    def advance(batch: DataFrame, number: int) -> None:
        store.advance(batch, number, lambda rows, last: step(rows, number, last))

    return (
        stream.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
