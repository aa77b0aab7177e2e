"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings that the operators are planned for. Everything else stays with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let a join on (scope, transaction) use an exchange on the scope alone.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # Merge session windows map-side, so that a hot entity reaches its task pre-aggregated.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def session(app_name: str = "tidemark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def streaming_session(spark: SparkSession) -> SparkSession:
    """A sibling session with the state-store settings; the caller's session is left as it is."""
    sibling = spark.newSession()
    for key, value in SETTINGS.items():
        sibling.conf.set(key, value)
    # State partitions are fixed for the life of a query: as many as there are cores.
    cores = spark.sparkContext.defaultParallelism
    sibling.conf.set("spark.sql.shuffle.partitions", str(cores))
    return sibling


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, below it one folder per application.

    Only a local master may fall back to a temporary folder: on a cluster no other machine
    could read it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark/{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing), and pins values
    that depend on the physical partition.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
