"""Session construction and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rowloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; `conf` overrides them.

    Nothing here is needed for right results: every operator also runs on a session made elsewhere.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only a local session, as in tests, may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "rowloom-checkpoints"))


def durable(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from the written copy.

    It cuts the lineage, and unlike a cache or a localCheckpoint it survives the loss of executors. The session of
    `build_session` deletes a written copy when nothing refers to it any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """Address of a new folder beside the checkpoints, for files that tasks write and other tasks read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder of `shared_folder` with all it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan_parts(df: DataFrame) -> int:
    """In how many parts the files of a plan are read, by their sizes and number; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    piece = min(128 << 20, max(4 << 20, size // cores))  # as the reader cuts its files
    return max(len(df.inputFiles()), -(-size // piece))


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """`df` in enough parts to keep every core busy with costly row functions.

    A large table is read in far more parts than there are cores and comes back as it is; only one that a few tasks would
    read is dealt out to more.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if scan_parts(df) >= want else df.repartition(want)
