"""Session construction and the shared folder for data that must survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "forecastlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with a UTC clock and adaptive execution.

    Shuffle partitions are left to the caller: with AQE they are an upper bound that is coalesced,
    so a cluster should set a high number and a laptop its core count.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` wins. Only where it is unset (tests on one machine) a new local folder
    is made and set, so that ``checkpoint()`` has somewhere to write as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        jvm_dir = spark.sparkContext.getCheckpointDir()
        named = jvm_dir or tempfile.mkdtemp(prefix="forecastlab-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/forecastlab/{label}-{uuid.uuid4().hex}"


def settle(df, label: str = "settled", **options: str):
    """Write an intermediate table to the shared folder and read it back.

    For a table that several branches of a plan read: without this, each branch computes it again
    from the source. Unlike a cached table it survives lost executors, and it is stored by column with
    its size known, so later joins can be planned on facts. ``options`` go to the writer.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that a later one has replaced, where its maker alone knows its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df):
    """Reliable checkpoint: the rows are in shared storage, not on an executor that may vanish."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
