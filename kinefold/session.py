"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kinefold", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC, AQE and skew handling; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that cut lineages go to: the cluster's own, else one for local runs.

    ``spark.checkpoint.dir`` (or a directory set on the context before) is used as it is.
    Only where neither is set and the master is local, a temporary folder is made.
    """
    context = spark.sparkContext
    if (set_before := context._jsc.sc().getCheckpointDir()).isDefined():
        return set_before.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinefold-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read back: lineage is cut, and it survives lost executors.

    The folder is removed when the session ends.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
