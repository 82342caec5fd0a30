"""Where lineage is cut: the checkpoint folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is made only where the setting is absent and all of Spark is one process.

    The folder that was made is kept as the context's checkpoint folder: the setting itself cannot be changed in a running session.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-tessera-')}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder by ``checkpoint`` and read back."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as a table and read back: what is used several times is made once, and its size is known to the joins."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
