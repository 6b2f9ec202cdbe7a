"""Cutting a plan's lineage where a result is used more than once and must be the same each time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder the cluster names; a local session without one keeps it in memory."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return df.checkpoint()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.persist()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the checkpoint folder the cluster names, which all executors share; a local session without one gets a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='ferrolith-')}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
