"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "fairtender", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partitions are left to the cluster's configuration: adaptive execution
    merges small ones and splits skewed ones, so the configured number is an upper bound.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            named = tempfile.mkdtemp(prefix="fairtender-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the plan, and a lost executor cannot change what was written. A written table
    is computed once (a checkpoint computes its rows twice), is read by column, and has a
    known size, so Spark broadcasts it only when it is small.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
