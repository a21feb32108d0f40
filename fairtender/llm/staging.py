"""Tables written between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fairtender.session import scratch_path

#: ends the life of a write's shuffle files with the write, as the table replaces them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: rows of packed sets are large: what goes to a Python worker at once is bounded by bytes, not only by rows
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def keep(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder of the session and read it back.

    Cuts the lineage, survives lost executors, and frees the shuffle files that led to it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before, batch = spark.conf.get(CLEANUP, "false"), spark.conf.get(BATCH)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
        spark.conf.set(BATCH, batch)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def release(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`keep` returned and that nothing will read again.

    Only the caller knows what is still to be read: whatever is computed from a table must have
    been written itself. A table that is no longer there is passed over.
    """
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
