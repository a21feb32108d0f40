"""Tables laid out once by a key, so that later joins and groupings on it move no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from fairtender.session import scratch_path

BUCKETS = "spark.sql.shuffle.partitions"


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` written to the shared folder in sorted buckets of ``keys``, one file each, and read back.

    Joins with tables of the same keys and as many buckets (the session's shuffle partitions
    unless stated) and groupings by them need no exchange, however many follow one another.
    The files stay in the folder; :func:`forget` removes the name under which they are known.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get(BUCKETS))
    name = f"laid_out_{uuid.uuid4().hex}"
    dealt = df.repartition(count, *keys)
    writer = dealt.write.bucketBy(count, *keys).sortBy(*keys).format("parquet")
    writer.option("path", scratch_path(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Drop the catalogue's entry of a table made by :func:`bucketed`; its files stay."""
    for path in df.inputFiles()[:1]:
        folder = path.rsplit("/", 1)[0]
        for t in df.sparkSession.catalog.listTables():
            if t.name.startswith("laid_out_"):
                found = df.sparkSession.sql(f"DESCRIBE FORMATTED {t.name}").filter("col_name = 'Location'").head()
                if found and folder.rstrip("/").endswith(found.data_type.rsplit("/", 1)[-1]):
                    df.sparkSession.sql(f"DROP TABLE {t.name}")
