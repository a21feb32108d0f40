"""Stored tables, delimited sheets, JSON Lines, document folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtender.functions.text import contract_code, href_links, link_file_name
from fairtender.operators.rows import present

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CHAT_EXAMPLE = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write, replacing what is there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def blank_to_missing(df: DataFrame) -> DataFrame:
    """The empty string is the missing value of string columns."""
    strings = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in strings else F.col(c) for c in df.columns])


def read_sheet(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A sheet saved as delimited text with a header row; names come in lower case, values as text.

    ``multi_line`` is for values with line breaks; each file is then read by one task.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return raw.toDF(*[c.lower() for c in raw.columns])


def read_catalogue(spark: SparkSession, path: str, columns: Sequence[str] = ("code", "name")) -> DataFrame:
    """A sheet without header row; rows with a blank first column are left out."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("escape", '"').csv(path).filter(present(columns[0]))


def write_sheet(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CHAT_EXAMPLE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_documents(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Every document below ``folder``, upper or lower case suffix alike: path, contract code, size, bytes.

    The bytes are read only if asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(F.lower("path").endswith(suffix.lower())).select(
        "path", contract_code(F.col("path")).alias("n_cod_contrato"), "length", "content"
    )


def portal_links(pages: DataFrame, html: str, marker: str) -> DataFrame:
    """Links of portal pages whose target holds ``marker``, with the file name each is kept under."""
    links = pages.select(*[c for c in pages.columns if c != html], F.explode(href_links(F.col(html))).alias("href"))
    return links.filter(F.col("href").contains(marker)).withColumn("filename", link_file_name(F.col("href")))


def failed_manifest(contracts: DataFrame, documents: DataFrame, key: str = "n_cod_contrato") -> DataFrame:
    """Contracts whose document did not arrive."""
    return contracts.join(documents.select(key), key, "left_anti").select(key, F.lit(1).alias("failed_download"))


def broken_manifest(texts: DataFrame, key: str = "n_cod_contrato", only_broken: bool = False) -> DataFrame:
    """Contracts whose document gave an ``error`` when read; optionally only unreadable files."""
    bad = F.col("error").isNotNull()
    if only_broken:
        bad = F.col("error").contains("cannot open broken document")
    return texts.filter(bad).select(key, F.lit(1).alias("broken_pdf"))
