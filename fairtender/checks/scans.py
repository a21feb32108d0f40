"""Scans, sheets, manifests, sinks. What a sink wrote is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairtender.checks.registry import query
from fairtender.checks.standin import CONTRACT, catalogue_codes, sql, table
from fairtender.operators.chat import chat_examples
from fairtender.session import scratch_path
from fairtender.sources import tables as src


@query(
    "scan_table",
    "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
def scan_table(spark, sf):
    orders = src.read_table(spark, f"{sf}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"))


@query("scan_header_lower", "SELECT CAST(s_suppkey AS BIGINT) AS suppkey, s_name AS name FROM supplier")
def scan_header_lower(spark, sf):
    path = scratch_path(spark, "sheet")
    supplier = table(spark, sf, "supplier")
    src.write_sheet(supplier.select(F.col("s_suppkey").alias("SuppKey"), F.col("s_name").alias("NAME")), path)
    return src.read_sheet(spark, path).select(F.col("suppkey").try_cast("bigint").alias("suppkey"), "name")


@query(
    "scan_skip_blank",
    sql("SELECT code, name FROM catalogue_codes WHERE part % 7 <> 0", "catalogue_codes"),
)
def scan_skip_blank(spark, sf):
    path = scratch_path(spark, "catalogue")
    codes = catalogue_codes(spark, sf)
    src.write_sheet(codes.select(F.when(F.col("part") % 7 != 0, F.col("code")), "name"), path, header=False)
    return src.read_catalogue(spark, path)


@query(
    "portal_links",
    """SELECT page_id, href, concat(list_extract(string_split(href, '/'), -1), '.xlsx') AS filename FROM (
      SELECT page_id, replace(split_part(part, '"', 1), '&amp;', '&') AS href FROM (
        SELECT page_id, unnest(string_split(html, '<a href="')[2:]) AS part FROM pages) p) h
    WHERE contains(href, '/the')""",
)
def portal_links(spark, sf):
    return src.portal_links(table(spark, sf, "pages").select("page_id", "html"), "html", "/the")


@query(
    "scan_documents",
    """SELECT lang, CAST(count(*) AS BIGINT) AS n_lines FROM (
      SELECT lang, unnest(string_split(text, chr(10))) FROM documents) d GROUP BY lang""",
)
def scan_documents(spark, sf):
    """The texts as a folder tree by language, next to files of another kind which are passed over."""
    root = scratch_path(spark, "documents")
    docs = table(spark, sf, "documents").select("lang", "text")
    docs.write.partitionBy("lang").text(f"{root}/texts")
    docs.select("lang").write.json(f"{root}/other")
    found = src.scan_documents(spark, root, ".TXT")
    lines = F.length(F.regexp_replace(F.col("content").cast("string"), "[^\n]", ""))
    lang = F.regexp_extract("path", "lang=([^/]*)/", 1)
    return found.groupBy(lang.alias("lang")).agg(F.sum(lines).cast("long").alias("n_lines"))


@query(
    "failed_manifest",
    """SELECT o_orderkey AS n_cod_contrato, CAST(1 AS INT) AS failed_download FROM orders
    WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)""",
)
def failed_manifest(spark, sf):
    contracts = table(spark, sf, "orders").select(F.col("o_orderkey").alias(CONTRACT))
    return src.failed_manifest(contracts, table(spark, sf, "documents").select(F.col("doc_id").alias(CONTRACT)))


def _read_texts(spark, sf):
    """Texts with the error met in reading; toxic ones play the broken files, poor ones other errors."""
    error = F.when(F.col("toxic") == 1, "cannot open broken document").when(F.col("quality") == 0, "timeout")
    return table(spark, sf, "labels").select(F.col("doc_id").alias(CONTRACT), error.alias("error"))


@query(
    "broken_manifest",
    """SELECT doc_id AS n_cod_contrato, CAST(1 AS INT) AS broken_pdf, kind FROM labels,
      (VALUES ('any'), ('broken')) k(kind) WHERE toxic = 1 OR (quality = 0 AND kind = 'any')""",
)
def broken_manifest(spark, sf):
    texts = _read_texts(spark, sf)
    every = src.broken_manifest(texts).withColumn("kind", F.lit("any"))
    return every.unionByName(src.broken_manifest(texts, only_broken=True).withColumn("kind", F.lit("broken")))


@query("sink_table", "SELECT p_partkey, p_name, CAST(p_size AS INT) AS p_size, p_retailprice FROM part")
def sink_table(spark, sf):
    path = scratch_path(spark, "table")
    src.write_table(table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, ["p_size"])
    return src.read_table(spark, path).withColumn("p_size", F.col("p_size").cast("int"))


@query(
    "sink_jsonl",
    """SELECT md5(concat('{"messages":[{"role":"system","content":"s"},{"role":"user","content":"', o_orderpriority,
      '"},{"role":"assistant","content":"', CAST(o_orderkey AS VARCHAR), '"}]}')) AS line FROM orders""",
)
def sink_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    orders = table(spark, sf, "orders")
    src.write_jsonl(
        orders.select(chat_examples(F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), "s")), path
    )
    return spark.read.text(path).select(F.md5("value").alias("line"))


@query(
    "scan_jsonl",
    """SELECT doc_id, 'user' AS role, md5(text) AS content_md5 FROM documents
    UNION ALL SELECT doc_id, 'assistant', md5(source) FROM documents""",
)
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    docs = table(spark, sf, "documents")
    messages = chat_examples(F.col("text"), F.col("source"), "s")
    src.write_jsonl(docs.select("doc_id", messages), path)
    schema = docs.select("doc_id", messages).schema
    back = src.read_jsonl(spark, path, schema).select("doc_id", F.explode("messages").alias("m"))
    return back.filter("m.role <> 'system'").select("doc_id", "m.role", F.md5("m.content").alias("content_md5"))
