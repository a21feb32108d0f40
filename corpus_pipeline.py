"""Documents to training tokens: language, near copies, test leaks, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairtender.llm import decontaminate, jaccard, language, mixing, queries, tokens
from fairtender.session import scratch_path, stage


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; junk without letters or of no language goes.

    The model learns from the documents that come in, without those held out.
    """
    model = language.fit(docs.filter("doc_id is not null").filter(~queries.held_out()))
    return language.known_language(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the runs of five words), that of the smallest id."""
    return jaccard.one_of_each(docs, k=5, least=80, out_of=100)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, even with some words changed."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.repeated(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and per document what the files hold of it."""
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(docs, path, queries.word_tokenizer(), end_id=2)
    return tokens.token_digests(spark, path)


STAGES = [
    ("language ID", known_languages),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_test_items),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]

#: SQL states neither a trained model nor a tokenizer; tests compare stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
