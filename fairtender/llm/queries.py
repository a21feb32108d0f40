"""Registered queries of this subpackage over the test tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairtender.llm import chat, codes, decontaminate, fingerprints, jaccard, language, mixing, oracles, pii, secrets, substring, tokens, urls, whitening
from fairtender.llm.staging import keep
from fairtender.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf, "documents").select("doc_id", "text")))


#: (verdict, host and path)
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query
def op8_url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), URL_RULES)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf, "documents"), path, word_tokenizer(), end_id=2)
    return tokens.token_digests(spark, path)


@query
def op2_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf, "documents")).drop("kept")


@query
def op3_reply_trees(spark: SparkSession, sf: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], schema)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = keep(chat.chain(turns), "messages")
    return chat.digests(keep(chat.conversations(messages, top=1), "conversations"))


@query
def op4_test_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op5_languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", held_out())
    model = language.fit(docs.filter("doc_id is not null and not held_out"))
    return language.identify(docs, model, ["doc_id", "held_out"])


@query
def op6_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).drop("row_key")


@query
def op7_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf, "documents"))


@query
def op10_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf, "documents"))


@query
def op11_whitened(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query
def op12_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.summary(secrets.find(table(spark, sf, "documents")))


@query
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = codes.compress(table(spark, sf, "embeddings"))
    return rows.withColumns({c: F.col(c).try_cast("bigint") for c in ("error", "label_error")})


ORACLES |= {
    "op3_reply_trees": oracles.REPLY_TREES,
    "op7_near_copies": oracles.NEAR_COPIES,
    "op8_url_verdicts": oracles.url_verdicts(URL_RULES),
}
