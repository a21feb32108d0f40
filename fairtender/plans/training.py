"""From contract texts and their answers to a checked training file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtender.functions.text import clean_text, join_nonnull, normalise_text
from fairtender.operators.chat import chat_defects, chat_examples, chat_stats, legacy_examples, training_budget
from fairtender.operators.chunks import chunk_text
from fairtender.sources.tables import read_jsonl, write_jsonl

# fixed value
PIECE_TOKENS = 1800


def training_examples(texts: DataFrame, prices: list[str], text: str = "text", n: int = PIECE_TOKENS, tokenizer=None) -> DataFrame:
    """Texts with their prices as prompt, completion and messages.

    A text is cleaned and normalised and keeps its first and last piece of ``n`` tokens; the
    prices of the columns ``prices`` are joined to one answer.
    """
    plain = texts.withColumn(text, normalise_text(clean_text(F.col(text)))).withColumn("answer", join_nonnull(*[F.col(p) for p in prices]))
    made = legacy_examples(chunk_text(plain, text, n, "first_last", tokenizer), text, "answer")
    return made.withColumn("messages", chat_examples(F.col("prompt"), F.col("completion")))


def training_file(examples: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the messages as JSON Lines; defects, token counts per example and budget of the file."""
    spark = examples.sparkSession
    write_jsonl(examples.select("messages"), path)
    defects = chat_defects(spark.read.text(path))
    # numbered before the messages are taken apart
    lines = read_jsonl(spark, path).withColumn("example", F.monotonically_increasing_id()).select("example", F.explode("messages").alias("m"))
    stats = chat_stats(lines.select("example", "m.role", "m.content"), ["example"], "role", "content")
    return defects, stats, training_budget(stats)
