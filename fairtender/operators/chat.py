"""Chat examples: building, checking and sizing them.

Two layouts: lines of JSON, one example each, and turns (``example``, ``role``, ``text``
columns), one message each. Everything per example is an aggregate over turns, so an
example never has to be gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.functions.text import COMPLETION_END, PROMPT_END
from fairtender.operators.quantiles import quantiles
from fairtender.operators.rows import indicator
from fairtender.session import stage

# fixed values
SYSTEM_TEXT = "Dado el texto extraido de un contrato, extrae los precios unitarios de los bienes comprados."
ROLES = ("system", "user", "assistant")
MESSAGE_KEYS = ("role", "content", "name")
TOKEN_LIMIT = 4096
TOKENS_PER_MESSAGE = 3
TOKENS_PER_NAME = 1
TOKENS_PER_EXAMPLE = 3
TARGET_EPOCHS, MIN_EPOCHS, MAX_EPOCHS = 3, 1, 25
MIN_EXAMPLES, MAX_EXAMPLES = 100, 25000
DEFECTS = (
    "data_type",
    "missing_messages_list",
    "message_missing_key",
    "message_unrecognized_key",
    "unrecognized_role",
    "missing_content",
    "example_missing_assistant_message",
)


def legacy_examples(df: DataFrame, text: str, answer: str) -> DataFrame:
    """Prompt and completion with their end marks."""
    return df.withColumn("prompt", F.concat(F.col(text), F.lit(PROMPT_END))).withColumn(
        "completion", F.concat(F.lit(" "), F.col(answer), F.lit(COMPLETION_END))
    )


def chat_examples(user: Column, assistant: Column, system: str = SYSTEM_TEXT) -> Column:
    """The three messages of one example."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", user), message("assistant", assistant)).alias(
        "messages"
    )


def _is_type(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def chat_defects(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row (defect, n) per kind of defect found in lines of JSON."""
    parsed = lines.select(F.try_parse_json(line).alias("v"))
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    messages = F.try_variant_get("v", "$.messages", "array<variant>")
    opened = parsed.select(fields.isNotNull().alias("is_object"), messages.alias("messages"))
    has_list = F.coalesce(F.size("messages") > 0, F.lit(False))

    def role(m: Column) -> Column:
        return F.try_variant_get(m, "$.role", "string")

    def per_message(m: Column) -> Column:
        keys = F.coalesce(F.map_keys(F.try_variant_get(m, "$", "map<string,variant>")), F.array().cast("array<string>"))
        content = F.try_variant_get(m, "$.content", "variant")
        text = F.try_variant_get(m, "$.content", "string")
        return F.struct(
            indicator(~(F.array_contains(keys, "role") & F.array_contains(keys, "content"))).alias("message_missing_key"),
            indicator(F.exists(keys, lambda k: ~k.isin(*MESSAGE_KEYS))).alias("message_unrecognized_key"),
            indicator(~F.coalesce(role(m).isin(*ROLES), F.lit(False))).alias("unrecognized_role"),
            indicator(~(_is_type(content, "STRING") & (F.length(text) > 0))).alias("missing_content"),
        )

    checked = opened.select(
        "is_object",
        has_list.alias("has_list"),
        F.transform("messages", per_message).alias("found"),
        F.exists("messages", lambda m: F.coalesce(role(m) == "assistant", F.lit(False))).alias("answered"),
    )

    def total(name: str) -> Column:
        return F.aggregate(F.transform(F.coalesce(F.col(f"found.{name}"), F.array()), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    counts = checked.select(
        indicator(~F.col("is_object")).alias("data_type"),
        indicator(F.col("is_object") & ~F.col("has_list")).alias("missing_messages_list"),
        *[F.when(F.col("is_object") & F.col("has_list"), total(d)).otherwise(0).alias(d) for d in DEFECTS[2:6]],
        indicator(F.col("is_object") & F.col("has_list") & ~F.col("answered")).alias(DEFECTS[6]),
    )
    summed = counts.agg(*[F.sum(d).cast("long").alias(d) for d in DEFECTS])
    return summed.unpivot([], list(DEFECTS), "defect", "n").filter("n > 0")


def word_count(text: Column) -> Column:
    """Default token count: words between spaces."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def chat_stats(
    turns: DataFrame, example: Sequence[str], role: str, text: str, tokens: Column | None = None, name: str | None = None
) -> DataFrame:
    """Per example: messages, tokens, assistant tokens, and whether system and user speak."""
    size = word_count(F.col(text)) if tokens is None else tokens
    spent = TOKENS_PER_MESSAGE + word_count(F.col(role)) + size
    if name:
        spent = spent + F.when(F.col(name).isNotNull(), word_count(F.col(name)) + TOKENS_PER_NAME).otherwise(0)
    return turns.groupBy(*example).agg(
        F.count(F.lit(1)).alias("n_messages"),
        (F.coalesce(F.sum(spent), F.lit(0)) + TOKENS_PER_EXAMPLE).alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col(role) == "assistant", size)), F.lit(0)).alias("n_assistant_tokens"),
        F.max(indicator(F.col(role) == "system")).alias("has_system"),
        F.max(indicator(F.col(role) == "user")).alias("has_user"),
    )


def missing_roles(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count_if(F.col("has_system") == 0).alias("n_missing_system"),
        F.count_if(F.col("has_user") == 0).alias("n_missing_user"),
    )


def too_long(stats: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    return stats.agg(F.count_if(F.col("n_tokens") > limit).alias("n_too_long"))


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest, largest, mean, median and the 0.1 and 0.9 quantiles of each column, one row each.

    Quantiles are exact; they are found by rounds of narrower ranges (see ``quantiles``), which are
    jobs when the operator is built. A column without values has a row of missing values.
    """
    values = stage(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    found = quantiles(values, columns, (0.1, 0.5, 0.9))
    kinds = {F.min: "min", F.max: "max", F.avg: "mean"}
    ends = values.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(columns) for f, n in kinds.items()]).first()
    rows = [(c, *[ends[f"{n}{k}"] for n in kinds.values()], found[c][1], found[c][0], found[c][2]) for k, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "measure string, " + ", ".join(f"{n} double" for n in (*kinds.values(), "median", "q10", "q90")))


def training_budget(stats: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Examples, epochs and billed tokens of a training run."""
    n = F.col("n_examples")
    few = F.least(F.lit(MAX_EPOCHS).cast("long"), F.floor(F.try_divide(F.lit(MIN_EXAMPLES), n)))
    many = F.greatest(F.lit(MIN_EPOCHS).cast("long"), F.floor(F.try_divide(F.lit(MAX_EXAMPLES), n)))
    epochs = (
        F.when(n * TARGET_EPOCHS < MIN_EXAMPLES, few)
        .when(n * TARGET_EPOCHS > MAX_EXAMPLES, many)
        .otherwise(F.lit(TARGET_EPOCHS).cast("long"))
    )
    totals = stats.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.coalesce(F.sum(F.least(F.lit(limit).cast("long"), F.col("n_tokens"))), F.lit(0)).alias("billing_tokens"),
    )
    return totals.withColumn("n_epochs", epochs).withColumn("total_tokens", F.col("n_epochs") * F.col("billing_tokens"))
