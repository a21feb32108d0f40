"""Text cleaning, pieces of texts, chat examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairtender.checks.registry import query
from fairtender.checks.standin import sql, table
from fairtender.functions import formats, text as tx
from fairtender.operators import chat
from fairtender.operators.chunks import chunk_text
from fairtender.operators.quantiles import quantiles
from fairtender.plans import training
from fairtender.session import scratch_path

SPACES = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _replace_all(text, steps):
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


CLEAN = _replace_all(
    "text",
    [("\\$+", " "), ("\\n+", " "), ("\\.+", "."), (",+", ","), (";", " "), (" +", " "), ("[^a-zA-ZÀ-ÿ0-9 ,./:]", "")],
)
NORMAL = f"trim({_replace_all(f'''trim(regexp_replace(lower(text), '{SPACES}+', ' ', 'g'))''', [('\\.+', '.'), (',+', ',')])})"


@query("text_clean", f"SELECT doc_id, md5({CLEAN}) AS clean_md5, CAST(length({CLEAN}) AS INT) AS n FROM documents")
def text_clean(spark, sf):
    clean = tx.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).alias("n"))


@query("text_normalise", f"SELECT doc_id, md5({NORMAL}) AS normal_md5, CAST(length({NORMAL}) AS INT) AS n FROM documents")
def text_normalise(spark, sf):
    normal = tx.normalise_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(normal).alias("normal_md5"), F.length(normal).alias("n"))


@query("letters_only_length", "SELECT doc_id, CAST(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS INT) AS letters FROM documents")
def letters_only_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.letter_count(F.col("text")).alias("letters"))


@query(
    "route_extraction",
    "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) < 1000 THEN 'OCR' ELSE 'PDF_Reader' END AS extraction_type FROM documents",
)
def route_extraction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.route_extraction(F.col("text")).alias("extraction_type"))


@query(
    "name_parts",
    """SELECT doc_id, p[1] AS tipo_doc, p[3] AS idproceso, array_to_string(p[-2:], '_') AS id_documento FROM (
      SELECT doc_id, string_split(CASE WHEN doc_id % 5 = 0 THEN source ELSE concat(source, '_', lang, '_', doc_id, '_', n_chars) END, '_') AS p FROM documents) t""",
)
def name_parts(spark, sf):
    full = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    name = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(full)
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.name_part(name, 0).alias("tipo_doc"),
        tx.name_part(name, 2).alias("idproceso"),
        tx.name_tail(name).alias("id_documento"),
    )


@query("strip_path", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS n_cod_contrato FROM documents")
def strip_path(spark, sf):
    path = F.concat(F.lit("/data/"), "source", F.lit("/pdf_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf, "documents").select("doc_id", tx.contract_code(path).alias("n_cod_contrato"))


@query(
    "strip_leading_spaces",
    "SELECT p_partkey, regexp_replace(concat(repeat(' ', CAST(p_size % 3 AS INT)), p_name), '^ +', '') AS p_name, p_size FROM part",
)
def strip_leading_spaces(spark, sf):
    padded = F.concat(F.repeat(F.lit(" "), (F.col("p_size") % 3).cast("int")), "p_name")
    return tx.strip_leading_spaces(table(spark, sf, "part").select("p_partkey", padded.alias("p_name"), "p_size"))


@query("blank_to_default", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'No Match' ELSE p_type END AS cargo FROM part")
def blank_to_default(spark, sf):
    gap = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", tx.blank_to(gap).alias("cargo"))


TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[\\pL]+|[^\\pL]+'), lambda w: concat(CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END, lower(w[2:]))), '')"


@query("title_case", f"SELECT doc_id, md5({TITLE.format('text')}) AS title_md5 FROM documents")
def title_case(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.title_case(F.col("text"))).alias("title_md5"))


@query("prefix_suffix", "SELECT doc_id, md5(concat('''', text)) AS quoted, md5(concat(text, '---->')) AS prompt FROM documents")
def prefix_suffix(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.quote_mark(text)).alias("quoted"), F.md5(tx.prompt_text(text)).alias("prompt")
    )


@query(
    "completion_text",
    f"""SELECT p_partkey, regexp_replace(concat(' ', {TITLE.format('p_name')}, '; ', {TITLE.format('p_type')}, chr(10), chr(10),
      CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, chr(10), chr(10), p_type, chr(10), chr(10), chr(10), chr(10), '###', chr(10), chr(10)),
      '(\n\n)+', concat(chr(10), chr(10)), 'g') AS completion FROM part""",
)
def completion_text(spark, sf):
    some = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    text = tx.completion_text(tx.title_case(F.col("p_name")), tx.title_case(F.col("p_type")), some, F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", text.alias("completion"))


@query(
    "join_nonnull",
    """SELECT p_partkey, concat_ws('; ', CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END,
      CASE WHEN p_size % 2 = 0 THEN p_brand END, CAST(p_partkey AS VARCHAR),
      concat(CAST(CAST(round(p_retailprice * 10000) AS BIGINT) AS VARCHAR), '.0'),
      rtrim(printf('%.5f', p_size / 100000.0), '0')) AS precios_unitarios FROM part""",
)
def join_nonnull(spark, sf):
    size = F.col("p_size")
    large, tiny = F.round(F.col("p_retailprice") * 1e4), size / 1e5
    joined = tx.join_nonnull(F.when(size % 3 != 0, size), F.when(size % 2 == 0, F.col("p_brand")), F.col("p_partkey"), large, tiny)
    return table(spark, sf, "part").select("p_partkey", joined.alias("precios_unitarios"))


@query(
    "num_format_stars",
    """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '- -' ELSE concat(printf('%.2f', p_retailprice + 0.1234),
      repeat('*', CAST((p <= 0.1) AS INT) + CAST((p <= 0.05) AS INT) + CAST((p <= 0.01) AS INT))) END AS coef_text,
      CASE WHEN p_size % 10 = 0 THEN '' ELSE concat('(', printf('%.3f', p), ')') END AS stderr_text
    FROM (SELECT *, p_partkey % 16 / 130.0 AS p FROM part) t""",
)
def num_format_stars(spark, sf):
    coef = F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice") + 0.1234)
    p = F.col("p_partkey") % 16 / 130.0
    return table(spark, sf, "part").select(
        "p_partkey", formats.estimate_text(coef, p, 2).alias("coef_text"), formats.error_text(coef, p).alias("stderr_text")
    )


# ---- pieces of texts ---------------------------------------------------------------------

def _pieces_sql(n, body):
    """Cut points by recursion over the word list of each text."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split({NORMAL}, ' '), lambda x: x <> '') AS t FROM documents),
    e AS (SELECT doc_id, len(t) AS size, list_filter(range(1, len(t) + 1), lambda i: t[i] LIKE '%.') AS stops FROM w),
    c AS (SELECT doc_id, 0 AS a, 0 AS b, 0 AS chunk FROM e UNION ALL
      SELECT doc_id, b, coalesce(list_max(list_filter(stops, lambda s: s > b + {int(0.9 * n)} AND s <= b + {int(1.1 * n)})),
        CASE WHEN size <= b + {int(0.9 * n)} THEN size ELSE least(b + {n}, size) END), chunk + 1
      FROM c JOIN e USING (doc_id) WHERE b < size),
    p AS (SELECT doc_id, CAST(chunk AS INT) AS chunk, array_to_string(t[a + 1:b], ' ') AS piece FROM c JOIN w USING (doc_id) WHERE chunk > 0)
    {body}"""


def _ends_sql(name):
    return f"CASE WHEN count(*) > 1 THEN concat(min_by(piece, chunk), ' ', max_by(piece, chunk)) ELSE coalesce(max(piece), '') END AS {name}"


@query("chunk_text", _pieces_sql(100, "SELECT doc_id, chunk, md5(piece) AS piece_md5 FROM p"))
def chunk_all(spark, sf):
    normal = table(spark, sf, "documents").select("doc_id", tx.normalise_text(F.col("text")).alias("text"))
    return chunk_text(normal, "text", 100).select("doc_id", "chunk", F.md5("text").alias("piece_md5"))


def _ends_query(n):
    body = f"SELECT doc_id, md5(ends) AS ends_md5 FROM (SELECT doc_id, {_ends_sql('ends')} FROM w LEFT JOIN p USING (doc_id) GROUP BY doc_id) e"

    @query(f"chunk_first_last_{n}", _pieces_sql(n, body))
    def run(spark, sf):
        normal = table(spark, sf, "documents").select("doc_id", tx.normalise_text(F.col("text")).alias("text"))
        return chunk_text(normal, "text", n, "first_last").select("doc_id", F.md5("text").alias("ends_md5"))

    return run


for _n in (600, 800, 1500, 1800):
    _ends_query(_n)


# ---- chat --------------------------------------------------------------------------------

@query(
    "legacy_examples",
    "SELECT doc_id, md5(concat(text, '---->')) AS prompt, concat(' ', source, ' ', chr(10), chr(10), '###', chr(10), chr(10)) AS completion FROM documents",
)
def legacy_examples(spark, sf):
    made = chat.legacy_examples(table(spark, sf, "documents"), "text", "source")
    return made.select("doc_id", F.md5("prompt").alias("prompt"), "completion")


@query(
    "chat_examples",
    f"""SELECT doc_id, 'system' AS role, md5('{chat.SYSTEM_TEXT}') AS content_md5 FROM documents
    UNION ALL SELECT doc_id, 'user', md5(text) FROM documents UNION ALL SELECT doc_id, 'assistant', md5(source) FROM documents""",
)
def chat_examples(spark, sf):
    made = table(spark, sf, "documents").select("doc_id", chat.chat_examples(F.col("text"), F.col("source")))
    return made.select("doc_id", F.explode("messages").alias("m")).select("doc_id", "m.role", F.md5("m.content").alias("content_md5"))


def _turn_lines(turns):
    """A line of JSON per turn, faulty in one way or another by its numbers."""
    case = (F.col("conv_id") * 7 + F.col("turn")) % 11
    good = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    renamed = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("words"))).alias("messages")))
    tool = F.to_json(F.struct(F.array(F.struct(F.lit("tool").alias("role"), F.col("text").alias("content"))).alias("messages")))
    number = F.to_json(F.struct(F.array(F.struct("role", F.col("turn").alias("content"))).alias("messages")))
    empty = F.to_json(F.struct(F.array(F.struct("role", F.lit("").alias("content"))).alias("messages")))
    return (
        F.when(case == 0, F.to_json(F.array("text")))
        .when(case == 1, F.to_json(F.struct(F.col("text").alias("message"))))
        .when(case == 2, F.lit('{"messages":[]}'))
        .when(case == 3, renamed)
        .when(case == 4, tool)
        .when(case == 5, number)
        .when(case == 6, empty)
        .otherwise(good)
    )


CASES = "(SELECT *, (conv_id * 7 + turn) % 11 AS k FROM conversations) t"
DEFECT_RULES = {
    "data_type": "k = 0",
    "missing_messages_list": "k IN (1, 2)",
    "message_missing_key": "k = 3",
    "message_unrecognized_key": "k = 3",
    "unrecognized_role": "k = 4",
    "missing_content": "k IN (3, 5, 6)",
    "example_missing_assistant_message": "k >= 3 AND (k = 4 OR role <> 'assistant')",
}
DEFECTS_SQL = " UNION ALL ".join(f"SELECT '{d}' AS defect, count(*) AS n FROM {CASES} WHERE {rule} HAVING count(*) > 0" for d, rule in DEFECT_RULES.items())


@query("chat_validate", DEFECTS_SQL)
def chat_validate(spark, sf):
    turns = table(spark, sf, "conversations")
    return chat.chat_defects(turns.select(_turn_lines(turns).alias("value")))


@query(
    "agg_format_errors",
    """SELECT defect, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN text = '' THEN 'missing_content' END,
      CASE WHEN role NOT IN ('user', 'assistant') THEN 'unrecognized_role' END], lambda d: d IS NOT NULL)) AS defect FROM conversations) t GROUP BY 1""",
)
def agg_format_errors(spark, sf):
    """The counter of named defects on typed turns."""
    defects = F.array_compact(F.array(
        F.when(F.col("text") == "", "missing_content"), F.when(~F.col("role").isin("user", "assistant"), "unrecognized_role"),
    ))
    return table(spark, sf, "conversations").select(F.explode(defects).alias("defect")).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
STATS = f"""SELECT conv_id, count(*) AS n_messages, CAST(sum(3 + 1 + {WORDS}) + 3 AS BIGINT) AS n_tokens,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN {WORDS} END), 0) AS BIGINT) AS n_assistant_tokens,
  CAST(max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS INT) AS has_system,
  CAST(max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS INT) AS has_user FROM conversations GROUP BY conv_id"""


def _stats(spark, sf):
    return chat.chat_stats(table(spark, sf, "conversations"), ["conv_id"], "role", "text")


def _stats_query(name, columns):
    @query(name, f"SELECT conv_id, {columns} FROM ({STATS}) s")
    def run(spark, sf):
        return _stats(spark, sf).select("conv_id", columns)

    return run


_stats_query("chat_token_counts", "n_tokens")
_stats_query("chat_assistant_tokens", "n_assistant_tokens")
_stats_query("chat_message_counts", "n_messages")


@query(
    "chat_missing_roles",
    f"SELECT count(*) FILTER (WHERE has_system = 0) AS n_missing_system, count(*) FILTER (WHERE has_user = 0) AS n_missing_user FROM ({STATS}) s",
)
def chat_missing_roles(spark, sf):
    return chat.missing_roles(_stats(spark, sf))


@query("chat_too_long", f"SELECT count(*) FILTER (WHERE n_tokens > 4096) AS n_too_long FROM ({STATS}) s")
def chat_too_long(spark, sf):
    return chat.too_long(_stats(spark, sf))


@query(
    "agg_distribution",
    sql(" UNION ALL ".join(
        f"""SELECT '{c}' AS measure, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean,
        round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.1), 6) AS q10, round(quantile_cont({c}, 0.9), 6) AS q90 FROM s"""
        for c in ("n_messages", "n_tokens", "n_assistant_tokens")
    ), s=STATS),
)
def agg_distribution(spark, sf):
    out = chat.distribution(_stats(spark, sf), ["n_messages", "n_tokens", "n_assistant_tokens"])
    return out.select("measure", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median", "q10", "q90")])


@query(
    "quantiles_of_amounts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS measure, {', '.join(f'round(quantile_cont({c}, {q}), 6) AS q{int(100 * q)}' for q in (0.01, 0.25, 0.5, 0.99))} FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
    ),
)
def quantiles_of_amounts(spark, sf):
    """Measures of many different values, which no task gathers."""
    amounts = table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity")])
    found = quantiles(amounts, amounts.columns, (0.01, 0.25, 0.5, 0.99), few=1000)
    rows = spark.createDataFrame([(c, *v) for c, v in found.items()], "measure string, q1 double, q25 double, q50 double, q99 double")
    return rows.select("measure", *[F.round(q, 6).alias(q) for q in ("q1", "q25", "q50", "q99")])


@query(
    "training_budget",
    f"""SELECT n AS n_examples, b AS billing_tokens, e AS n_epochs, e * b AS total_tokens FROM (SELECT n, b, CAST(CASE
        WHEN n * 3 < 100 THEN least(25, 100 // n) WHEN n * 3 > 25000 THEN greatest(1, 25000 // n) ELSE 3 END AS BIGINT) AS e
      FROM (SELECT count(*) AS n, CAST(sum(least(4096, n_tokens)) AS BIGINT) AS b FROM ({STATS}) s) t) u""",
)
def training_budget(spark, sf):
    return chat.training_budget(_stats(spark, sf))


# ---- the whole chain ---------------------------------------------------------------------

CLEAN_NORMAL = NORMAL.replace("lower(text)", f"lower({CLEAN})")
ANSWER = "concat(CASE WHEN doc_id % 3 <> 0 THEN concat(doc_id, '.5; ') ELSE '' END, n_chars)"
EXAMPLES = _pieces_sql(training.PIECE_TOKENS, f"SELECT doc_id, {_ends_sql('ends')} FROM w LEFT JOIN p USING (doc_id) GROUP BY doc_id").replace(NORMAL, CLEAN_NORMAL)
PROMPT, COMPLETION = "concat(ends, '---->')", f"concat(' ', {ANSWER}, ' ', chr(10), chr(10), '###', chr(10), chr(10))"


def _examples(spark, sf):
    priced = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") + 0.5).alias("first"), "n_chars")
    return training.training_examples(priced, ["first", "n_chars"])


@query("training_examples", f"SELECT doc_id, md5({PROMPT}) AS prompt_md5, {COMPLETION} AS completion FROM documents JOIN ({EXAMPLES}) e USING (doc_id)")
def training_examples(spark, sf):
    return _examples(spark, sf).select("doc_id", F.md5("prompt").alias("prompt_md5"), "completion")


def _words_sql(text):
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> ''))"


@query(
    "training_file",
    f"""SELECT n AS n_examples, b AS billing_tokens, e AS n_epochs, e * b AS total_tokens, CAST(0 AS BIGINT) AS n_defects FROM (SELECT n, b, CAST(CASE
        WHEN n * 3 < 100 THEN least(25, 100 // n) WHEN n * 3 > 25000 THEN greatest(1, 25000 // n) ELSE 3 END AS BIGINT) AS e
      FROM (SELECT count(*) AS n, CAST(sum(least(4096, 3 + 3 * (3 + 1) + {_words_sql(f"'{chat.SYSTEM_TEXT}'")} + {_words_sql(PROMPT)} + {_words_sql(COMPLETION)})) AS BIGINT) AS b
        FROM documents JOIN ({EXAMPLES}) e USING (doc_id)) t) u""",
)
def training_file(spark, sf):
    defects, _, budget = training.training_file(_examples(spark, sf), scratch_path(spark, "training"))
    return budget.withColumn("n_defects", F.lit(defects.count()).cast("long"))
