"""Rules of missing values, prices, texts, chunks and chat checks on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from fairtender.functions import codes, formats
from fairtender.functions import prices as pr
from fairtender.functions import text as tx
from fairtender.operators import chat, rows, shape
from fairtender.operators.chunks import chunk_text, cut_points, sentence_ends
from fairtender.operators.merge import report_duplicates
from fairtender.plans.contracts import item_groups, spread_long


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_ratio_with_missing_high(spark):
    df = spark.createDataFrame([(0.85, 1.0), (0.86, 1.0), (None, 1.0), (1.0, 0.0)], "a double, b double")
    assert [r["a"] for r in df.filter(rows.at_most("a", "b", 0.85)).collect()] == [0.85]


def test_above_counts_missing(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "m int")
    assert [r[0] for r in df.select(rows.above("m", 2)).collect()] == [0, 1, 1]


SPREAD_CASES = [
    (2, [1.0, 2.0, 3.0, 4.0, 5.0], {1: 1.5, 2: 3.5}),
    (3, [7.0, 8.0], {1: 7.0, 2: 8.0}),
    (2, [5.0, 5.0], {1: 5.0}),
    (1, [None], {1: None}),
    (1, None, {1: None}),
    (2, [None], {}),
    (0, [3.0], {}),
    (None, [3.0], {}),
    (2, [None, 4.0, None, 6.0, 9.0], {1: 4.0, 2: 6.0}),
    (1, [2.0, 4.0, 6.0], {1: 4.0}),
]


@pytest.mark.parametrize("m,prices,expected", SPREAD_CASES)
def test_spread_prices(spark, m, prices, expected):
    df = spark.createDataFrame([(m, prices)], "m int, p array<double>")
    got = df.select(F.inline(pr.spread_prices(F.col("p"), F.col("m")))).collect()
    assert {r["item_group"]: r["mean_unit_price"] for r in got} == expected


def test_both_spreads_agree(spark):
    rng = random.Random(3)
    answers = [(c, rng.randrange(1, 6), [rng.choice([None, 1.0, 2.0, 3.5, 8.0]) for _ in range(rng.randrange(1, 12))]) for c in range(200)]
    wide = spark.createDataFrame(answers, "n_cod_contrato int, item_count int, p array<double>")
    near = wide.select("n_cod_contrato", F.inline(pr.spread_prices(F.col("p"), F.col("item_count"))))
    long = shape.array_to_long(wide, ["n_cod_contrato", "item_count"], "p", "identified_price_id", "unit_price")
    far = spread_long(long, hot_rows=20)

    def as_dict(df):
        return {(r["n_cod_contrato"], r["item_group"]): r["mean_unit_price"] for r in df.collect()}

    a, b = as_dict(near), as_dict(far)
    assert a.keys() == b.keys()
    assert all(a[k] == b[k] or a[k] == pytest.approx(b[k]) for k in a)


def test_item_groups_keep_surplus(spark):
    data = [(1, 2, i, float(i)) for i in range(1, 6)]
    df = spark.createDataFrame(data, "n_cod_contrato int, item_count int, identified_price_id int, unit_price double")
    got = sorted((r["i"], r["item_group"]) for r in item_groups(df).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]


@pytest.mark.parametrize(
    "text,dialect,expected",
    [
        ("S/ 1,200.50; 30", "main", [1.0, 200.5, 30.0]),
        ("S/ 1,200.50; 30", "computers", [1200.5, 30.0]),
        ("1.2.3", "main", [None]),
        ("1..5-2", "main", [1.5, 2.0]),
        ("No Match", "main", [None]),
        ("120.; .", "main", [120.0, None]),
    ],
)
def test_parse_prices(spark, text, dialect, expected):
    assert one(spark, text, "string", lambda c: pr.parse_prices(c, dialect)) == expected


def test_period_numbers(spark):
    df = spark.createDataFrame([("2019-01-15",), ("2019-11-30",), ("2018-06-30",), ("2019-10-01",)], "d string")
    got = df.select(codes.month_index(F.to_date("d")), codes.quarter_index(F.to_date("d"))).collect()
    assert [r[0] for r in got][:2] == [708, 718]
    assert [r[1] for r in got][2:] == [233, 239]


def test_code_rules(spark):
    code = "51234501" + "0000000000004711 "[:17].strip().rjust(17, "0")
    assert one(spark, code, "string", codes.item_code) == 4711
    assert one(spark, "000000000000000000000000x", "string", codes.item_code) is None
    for value, expected in ((721214, 1), (851218, 2), (801015, 3), (921015, 4), (519999, 5), (121419, 5), (421322, 6), (501215, 7), (1, None), (None, None)):
        assert one(spark, value, "int", codes.subsector) == expected
    assert one(spark, "Convenio", "string", codes.procedure_group) == 4
    assert one(spark, "Otro", "string", codes.procedure_group) is None


def test_text_rules(spark):
    assert one(spark, "a$$b\n\nc...d,,e;f   g#É!", "string", tx.clean_text) == "a b c.d,e f gÉ"
    assert one(spark, "  A \t B..,,C\x1cD  ", "string", tx.normalise_text) == "a b.,c d"
    for t in ("o'neil ab-cd x1y", "", "straße 12ab", "ÁRBOL niño", "a_b.c"):
        assert one(spark, t, "string", tx.title_case) == t.title()
    assert one(spark, "/x/pdf_77.pdf", "string", tx.contract_code) == "77"
    assert one(spark, "a_b_c_d", "string", tx.name_tail) == "c_d"
    assert one(spark, "a" * 999, "string", tx.route_extraction) == "OCR"
    assert one(spark, "a" * 1000, "string", tx.route_extraction) == "PDF_Reader"
    links = one(spark, """<a class="x" href="/a/b?x=1&amp;y=2">A</a><A HREF='c.d'>B</A><a name="n">C</a><area href="no">""", "string", tx.href_links)
    assert links == ["/a/b?x=1&y=2", "c.d"]


def plain_cuts(tokens, n):
    """The chunk rule told step by step."""
    out, i = [], 0
    while i < len(tokens):
        top, bottom = min(i + int(1.1 * n), len(tokens)), i + int(0.9 * n)
        if len(tokens) <= bottom:
            out.append((i, len(tokens)))
            break
        stops = [j for j in range(bottom + 1, top + 1) if tokens[j - 1].endswith(".")]
        j = max(stops) if stops else min(i + n, len(tokens))
        out.append((i, j))
        i = j
    return out


def test_cut_points():
    rng = random.Random(1)
    for _ in range(300):
        tokens = [rng.choice(["a", "b", "c."] if rng.random() < 0.3 else ["a", "b"]) for _ in range(rng.randrange(0, 90))]
        n = rng.randrange(5, 30)
        assert cut_points(len(tokens), sentence_ends(tokens, lambda t: t[-1]), n) == plain_cuts(tokens, n)


def test_chunk_modes(spark):
    texts = ["", "w " * 25 + "end.", "a b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    all_rows = chunk_text(df, "text", 10).orderBy("id", "chunk").collect()
    assert [(r["id"], r["chunk"]) for r in all_rows] == [(1, 1), (1, 2), (1, 3), (2, 1)]
    ends = {r["id"]: r["text"] for r in chunk_text(df, "text", 10, "first_last").collect()}
    assert ends[1] == " ".join(["w"] * 10) + " " + all_rows[2]["text"]
    assert ends[0] == "" and ends[2] == "a b"

    class Letters:
        def encode(self, text):
            return list(text)

        def decode(self, tokens):
            return "".join(tokens)

    got = chunk_text(df.filter("id = 1"), "text", 10, tokenizer=Letters()).orderBy("chunk").collect()
    assert "".join(r["text"] for r in got) == texts[1]


def test_chat_defects(spark):
    lines = [
        '{"messages": [{"role": "system", "content": "s"}, {"role": "assistant", "content": "a"}]}',
        '["not an object"]',
        "{}",
        '{"messages": []}',
        '{"messages": null}',
        '{"messages": [{"role": "assistant"}]}',
        '{"messages": [{"role": "assistant", "content": "x", "weight": 1}]}',
        '{"messages": [{"role": "tool", "content": "x"}, {"role": "assistant", "content": "x", "name": "n"}]}',
        '{"messages": [{"role": "assistant", "content": ""}, {"role": "assistant", "content": 5}]}',
        '{"messages": [{"role": "user", "content": "x"}]}',
    ]
    got = {r["defect"]: r["n"] for r in chat.chat_defects(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {
        "data_type": 1, "missing_messages_list": 3, "message_missing_key": 1, "message_unrecognized_key": 1,
        "unrecognized_role": 1, "missing_content": 3, "example_missing_assistant_message": 1,
    }


@pytest.mark.parametrize("n,epochs", [(1, 25), (5, 20), (30, 3), (34, 3), (8333, 3), (8334, 2), (30000, 1)])
def test_training_epochs(spark, n, epochs):
    stats = spark.range(n).select(F.lit(5000).cast("long").alias("n_tokens"))
    row = chat.training_budget(stats).first()
    assert (row["n_epochs"], row["billing_tokens"]) == (epochs, 4096 * n)
    assert chat.training_budget(stats.limit(0)).first()["n_examples"] == 0


def test_distribution_is_exact(spark):
    values = [1, 2, 2, 3, 10, 11, 12, 50]
    row = chat.distribution(spark.createDataFrame([(v,) for v in values], "x int"), ["x"]).first()
    import numpy as np

    assert (row["min"], row["max"], row["mean"], row["median"]) == (1, 50, np.mean(values), np.median(values))
    assert row["q10"] == pytest.approx(np.quantile(values, 0.1)) and row["q90"] == pytest.approx(np.quantile(values, 0.9))


def test_union_mark_keeps_copies_across_sources(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    assert shape.union_marked(df, df, "src").distinct().count() == 2


def test_duplicates_report(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (None,)], "a int")
    got = {r["copies"]: (r["observations"], r["surplus"]) for r in report_duplicates(df, ["a"]).collect()}
    assert got == {1: (1, 0), 2: (2, 1), 3: (3, 2)}


def test_shares_with_a_missing_part(spark):
    df = spark.createDataFrame([(1, 3), (None, 2), (0, 0)], "a int, b int")
    got = [(r["t"], r["x"]) for r in shape.share_of_total(df, ["a", "b"], "t", ["x", "y"]).collect()]
    assert got == [(4, 0.25), (None, None), (0, None)]


def test_printed_numbers(spark):
    df = spark.createDataFrame([(1.23456, 0.009), (1.0, 0.05), (1.0, 0.1), (1.0, 0.2), (0.0, 0.0), (None, None)], "b double, p double")
    got = [r[0] for r in df.select(formats.estimate_text(F.col("b"), F.col("p"))).collect()]
    assert got == ["1.235***", "1.000**", "1.000*", "1.000", "- -", "- -"]
