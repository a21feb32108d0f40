"""Operators over documents against plain versions, on a small table and on awkward rows."""

import math
import random
import time
import zlib

import numpy as np
import plain
import pytest
from conftest import sentence
from pyspark.sql import functions as F

from fairtender.llm import decontaminate, fingerprints, jaccard, language, mixing, pii, queries, substring, tokens
from fairtender.session import scratch_path


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# personal data


def check_spans(df, docs):
    text = {}
    for r in docs.select("doc_id", "text").collect():
        text.setdefault(r.doc_id, []).append(r.text)
    for r in rows_of(df):
        fits = []
        for t in text[r["doc_id"]]:
            spans = plain.base_spans(t)
            told = ",".join(f"{k}:{a}:{b}" for k in plain.BASE for a, b in spans[k])
            fits.append(plain.sha(told) == r["base_sha256"] and all(r[f"n_{k}"] == len(spans[k]) for k in plain.BASE))
        assert any(fits), r


def test_personal_data(spark, small, awkward):
    check_spans(queries.op1_personal_data(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = pii.summary(pii.find(awkward))
    check_spans(found, awkward)
    assert found.count() == awkward.count()
    assert pii.summary(pii.find(awkward.limit(0))).count() == 0


PII_TEXTS = [
    "a@b.c%d@e.f.g x@y x@y.z. a.b+c@d-e.f-", "a@b@c.d a@@b.c @b.c", "1.2.3.4.5 256.1.1.1 0255.0.0.1 1.2.3 1.2.3.4x 9999999999999999999999.1.1.1",
    "4111 1111-1111 1111 4111--1111 41111111111111112 0000000000000", "+1 (743) 555-3824) +12 +1234567890123456 ++49 30 1234567- +5((((",
    "é中🎈 a@b.cd +49 301 234 567 🎈1.1.1.1", "5" * 40 + " 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", " ".join(f"u{i}@h{i}.org" for i in range(700)),
]


def test_personal_data_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    check_spans(pii.summary(pii.find(docs)), docs)


def test_personal_data_random(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1.@+- (4%") for _ in range(200)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_spans(pii.summary(pii.find(docs)), docs)


def test_personal_data_method(spark):
    texts = ["my IBAN is DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "ssn 123-45-6789", "part 123-45-6789", "visa card 4111111111111111", "x" * 60 + " 4111111111111111"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [[s.kind for s in r.found] for r in rows]
    assert kinds == [["iban"], [], ["ssn"], [], ["card"], ["card"]]
    assert texts[0][rows[0].found[0].start : rows[0].found[0].end] == "DE89 3704 0044 0532 0130 00"
    assert rows[4].found[0].score > rows[5].found[0].score


def test_personal_data_context_beyond_neighbours(spark):
    texts = ["é🎈 SSN: 123-45-6789, 219-09-9999.", "SSN" + " x" * 25 + " 219-09-9999", "visa 1234 5678, 4111111111111111", "4111111111111111 1234 5678 visa"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(s.kind, s.text) for s in r.found] for r in rows[:2]] == [[("ssn", "123-45-6789"), ("ssn", "219-09-9999")], []]
    alone = pii.find(spark.createDataFrame([(0, "4111111111111111")], "doc_id long, text string")).first().found[0].score
    assert all(s.score > alone for r in rows[2:] for s in r.found if s.kind == "card")


def test_personal_data_of_long_texts(spark):
    """Four times the hits take about four times as long."""
    docs = lambda n: spark.createDataFrame([(i, "é a0@b.com 4111111111111111 " * n) for i in range(8)], "doc_id long, text string").cache()
    times = {}
    for n in (500, 4000, 16000):
        own = docs(n)
        own.count()
        start = time.perf_counter()
        rows = pii.find(own).select(F.size("found").alias("n"), F.array_max(F.transform("found", lambda s: s.end)).alias("end")).collect()
        times[n] = time.perf_counter() - start
        assert {(r.n, r.end) for r in rows} == {(2 * n, 28 * n - 1)}
    assert times[16000] < 7 * times[4000] + 2


# passages


def same_removal(df, docs):
    want = plain.remove_repeats(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(df)}
    assert got == want


def test_passages(spark, small, small_rows):
    same_removal(substring.remove_repeats(small), small_rows)


def test_passages_in_many_batches(spark):
    rng = random.Random(2)
    shared = [sentence(rng, n) for n in (12, 13, 14, 40)]
    docs = []
    for i in range(120):
        parts = [sentence(rng, rng.randrange(30)) for _ in range(3)]
        docs.append((i * 7 % 120, f" {rng.choice(shared)}\t".join(parts)))
    docs.append((500, "y " * 60))  # repeats within one document do not count
    same_removal(substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)), docs)


def test_passages_levels(spark):
    rng = random.Random(3)
    long = sentence(rng, 900, 10**6)
    docs = [(1, long), (2, "x " + long + " y"), (3, " ".join(long.split()[:60])), (4, "alone " * 3)]
    got = {r["doc_id"]: r for r in rows_of(substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got[1]["longest_repeat"] == got[2]["longest_repeat"] == 13 * 64
    assert got[3]["longest_repeat"] in (13, 26, 52) and got[4]["longest_repeat"] == 0
    assert got[2]["n_removed"] == 900 and got[1]["n_removed"] == 0 and got[2]["kept"] == "x y"


def test_passages_levels_are_exact(spark):
    rng = random.Random(12)
    docs = []
    for i, n in enumerate([12, 13, 25, 26, 27, 30, 50, 51, 52, 53, 100, 104, 110] * 3):
        shared = sentence(rng, n, 10**6)
        docs += [(2 * i, f"{sentence(rng, 20, 10**6)} {shared} {sentence(rng, 9, 10**6)}"), (2 * i + 1, f"{shared} {sentence(rng, 70, 10**6)}")]
    docs.append((200, f"{docs[-1][1]} {docs[0][1]} {docs[-2][1]}"))
    held, want = {}, {d: 0 for d, _ in docs}
    for length in (13, 26, 52, 104, 208):
        for d, t in docs:
            w = t.split()
            for j in range(len(w) - length + 1):
                held.setdefault(tuple(w[j : j + length]), set()).add(d)
        want |= {d: length for key, own in held.items() if len(key) == length and len(own) > 1 for d in own}
    got = {r["doc_id"]: r["longest_repeat"] for r in rows_of(substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))}
    assert got == want


def test_passages_awkward(spark, awkward):
    got = rows_of(substring.remove_repeats(awkward))
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_removed"] == 0 and by[3]["n_removed"] == 300 and by[4]["n_words"] == by[5]["n_words"] == 0
    assert by[15]["n_removed"] == 0
    assert substring.remove_repeats(awkward.limit(0)).count() == 0


def test_passages_of_copies(spark):
    """Copies of whole texts, also under one id or none, among near copies and short texts."""
    rng = random.Random(21)
    base, short = sentence(rng, 130, 10**6), sentence(rng, 12, 10**6)
    near = base.split()
    near[60] = "changed"
    docs = [(9, base), (4, base.replace(" ", "\n ")), (4, base), (7, " ".join(near)), (2, sentence(rng, 20, 10**6)), (1, short), (3, short), (8, base + " more"), (6, "only " + base), (5, sentence(rng, 13, 10**6))]
    docs += [(50 + i, docs[4][1]) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want, held = {}, {}
    for d, t in docs:
        for i in range(len(t.split()) - 12):
            key = tuple(t.split()[i : i + 13])
            held.setdefault(key, set()).add(d)
    for d, t in docs:
        w, gone = t.split(), set()
        for i in range(len(w) - 12):
            if min(held[tuple(w[i : i + 13])]) < d:
                gone |= set(range(i, i + 13))
        want.setdefault(d, []).append((len(w), len(gone), plain.sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got, most = {}, {}
    for r in rows_of(substring.remove_repeats(frame.repartition(6))):
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
        most[r["doc_id"]] = r["longest_repeat"]
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert most[9] == most[4] == most[8] == most[6] == 104 and most[7] == 52 and most[1] == most[3] == most[5] == 0 and most[2] == most[50] == 13
    none = spark.createDataFrame([(None, base), (3, base), (None, base)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows_of(substring.remove_repeats(none))) == [(-1, 130), (-1, 130), (3, 0)]


@pytest.mark.parametrize("clash", [False, True])
def test_asking_for_repeats(clash):
    """Tasks, buckets and ids in plain Python, with hot hashes and hashes of two windows."""
    rng, buckets = random.Random(22), 5
    tasks = [[(min(int(rng.expovariate(0.2)), 30), rng.randrange(3) if clash else 0, rng.randrange(40)) for _ in range(rng.randrange(60))] for _ in range(12)]

    def dealt(batches, *columns):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["bucket"])
        return iter([substring.pa.RecordBatch.from_pylist(rows[i : i + 7], schema=columns[0]) for i in range(0, len(rows), 7)])

    asked = [b for t in tasks for b in substring.entries(*[np.array([x[k] for x in t], kind) for k, kind in enumerate((np.uint64, np.uint32, np.int64))], buckets)]
    told = substring._answer(buckets)(dealt(asked, substring._ASKED))
    got = {}
    for b in substring._by_id(dealt(told, substring._ANSWERED)):
        for r in b.to_pylist():
            assert r["id"] not in got
            got[r["id"]] = dict(zip(np.frombuffer(r["again"], np.uint64).tolist(), np.frombuffer(r["earlier"], bool).tolist(), strict=True))
    held, want = {}, {}
    for t in tasks:
        for h, c, i in t:
            held.setdefault((h, c), set()).add(i)
    for (h, _), ids in held.items():
        for i in ids if len(ids) > 1 else ():
            want.setdefault(i, {})[h] = want.get(i, {}).get(h, False) or min(ids) < i
    assert got == want


# test items


def test_leaks(spark, small, small_rows, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r for r in rows_of(decontaminate.contaminated(small, items))}
    want = {}
    normal = [(d, decontaminate.normal(t).split()) for d, t in small_rows]
    for i in items.collect():
        item = decontaminate.normal(i.text).split()
        most = decontaminate.budget(len(item))
        common = set(item)
        for d, words in normal:
            if sum(w in common for w in words) >= len(item) - most:
                distance = plain.passage_distance(item, words)
                if distance <= most:
                    want[d, i.item_id] = distance
    assert {k: r["distance"] for k, r in got.items()} == want


def test_leaks_with_edits(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(1, 50), 60)) for i in range(30)] + [(90, None), (91, ""), (92, "?!"), (93, "one two"), (94, "one two")]
    docs = [(900, "one two"), (901, "one two three")]
    for i in range(150):
        words = items[i % 30][1].split()
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = ["new"] * rng.randrange(2)
        docs.append((i, f"{sentence(rng, 20, 60)} {' '.join(words).upper()}, {sentence(rng, 20, 60)}"))
    rows = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for i, t in items:
        item = decontaminate.normal(t).split()
        for d, x in docs:
            words = decontaminate.normal(x).split()
            distance = plain.passage_distance(item, words)
            if item and distance <= decontaminate.budget(len(item)):
                want[d, i] = distance
    for chars in (10**6, 200):  # one block of items and many
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows_of(decontaminate.contaminated(frame, rows, chars=chars))}
        assert got == want
    for chars in (10**6, 200):
        clean = decontaminate.clean(frame.withColumn("doc", F.lit(1)), rows, chars=chars)
        assert clean.columns == ["doc_id", "text", "doc"]
        assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_of_short_items_and_unspaced_scripts(spark):
    items = [(1, "two words"), (2, "one"), (3, "\u6211\u4eec\u5728\u8fd9\u91cc\u5403\u996d"), (4, "ten words of which two may be others than these")]
    docs = [(1, "some Two, words here"), (2, "two other words"), (3, "\u4eca\u5929\u6211\u4eec\u5728\u8fd9\u91cc\u5403\u996d\u3002"), (4, "\u6211\u4eec\u5728\u8fd9\u91cc\u559d\u996d"), (5, "ten words of what two may be other than these"), (6, "the one"), (7, "someone")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == {(1, 1, 0), (3, 3, 0), (4, 3, 1), (5, 4, 2), (6, 2, 0)}
    assert decontaminate.budget(4) == 0 and decontaminate.budget(5) == 1 and decontaminate.budget(10) == 2


def test_leaks_awkward(spark, awkward):
    items = spark.createDataFrame([(1, "two one two one two one"), (None, "no such words here")], "item_id long, text string")
    assert {r["doc_id"] for r in rows_of(decontaminate.contaminated(awkward, items))} == {15}
    assert decontaminate.clean(awkward, items).columns == awkward.columns
    assert decontaminate.clean(awkward, items).count() == awkward.count() - 1
    assert decontaminate.contaminated(awkward.limit(0), items).count() == 0 and decontaminate.contaminated(awkward, items.limit(0)).count() == 0


# languages


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_languages(spark, sf).join(docs, "doc_id")
    own = [r for r in got.collect() if r.held_out]
    assert 150 < len(own) < 350
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())
    assert sum(r.lang_pred == r.lang for r in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 for r in own)


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_spans(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 500 and 900").collect()
    one = {r.lang: r.text for r in rows}
    mixed = one["de"] + "\n" + one["en"]
    langs, scores, spans = language.label(model, [mixed, one["fr"]])
    assert {s[2] for s in spans[0]} == {"de", "en"} and langs[1] == "fr"
    turn = next(s for s in spans[0] if s[2] == "en")[0]
    assert abs(turn - len(one["de"])) < 60


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(6)
    scores = [np.log(rng.dirichlet(np.ones(3), n)).astype(np.float32) for n in (1, 2, 5, 40, 41, 300, 0)]
    for penalty in (0.5, 2.0, 6.0):
        for s, path in zip(scores, language.viterbi(scores, penalty), strict=True):
            if not len(s):
                continue
            value = s[0].astype(float)
            for row in s[1:]:
                value = np.maximum(value, value.max() - penalty) + row
            own = s[np.arange(len(s)), path].sum(dtype=float) - penalty * (np.diff(path) != 0).sum()
            assert own == pytest.approx(value.max(), abs=1e-3)


def test_scripts_narrow(spark):
    docs = spark.createDataFrame([(1, "добрый день всем", "ru"), (2, "good day to all", "en"), (3, "guten tag", "de")], "doc_id long, text string, lang string")
    m = language.fit(docs)
    langs, _, _ = language.label(m, ["привет", "12 34 ?", "day", "中文"])
    assert langs[0] == "ru" and langs[1] == "und" and langs[2] == "en" and langs[3] in m.langs


def test_languages_awkward(spark, awkward, model):
    got = language.identify(awkward, model, ["doc_id"])
    assert got.count() == awkward.count()
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (4, 5, 6, 17))
    assert language.identify(awkward.limit(0), model, ["doc_id"]).count() == 0
    nothing = language.fit(awkward.limit(0))
    assert {r.lang_pred for r in language.identify(awkward, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.known_language(awkward, model).columns == awkward.columns


# mixture


def check_mixture(rows, texts):
    sizes = {}
    for s, t in texts:
        sizes[s] = sizes.get(s, 0) + len(plain.words(t))
    want = plain.targets(sizes)
    taken = {}
    for r in rows:
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    return taken, want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    sources = {r.doc_id: r.source for r in docs.collect()}
    rows = [r | {"source": sources[r["doc_id"]]} for r in rows_of(mixing.mix(docs))]
    taken, want = check_mixture(rows, [(r.source, r.text) for r in docs.collect()])
    for s in want:
        assert abs(taken[s] - want[s]) <= (0.005 if sf.endswith("0.01") else 0.03) * want[s], (s, taken[s], want[s])
    again = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix(docs.repartition(5)))}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixture_rates_solve_the_dual(spark):
    sizes = {"a": [10, 20, 30, 400], "b": [5, 50, 500], "c": [7] * 9}
    docs = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, own in sizes.items() for n in own)]
    rows = rows_of(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")))
    for s, own in sizes.items():
        mine = [r for r in rows if docs[r["doc_id"]][2] == s]
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(mine[0]["target"], rel=1e-6)
        # below the cap the logarithm of the rate follows the size
        slopes = {round(math.log(r["rate"]) / r["size"], 6) for r in mine if r["rate"] < 2}
        assert len(slopes) <= 1


def test_mixture_splits_cells(spark):
    docs = [(i, "w w w" if i % 2 else "w " * (i % 50), "one" if i % 3 else "two") for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = [r | {"source": docs[r["doc_id"]][2]} for r in rows_of(mixing.mix(frame, cell=10))]
    taken, want = check_mixture(rows, [(s, t) for _, t, s in docs])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)


def test_mixture_awkward(spark, awkward):
    got = mixing.mix(awkward)
    assert got.count() == awkward.count() and got.columns[0] == "doc_id"
    rows = mixing.repeated(awkward)
    assert rows.columns == awkward.columns
    assert rows.count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mix(awkward.limit(0)).count() == 0 and mixing.repeated(awkward.limit(0)).count() == 0


# near copies


def same_components(df, docs, least=90):
    want = plain.components(docs, least)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(df)}
    assert got == want


def test_near_copies(spark, small, small_rows):
    same_components(jaccard.link_documents(small), small_rows)


@pytest.mark.parametrize("block", [256, 4])
def test_near_copies_edges(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(7)
    docs = []
    for group in range(6):
        base = sentence(rng, 40 + 25 * group, 5000).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs) * 37 % 1009, " ".join(own)))
    # a chain of which each links to the next only
    chain = sentence(rng, 60, 10**6).split()
    for i in range(30):
        docs.append((2000 + i * 11 % 331, " ".join(chain[i : i + 45])))
    docs += [(5000 + i, t) for i, t in enumerate(["", None, "a", "A", "a b", "a b c", "A B C", "a b c d", " ".join("abcdefghijk"), " ".join("abcdefghijkl"), " ".join("abcdefghijklm")])]
    same_components(jaccard.link_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), docs)


def test_near_copies_other_threshold(spark):
    rng = random.Random(8)
    base = sentence(rng, 100, 5000).split()
    docs = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(25)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    same_components(jaccard.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), least=60), docs, 60)


@pytest.mark.parametrize("k,least,block", [(3, 90, 512), (5, 80, 4), (3, 40, 512)])
def test_near_copies_all_pairs(spark, k, least, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(11)
    docs = []
    for group in range(3):
        base = sentence(rng, 60 + 40 * group, 5000).split()
        for i in range(12):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own + own[: 10 * i] * (i > 9) + [f"t{group}x{j}" for j in range(8 * i)])))
    docs += [(100, docs[0][1]), (101, docs[0][1].upper()), (102, ""), (103, None), (104, "a b"), (105, "A  b"), (106, "alone in the world")]
    held = {d: plain.shingles(t, k) for d, t in docs}
    links = lambda a, b: bool(held[a]) and 100 * len(held[a] & held[b]) >= least * len(held[a] | held[b])
    want = {(a, b) for a in held for b in held if a < b and links(a, b)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows, pairs = (x.collect() for x in jaccard.join_pairs(frame, k, least))
    by: dict = {}
    for r in rows:
        if r.n:
            by.setdefault(r.name, []).append(r.doc_id)
    got = [tuple(sorted((a, b))) for p in pairs for a in by[p.a] for b in by[p.b]] + [(a, b) for own in by.values() for a in own for b in own if a < b]
    assert len(got) == len(set(got)) and set(got) == want
    for p in pairs:
        a, b = held[by[p.a][0]], held[by[p.b][0]]
        assert (p.both, p.either) == (len(a & b), len(a | b))
    counts = {r.doc_id: (r.n_shingles, r.n_links) for r in jaccard.count_links(frame, k, least).collect()}
    assert counts == {d: (len(s), sum(d in p for p in want)) for d, s in held.items()}


def test_near_copies_awkward(spark, awkward):
    got = rows_of(jaccard.link_documents(awkward))
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[3]["component_id"] == by[7]["component_id"] == 1
    assert by[9]["component_id"] == by[10]["component_id"] == 9
    assert by[4]["component_id"] == 4 and by[5]["component_id"] == 5
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 8, 9, *range(11, 19)]
    assert kept.filter("doc_id is null").count() == 2
    assert jaccard.link_documents(awkward.limit(0)).count() == 0 and jaccard.one_of_each(awkward.limit(0)).count() == 0


# token files


def check_tokens(got, docs, path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    at = 0
    for r, (d, text) in zip(got, docs, strict=True):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), crc)
        at += len(ids)


def test_token_files(spark, sf, small_rows):
    got = sorted(rows_of(queries.op9_token_ids(spark, sf)), key=lambda r: r["doc_id"])
    check_tokens(got, sorted(small_rows), queries.word_tokenizer())


def test_token_files_read_back(spark, small, awkward):
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(small.repartition(3), path, queries.word_tokenizer())
    part = tokens.read_tokens(spark, path, ids=[3, 5])
    assert sorted(r.doc_id for r in part.collect()) == [3, 5]
    assert "PushedFilters: [In(doc_id" in part._jdf.queryExecution().toString()
    assert tokens.read_tokens(spark, path, low=10, high=19).count() == 10
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(awkward, path, queries.word_tokenizer())
    got = sorted(rows_of(tokens.token_digests(spark, path)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r.doc_id for r in awkward.collect()], key=lambda d: (d is not None, d or 0))
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(awkward.limit(0), path, queries.word_tokenizer())
    assert tokens.token_digests(spark, path).count() == 0


def test_words_are_encoded_as_in_the_text():
    from tokenizers import Tokenizer

    path = queries.word_tokenizer()
    texts = ["", " a.b, c.,d ., e. f 1.2. x,\n'S it's IT'S. Á. İİ <|endoftext|>. <|ENDOFTEXT|> <|startoftext|>A.", "\x1cA.\x1c b   c,", "é. É, ß. 5. ５. x.'s y.'S", "A\u0301. I\u0307, \u212a."]
    coder, whole = tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    parts = ["a", "Word", "don't", "1", "23", ".", ",", " ", "  ", "\n", "\t", "\x0b", "é", "e\u0301", "İ", "ß", "中文", "🎈", "<|", "|>", "\u00a0", "\u2003", "'S", "_", "x" * 40, "\x00", "\u0307", "ſ"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(5000)]
    assert not coder.whole
    for _ in range(2):  # with words that are new and words that are known
        ids, sizes = coder.encode(texts)
        want = [c.ids for c in whole.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_forgotten_words(monkeypatch, small_rows):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 500)
    coder = tokens.Encoder(queries.word_tokenizer())
    for _, text in small_rows[:60]:
        assert coder.encode([text or ""])[0].tolist() == coder._ids(text or "")
    assert len(coder.old.h) and len(coder.young.h) + len(coder.new.h) < 20_000


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.whole
    ids, sizes = coder.encode(["Hello  there", "", "x.\n y"])
    assert sizes.tolist() == [len(coder._ids(t)) for t in ("Hello  there", "", "x.\n y")] and len(ids) == sum(sizes)


def test_units_of_equal_hashes(monkeypatch):
    """If hashes of two words clash, every unit stands for itself."""
    monkeypatch.setattr(tokens, "run_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    units = tokens.Units([b"ab cd ab", b"", b"x."])
    assert units.words(np.arange(5)) == [b"ab", b"cd", b"ab", b"x", b"."] and units.first.tolist() == [0, 3, 3, 5]
    coder = tokens.Encoder(queries.word_tokenizer())
    assert coder.encode(["ab cd abc", "cd"])[0].tolist() == coder._ids("ab cd abc cd")


# fingerprints


def check_edited(got, docs):
    order = sorted(docs, key=lambda r: -r[0])
    following = {d: order[(i + 1) % len(order)][1] or "" for i, (d, _) in enumerate(order)}
    for r in got:
        text = dict(docs)[r["doc_id"]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[r["doc_id"]][:third]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == plain.sha(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]


def test_fingerprints_against_plain(spark, small_rows):
    """Whole columns next to a plain Order MinHash."""
    rng = random.Random(14)
    docs = [(d, t) for d, t in small_rows if d % 4 == 0]
    docs += [(5000 + i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(6000, None), (6001, ""), (6002, " \t"), (6003, "one"), (6004, "one two"), (6005, "x " * 3000), (6006, "é中文 🎈\u00a0y \x1c z")]
    got = {r["doc_id"]: r for r in rows_of(fingerprints.compare_edited(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))}
    order = sorted(docs, key=lambda r: -r[0])
    told = lambda entries: "".join(f"{e:010x}" for e in entries)
    for i, (d, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        own, edited, other = (plain.order_minhash(t) for t in (text, text[: len(text) - third] + following[:third], following))
        r = got[d]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (told(own), told(edited)), d
        assert r["near_edited"] == pytest.approx(plain.likeness(own, edited)) and r["near_next"] == pytest.approx(plain.likeness(own, other))


def test_fingerprints(spark, small, small_rows):
    got = rows_of(fingerprints.compare_edited(small))
    assert len(got) == len(small_rows)
    check_edited(got, small_rows)
    full = [r for r in got if r["n_chars"] > 600]
    assert np.mean([r["near_edited"] for r in full]) > 0.2 > 0.05 > np.mean([r["near_next"] for r in full])
    by = {}
    for r in got:
        by.setdefault(dict(small_rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())


def test_fingerprints_follow_order_and_edits(spark):
    rng = random.Random(9)
    text = sentence(rng, 600, 10**6).split()
    edit = lambda n: " ".join("new" if i % (600 // n) == 7 else w for i, w in enumerate(text))
    shuffled = [" ".join(text[i : i + 20]) for i in range(0, 600, 20)]
    rng.shuffle(shuffled)
    texts = [" ".join(text), edit(4), edit(20), " ".join(shuffled), "  ".join(text), "a b a b a b", "a b a b", "", "a"]
    rows = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text", "print").orderBy("i").collect()
    sets = [set(r.print) for r in rows]
    like = lambda a, b: len(sets[a] & sets[b]) / max(len({e >> 32 for e in sets[a] | sets[b]}), 1)
    assert like(0, 4) == 1 and like(0, 1) > like(0, 2) > 0.5 and like(0, 3) < like(0, 1)
    assert sets[5] != sets[6] and not sets[7] and len(sets[8]) == 1 and len(sets[0]) == 64


def test_fingerprints_awkward(spark, awkward):
    got = rows_of(fingerprints.compare_edited(awkward))
    assert len(got) == awkward.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] in (4, 5, 6)} == {""}
    assert fingerprints.compare_edited(awkward.limit(0)).count() == 0
    alone = rows_of(fingerprints.compare_edited(awkward.filter("doc_id = 7")))
    assert alone[0]["near_next"] == 1


def test_signs_at_word_ends_are_units():
    units = tokens.Units(["done!! done??, (done... qué*** done it' a|> 7). --".encode()])
    words = set(units.words(np.arange(len(units.some))))
    assert words == {b"done", b"!!", b"??,", b"(done", b"...", "qué".encode(), b"***", b"it'", b"a|>", b"7", b").", b"--"}


def test_words_of_one_piece_reach_the_model_together(monkeypatch):
    from tokenizers import Tokenizer

    coder, whole = tokens.Encoder(queries.word_tokenizer()), Tokenizer.from_file(queries.word_tokenizer())
    assert coder.pieces is not None and not coder.whole
    monkeypatch.setattr(tokens, "AT_ONCE", 3)
    texts = ["plain words été 中文 ß dje и é İx QuÉ!!", "é̸? ≠ a.b $$$", ""]
    want = [c.ids for c in whole.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = coder.encode(texts)
    assert [len(w) for w in want] == sizes.tolist() and ids.tolist() == sum(want, [])
    coder = tokens.Encoder(queries.word_tokenizer())
    coder.pieces = None  # a model that does not mark ends
    assert coder.encode(texts)[0].tolist() == sum(want, [])


def test_portions_of_text_are_bounded():
    import pyarrow as pa

    from fairtender.llm.words import text_portions

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 40, None, "b" * 70, "", "c" * 90, "d"])], names=["k", "text"])
    got = list(text_portions([batch.slice(1), batch.slice(0, 0)], "text", 50))
    assert [b.column("k").to_pylist() for b in got] == [[1], [2, 3], [4, 5]]
