"""Memory of Python workers does not follow the size of an Arrow batch or of the tables met before."""

import tracemalloc

import numpy as np
import pyarrow as pa
from fairtender.llm import language, queries, staging, tokens, words
from fairtender.llm.staging import keep
from pyspark.sql import functions as F


def test_batches_are_labelled_in_portions(monkeypatch):
    seen = []
    monkeypatch.setattr(language, "CHARS", 100)
    monkeypatch.setattr(language, "label", lambda model, texts, *a: (seen.append(sum(map(len, texts))), (["en"] * len(texts), np.ones(len(texts)), [[]] * len(texts)))[1])

    class Rows:
        schema = None

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.RecordBatch.from_arrays([pa.array(["x" * 40] * 50)], names=["text"])])))

    kept = language.known_language(Rows(), None)
    assert sum(map(len, kept)) == 50 and max(seen) <= 140


def test_an_encoder_remembers_a_bounded_number_of_words():
    coder = tokens.Encoder(queries.word_tokenizer())
    rng = np.random.default_rng(5)
    for _ in range(10):
        letters = rng.integers(97, 123, (200_000, 7), dtype=np.uint8)
        letters[:, 6] = 32
        coder.encode([letters.tobytes()])
        held = [coder.new, coder.young, coder.old]
        assert sum(len(t.h) for t in held) <= 1_400_000


def _peak(run) -> float:
    """MB that ``run`` holds at most, as numpy and Python allocate it."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_hashing_and_labelling_hold_little_at_once():
    """Two workers' tables and arrays, beside the Java heap, are what an executor's memory must hold."""
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, 2_000_000, dtype=np.uint8)
    letters[6::7] = 32
    texts = [letters[a : a + 2000].tobytes().decode() for a in range(0, len(letters), 2000)]
    scores = np.log(rng.random((language.BUCKETS, 12)).astype(np.float32))
    model = language.Model([f"l{i:02}" for i in range(12)], scores, scores, np.ones((256, 12), bool))
    language._tables.clear()
    words._powers.clear()
    assert _peak(lambda: language._table("letter")) < 30
    assert _peak(lambda: words.run_hashes(letters, *words.word_bounds(np.append(letters, np.uint8(32))))) < 45
    assert _peak(lambda: language.label(model, texts[:500], 0.0)) < 100


def test_tables_for_a_very_long_word_are_not_kept():
    words._powers.clear()
    long = words.scan(["x" * 3_000_000 + " y"])
    assert long.hash[1] == words.scan(["y"]).hash[0] and long.hash[0] == words.scan(["X" * 3_000_000], lower=True).hash[0]
    assert all(len(t) <= words.BLOCK + (1 << 16) for t in words._powers.get(0, ()))


def test_what_goes_to_a_worker_at_once_is_bounded_by_bytes(spark):
    """Packed sets are wide rows; 10,000 of them at once took much of an executor's memory."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows * 8000])], names=["size"])

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 8000).cast("binary").alias("grams"))
    before = spark.conf.get(staging.BATCH)
    most = keep(rows.mapInArrow(sizes, "size long")).agg(F.max("size")).first()[0]
    assert most <= 5 << 20 and spark.conf.get(staging.BATCH) == before
