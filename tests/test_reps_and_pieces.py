"""Settings of the source hold in the registered queries."""

from pyspark.sql import functions as F

from fairtender.checks import models, texts
from fairtender.plans import estimates as es
from fairtender.plans import training


def test_price_models_run_with_all_replicates(monkeypatch):
    seen = []
    monkeypatch.setattr(models, "saved_prices", lambda spark, sf: "prices")
    monkeypatch.setattr(es, "price_models", lambda sample, reps=es.REPS: seen.append((sample, reps)))
    models.price_models(None, "")
    assert seen == [("prices", 300)]


def test_training_texts_stay_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    middle = [r.doc_id for r in docs.filter(words.between(700, 1600)).select("doc_id").collect()]
    assert middle
    whole = texts.training.normalise_text(texts.training.clean_text(F.col("text")))
    want = {r.doc_id: r.y for r in docs.filter(F.col("doc_id").isin(middle)).select("doc_id", F.concat(whole, F.lit("---->")).alias("y")).collect()}
    got = {r.doc_id: r.prompt for r in texts._examples(spark, sf).filter(F.col("doc_id").isin(middle)).select("doc_id", "prompt").collect()}
    assert got == want


def test_training_texts_are_cut_at_small_n(spark):
    text = " ".join(f"w{i}" for i in range(50))
    made = training.training_examples(spark.createDataFrame([(1, text, "2")], "doc_id long, text string, price string"), ["price"], n=10).first()
    assert made.prompt.split("---->")[0].split() == [f"w{i}" for i in [*range(10), *range(40, 50)]]
