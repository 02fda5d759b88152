"""Learned operators: held-out accuracy and the defined cases."""

import pytest
from pyspark.sql import functions as F

from attesta.llm import language_id, toxicity


@pytest.fixture(scope="module")
def spoken(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_id(spark, spoken, documents, empty):
    model = language_id.learn(spoken)
    got = language_id.identify(spoken, model).join(spoken.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(documents, model).collect()}
    assert odd[400] == odd[401] == odd[402] == odd[409] == ("und", 0.0)
    assert odd[403][0] != "und" and 0 < odd[403][1] <= 1
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents, language_id.learn(empty)).collect()} == {"und"}


def test_language_id_keeps_clean_rows(spoken, documents):
    kept = language_id.keep_identified(spoken, language_id.learn(spoken))
    assert kept.columns == spoken.columns and kept.count() == spoken.count()
    kept = language_id.keep_identified(documents, language_id.learn(spoken), min_score=0.0)
    assert kept.where("doc_id in (400, 401, 402, 409)").count() == 0
    assert kept.where("doc_id = 410 and lang is not null").count() == 2


def test_hierarchy():
    assert language_id.family_of("en") == language_id.family_of("de-AT") != language_id.family_of("fr")
    texts, langs = ["aa ab aa", "ba bb bb", "cc cd"] * 6, ["en", "de", "zz"] * 6
    import pyarrow as pa

    model = language_id.fit(texts, langs)
    assert list(model["pairs"]) == [(0, 1)]  # only languages of one family meet
    assert language_id.classify(model, pa.array(texts))[0] == langs


def test_toxicity(spark, documents, empty):
    bad = "frag vile"
    docs = documents.unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words about number "), F.col("id"), F.when(F.col("id") % 4 == 0, f" {bad}ness").otherwise(" good")).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).alias("n")))
    labels = spark.range(1000, 1400).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic")).union(spark.createDataFrame([(1001, None), (1002, 7), (999_999, 1)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, labels).cache()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    held = got.where("held_out and doc_id >= 1000").withColumn("y", (F.col("doc_id") % 4 == 0).cast("int"))
    assert held.count() > 50 and held.where("y <> predicted").count() == 0
    empties = {r.doc_id: r.score for r in got.where("doc_id in (400, 401, 402)").collect()}
    assert len(set(empties.values())) == 1
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(documents, labels.where("toxic = 0")).select("score").distinct().collect()}.pop() < 0.01


def test_toxicity_on_generated_documents(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    held = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("toxic", "score", "predicted").collect()
    bad, good = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    # always answering 0 has an area of 0.5 and finds nothing
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    hit = sum(r.toxic == 1 == r.predicted for r in held)
    f1 = 2 * hit / (len(bad) + sum(r.predicted for r in held))
    assert area > 0.75 and f1 > 0.6, (area, f1)


def test_many_rows_of_one_id(spark, spoken):
    copies = spoken.where("doc_id = 1").crossJoin(spark.range(500)).drop("id").unionByName(spoken.withColumn("doc_id", F.lit(None).cast("long")).limit(50)).unionByName(spoken)
    assert set(language_id.learn(copies, max_rows=40)["names"]) == set(language_id.learn(spoken)["names"])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(copies, labels, max_chars=10_000).count() == copies.count()


def test_bounds_of_learning(spark, spoken):
    few = language_id.learn(spoken, per_language=3, max_chars=100_000)
    got = language_id.identify(spoken, few).join(spoken.select("doc_id", "lang"), "doc_id").where("held_out")
    # a flat guess of the most frequent language is right for its share alone
    share = spoken.groupBy("lang").count().agg(F.max("count")).first()[0] / spoken.count()
    assert got.where("lang = lang_pred").count() > (share + 0.1) * got.count()
