"""Rows without an id pass a filter, or fall, by what they hold."""

from pyspark.sql import functions as F

from chainspark.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_leaked_rows_without_an_id_fall(spark):
    item = " ".join(f"word{i}" for i in range(40))
    rows = [(None, f"before it {item} after it"), (None, "clean words of no item at all"), (None, None), (1, item), (2, "clean too"), (None, f"before it {item} after it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("of_id", F.lit("x"))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.drop_leaked(docs, bench)
    assert got.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, [rows[1], rows[2], rows[4]]))


def test_rejected_rows_without_an_id_fall(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    models = quality.train(docs, labels)
    monkeypatch.setattr(quality, "train", lambda *_: models)
    rejected = {r.doc_id for r in quality.classify(docs, labels).where("not keep").collect()}
    assert rejected
    mixed = docs.withColumn("was", F.col("doc_id")).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    kept = quality.keep_good(mixed, labels)
    assert kept.columns == mixed.columns
    assert {r.was for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
