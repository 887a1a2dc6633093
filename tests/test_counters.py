"""Counts made by the pass that writes a table, and several counts of one table in one pass."""

from pyspark.sql import functions as F

from chainspark.operators import views
from chainspark.sinks.store import Store


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_written_tables(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "in"))
    built = []

    def make(rows):
        def one():
            built.append(rows)
            return spark.range(rows).where("id >= 0")

        return one

    for _ in range(2):
        store.table("some", make(7))
        store.table("none", make(0))
    assert built == [7, 0]
    got = store.rows("some", "none")
    assert [tuple(r) for r in got.collect()] == [("some", 7), ("none", 0)]
    assert "FileScan" not in plan_of(got)


def test_conditions_and_values_in_one_pass(spark, tmp_path):
    rows = [("a", "x"), ("a", None), (None, "x"), (None, None), ("a", "x")]
    spark.createDataFrame(rows, "p string, q string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    told = views.tally(df, every=F.lit(True), p=F.col("p").isNotNull(), both=F.col("p").isNotNull() & F.col("q").isNotNull(), never=F.col("p") == "z")
    seen = views.by_value(df, "what", p="p", q="q")
    assert plan_of(told).count("FileScan") == plan_of(seen).count("FileScan") == 1
    assert {r.name: r.n for r in told.collect()} == {"every": 5, "p": 3, "both": 2, "never": 0}
    assert {(r.what, r.name): r.n for r in seen.collect()} == {("p", "a"): 3, ("p", None): 2, ("q", "x"): 3, ("q", None): 2}
    none = df.where("p = 'z'")
    assert {r.n for r in views.tally(none, every=F.lit(True)).collect()} == {0}
    assert views.by_value(none, "what", p="p").count() == 0
