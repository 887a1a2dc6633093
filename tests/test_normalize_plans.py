"""Issues of normalized records are listed without making the records' fields again in a filter."""

from pyspark.sql import functions as F

from chainspark.operators import normalize as N


def records(spark):
    raw = ['{"event_type": "process_create", "Host": "", "Computer": "A", "hostname": "b", "src": "%s", "time": 1704067200}' % ("9" * 70), '{"type": "netflow", "dport": "70000", "pid": -4, "time": "1704067200"}', "7", '{"metadata": {"a": 1}, "image": "x.exe"}']
    return spark.createDataFrame(list(enumerate(raw)), "idx long, raw string")


def test_issue_rows_filter_no_field_of_the_record(spark):
    """A filter by the issues below the generator held every field's expression again, and grew with their number."""
    listed = N.issue_rows(N.normalize(records(spark)))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Generate", 1)[1]
    assert not any(line.lstrip(" :+-").startswith("Filter") for line in below.splitlines())
    got = [tuple(r) for r in listed.select("idx", "field").orderBy("idx", "field").collect()]
    assert got == [(0, "source_ip"), (1, "destination_port"), (1, "identity"), (1, "process_id"), (1, "timestamp"), (2, "record"), (3, "event_type"), (3, "identity"), (3, "timestamp")]


def test_first_name_with_a_value_in_the_records_order_counts(spark):
    out = {r.idx: r for r in N.normalize(records(spark)).select("idx", "host", "sec", "metadata", F.size("issues").alias("n")).collect()}
    assert (out[0].host, out[0].sec, out[1].sec, out[3].metadata) == ("a", 1704067200, None, {"a": "1"})


def test_first_issues_normalize_the_records_once(spark):
    """A page and the number of its rows are two readings; the records must not be normalized in each."""
    from chainspark.plans import ingest_queries

    page = ingest_queries.first_issues(spark, "/root/testdata/sf0.001")
    assert "from_json" not in page._jdf.queryExecution().optimizedPlan().toString() and page.count() == 100
