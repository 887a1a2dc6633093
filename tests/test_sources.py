"""Scans of files: identity and order of records, dialects of CSV, files cut into many splits."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from chainspark.operators import normalize, rules
from chainspark.sinks import tables
from chainspark.sources import adapters, csv_files, records


@pytest.fixture
def tiny_splits(spark):
    """Splits of 200 bytes, so that small files are cut as large ones are."""
    conf = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def write(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8", newline="")
    return str(folder)


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.idx):
        out.setdefault(r.file.rsplit("/", 1)[-1], []).append(json.loads(r.raw))
    return out


def messages(issues):
    return {(r.file.rsplit("/", 1)[-1], r.message) for r in issues.collect()}


FAILED = {"time": "2024-05-01T10:00:00Z", "action": "failed_logon", "host": "ws1", "user": "bob", "src_ip": "10.0.0.9"}


def test_equal_records_keep_apart_ids(spark, tmp_path):
    """Six equal failures in two files are six events, the same ones at every scan, and enough for the rule."""
    lines = (json.dumps(FAILED) + "\n") * 3
    path = write(tmp_path, a__jsonl=lines, b__jsonl=lines)
    ids = [sorted(r.event_id for r in normalize.normalize(records.scan_json_lines(spark, path)[0]).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 6
    stored = spark.createDataFrame([], "event_id string, idx long")
    events = normalize.normalize(records.scan_json_lines(spark, path)[0])
    table, counts = tables.add_events(stored, events.select("event_id", "idx"))
    assert table.count() == 6 and counts.first().duplicates == 0
    assert {r.rule_id for r in rules.detect(events).collect()} >= {"AUTH_BRUTE_FORCE"}
    (tmp_path / "arrays").mkdir()
    arrays = write(tmp_path / "arrays", a__json=json.dumps([FAILED, FAILED]), b__json=json.dumps({"events": [FAILED, FAILED]}))
    rows = normalize.normalize(records.scan_json(spark, arrays)[0]).collect()
    assert len({r.event_id for r in rows}) == len({r.idx for r in rows}) == 4


def test_lines_are_numbered_as_they_stand(tiny_splits, tmp_path):
    spark = tiny_splits
    texts = {f"f{k}__jsonl": "".join(json.dumps({"k": k, "n": i}) + ("\n\n" if i % 7 == 0 else "\n") for i in range(60)) for k in range(3)}
    found, issues = records.scan_json_lines(spark, write(tmp_path, **texts, g__jsonl="not json\n{}\n"))
    rows = sorted(found.collect(), key=lambda r: r.idx)
    assert [(json.loads(r.raw).get("k"), json.loads(r.raw).get("n")) for r in rows[:-1]] == [(k, i) for k in range(3) for i in range(60)]
    assert all(r.idx - r.line == rows[0].idx + 69 * k for k in range(3) for r in rows[60 * k : 60 * k + 60])
    assert messages(issues) == {("g.jsonl", "line is no JSON object")}
    kept, over = normalize.capped_batch(found, 100)
    assert sorted(r.idx for r in kept.collect()) == [r.idx for r in rows[:100]] and over.first().received == 181
    kept, over = normalize.capped_batch(found, 181)
    assert kept.count() == 181 and over.count() == 0


def python_rows(text):
    separator = max(csv_files.SEPARATORS, key=text.lstrip("﻿").split("\n", 1)[0].count)
    reader = csv.DictReader(io.StringIO(text.lstrip("﻿"), newline=""), delimiter=separator)
    rows = [{k.strip(): v for k, v in row.items() if k and k.strip() and (v or "").strip()} for row in reader]
    return [r for r in rows if r]


ODD_CSV = {
    "plain__csv": "host,user,time\nH1,U1,2024-05-01\nH2,,2024-05-02\n,,\n\nH3,U3\n",
    "mixed__csv": "time,host\n2024-05-01,A\n2024-05-02,B,extra\n",
    "semi__csv": "host;user;note\nh;u;\"a;b\"\n",
    "tabs__csv": "host\tuser\r\nh1\tu1\r\nh2\tu2\r\n",
    "bom__csv": "﻿host , user\nh,u\n",
    "breaks__csv": 'host,note\nh1,"line one\nline two, and\n\n""quoted"" end"\nh2,"x"\nh3,5" disk\nh4,"a\nb"\n',
    "twice__csv": "a,b,a\n1,2,3\n",
    "headbreak__csv": '"ho\nst",user\nh,"u\nv"\n',
}


def test_csv_dialects(spark, tmp_path):
    path = write(tmp_path, **ODD_CSV, blank__csv=" \n \n", header__csv="host,user\n", late__csv="\nhost,user\nh,u\n")
    found, issues = csv_files.scan_csv(spark, path)
    assert by_file(found.collect()) == {k.replace("__", "."): python_rows(v) for k, v in ODD_CSV.items()}
    assert messages(issues) == {("blank.csv", "empty CSV content"), ("header.csv", "CSV contains no data rows"), ("late.csv", "CSV has no header row")}
    ids = [r.event_id for r in normalize.normalize(found).collect()]
    assert len(ids) == len(set(ids))


def test_no_csv_with_content(spark, tmp_path):
    with pytest.raises(ValueError):
        csv_files.scan_csv(spark, write(tmp_path, empty__csv=""))


def odd_csv(seed):
    rng = random.Random(seed)
    out = io.StringIO()
    separator = rng.choice(csv_files.SEPARATORS)
    writer = csv.writer(out, delimiter=separator, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerow(["alpha", "beta", "gamma"])
    for i in range(rng.randrange(1, 60)):
        writer.writerow([f"{i}", "".join(rng.choice(["a", "\n", '"', '""', separator, " ", "é"]) for _ in range(rng.randrange(0, 30))), rng.choice(["", "z", "w\nw"])])
    return out.getvalue()


def test_quoted_breaks_over_splits(tiny_splits, tmp_path):
    texts = {f"r{k:02}__csv": odd_csv(k) for k in range(12)}
    found, _ = csv_files.scan_csv(tiny_splits, write(tmp_path, **texts))
    got = by_file(found.collect())
    assert got == {k.replace("__", "."): python_rows(v) for k, v in texts.items()}


def test_a_field_that_never_ends_is_an_issue(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_files, "RECORD_LINES", 20)
    text = 'a,b\n1,2\n3,"open\n' + "x,y\n" * 50
    found, issues = csv_files.scan_csv(spark, write(tmp_path, a__csv=text))
    assert [json.loads(r.raw) for r in found.collect()] == [{"a": "1", "b": "2"}]
    assert messages(issues) == {("a.csv", "quoted field does not end")}


def test_splunk_blocks_over_splits(tiny_splits, tmp_path):
    block = "05/01/2024 10:{:02}:00 AM\nLogName=Security\nEventCode=4625\nComputerName=H{}\nMessage=First.\n\tAccount Name:\t\tU{}\n\n    Source Address: 10.0.0.{}\n"
    path = write(tmp_path, a__log="noise\n" + "".join(block.format(i, i, i, i) for i in range(40)), b__log=block.format(1, 99, 99, 99) + "05/01/2024 11:00:00 AM\n")
    found, issues = adapters.load_splunk(tiny_splits, path)
    rows = sorted(normalize.normalize(found).collect(), key=lambda r: r.idx)
    assert [(r.host, r.user, r.source_ip, r.event_type) for r in rows] == [(f"h{i}", f"u{i}", f"10.0.0.{i}", "LOGIN_ATTEMPT") for i in [*range(40), 99]]
    assert messages(issues) == {("b.log", "block has no fields")}


def test_exports_keep_the_order_of_scanned_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = write(tmp_path / "in", a__jsonl="".join(json.dumps({"z": i, **({"late": 1} if i == 9 else {}), "b": 2}) + "\n" for i in range(10)))
    found, _ = records.scan_json_lines(spark, path)
    assert tables.union_of_keys(found) == ["z", "b", "late"]
    tables.export_json(found, str(tmp_path / "out"), 4)
    back, _ = records.scan_json(spark, str(tmp_path / "out"))
    assert [json.loads(r.raw)["z"] for r in back.orderBy("idx").collect()] == list(range(10))
    assert back.select(F.countDistinct("file")).first()[0] == 3


def odd_array(seed):
    rng = random.Random(seed)
    words = ["plain", "a}b", "{x", "[", "]", 'quo"te', "back\\\\slash\\\\", "é", "", "line\nbreak", "},{"]
    value = lambda d: rng.choice([rng.choice(words), rng.randrange(99), None, True, [rng.choice(words), {"k": rng.choice(words)}] if d else 1, {"n": rng.choice(words), "m": [1, {"o": "}"}]} if d else "z"])
    return [rng.choice([{f"f{i}": value(1) for i in range(rng.randrange(0, 4))}, "bare", 7, [1, {"in": "list"}]]) if rng.random() < 0.3 else {"id": i, "t": value(1)} for i in range(rng.randrange(0, 80))]


def test_large_arrays_are_cut_where_their_splits_lie(tiny_splits, tmp_path):
    arrays = {f"a{k:02}__json": odd_array(k) for k in range(14)}
    texts = {k: ("﻿" if i == 3 else "") + json.dumps(v, indent=rng_indent, ensure_ascii=False) for i, (k, v) in enumerate(arrays.items()) for rng_indent in [(None, 1)[i % 2]]}
    path = write(tmp_path, **texts)
    whole, none = records.scan_json(tiny_splits, path)
    cut_up, bad = records.scan_json(tiny_splits, path, whole=0)
    key = lambda df: sorted((r.file, r.line, r.idx, json.dumps(json.loads(r.raw))) for r in df.collect())
    got = key(cut_up)
    assert got == key(whole) and bad.count() == none.count() == 0
    assert [json.loads(r[3]) for r in got] == [x for v in arrays.values() for x in v]


def test_times_without_a_zone_are_utc(spark):
    rows = [("2024-05-01T10:00:00",), ("2024-05-01 12:00:00+02:00",), ("2024-05-01T10:00:00Z",), ("2024/05/01 10:00:00",), ("01/05/2024 10:00:00",), ("05/13/2024 10:00:00",), ("31/31/2024 10:00:00",)]
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        raw = spark.createDataFrame(rows, "t string").select(F.monotonically_increasing_id().alias("idx"), F.to_json(F.struct(F.col("t").alias("time"), F.lit("dns").alias("type"))).alias("raw"))
        got = [r.sec for r in normalize.normalize(raw).orderBy("idx").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == [1714557600] * 5 + [1715594400, None]
