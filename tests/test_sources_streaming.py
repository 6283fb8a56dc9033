"""Readers, sinks and streams on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from hullscope.schemas import REPORT
from hullscope.sources import readers, sinks
from hullscope.streaming import events as ev


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image": "nginx:1.12", "weight": 2}\n# note\n\n{"repository_namespace": "bitnami", "repository_name": "redis", "tag_name": "6.0", "weights": 1}\n{"repository_name": "alpine"}\n')
    assert {(r.image, r.weight) for r in readers.checked_lines(spark, str(tmp_path / "a.jsonl")).collect()} == {("nginx:1.12", 2.0), ("bitnami/redis:6.0", 1.0), ("alpine:latest", 0.0)}
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="not JSON"):
        readers.checked_lines(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "c.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "c.jsonl"), "a int", bad="fail").collect()


def test_delimited(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("ns\tname\ttag\t2020\tactive\nns\tname2\ttag\n")
    got = readers.tsv(spark, str(tmp_path / "t.tsv.gz"), "ns string, name string, tag string, updated string, status string").collect()
    assert {r.status for r in got} == {"active", ""}
    (tmp_path / "j.tsv").write_text('5\t["a", "b"]\nx\t[]\n')
    assert [(r.id, r.images) for r in readers.tsv_json(spark, str(tmp_path / "j.tsv")).collect()] == [(5, ["a", "b"])]
    (tmp_path / "c.csv").write_text("Category,Container,Image,Port,IP,Type\nweb,c,nginx,80,1.2.3.4,x\nweb,c,,80,,x\n")
    assert [(r.image, r.ip) for r in readers.csv_targets(spark, str(tmp_path / "c.csv")).collect()] == [("nginx:latest", "1.2.3.4")]
    with pytest.raises(ValueError):
        readers.csv_targets(spark, str(tmp_path / "c.csv"), image="Nope")
    (tmp_path / "l.txt").write_text("a # c\n# d\n\nb\n")
    lines = readers.listed(spark, str(tmp_path / "l.txt"))
    assert [r.value for r in lines.collect()] == ["a", "b"]
    assert readers.in_lines(spark.createDataFrame([("a",), (None,), ("z",)], "k string"), lines, "k").count() == 1


def test_trees(spark, tmp_path):
    for slug, host, doc in (("s1", "h1", '{"target": {"image": "i"}, "findings": []}'), ("s2", "h1", "{broken")):
        (tmp_path / "out" / slug).mkdir(parents=True)
        (tmp_path / "out" / slug / "report.json").write_text(doc)
    assert [(r.slug, r.target.image) for r in readers.reports(spark, str(tmp_path / "out"), REPORT).collect()] == [("s1", "i")]
    stored = spark.createDataFrame([("i", '{"started_at": "x"}'), ("j", "{bad"), ("k", "y" * 100)], "image string, report_json string")
    assert [r.image for r in readers.stored_reports(stored, REPORT, 50).collect()] == ["i"]
    files = spark.createDataFrame([("b", "s", "x"), ("a", "s", ""), ("c", "s", "y")], "host string, slug string, doc string")
    assert readers.best_host(files, ["a", "c", "b"]).first().doc == "y"
    (tmp_path / "r.xml").write_text("<report><result><name>n</name></result><result><name>m</name></result></report>")
    assert readers.xml_results(spark, str(tmp_path / "r.xml"), "name string").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.json_lines(df.limit(0), str(tmp_path / "j"), resume=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.gzip_tsv(df, str(tmp_path / "t"))
    sinks.csv_metrics(df, str(tmp_path / "c"), ["n", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["n", "missing"]
    sinks.per_target(df, str(tmp_path / "p"), "k")
    assert (tmp_path / "p" / "k=a").exists()
    sinks.json_artefact(df, str(tmp_path / "one"))
    assert len([json.loads(x) for p in (tmp_path / "one").glob("*.json") for x in p.read_text().splitlines()]) == 2
    df.write.parquet(str(tmp_path / "keyed"))
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, n int, seq int")
    assert {(r.k, r.n) for r in sinks.upsert(spark, str(tmp_path / "keyed"), new, ["k"]).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert sinks.table_values(df, "k", "n") == {"a": "1", "b": "2"}


def test_windowed_stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    src.repartitionByRange(3, "ts").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = ev.file_stream(spark, str(tmp_path / "in"), src.schema.simpleString()[7:-1].replace(":", " "), 1)
    q = ev.into_table(ev.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in ev.tumbling(src).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) <= len(want)


def test_leases(spark, tmp_path):
    rows = spark.createDataFrame([("a", "w", "claim", "2024-01-01 00:00:00"), ("b", "w", "claim", "2024-01-01 00:00:01"), ("b", "w", "done", "2024-01-01 00:00:02")], "image string, worker string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    later = spark.createDataFrame([("z", "w", "claim", "2024-01-01 02:00:00")], "image string, worker string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = ev.file_stream(spark, str(tmp_path / "in"), "image string, worker string, kind string, ts timestamp")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    ev.into_table(ev.leases(stream), out, cp).awaitTermination(120)
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ev.into_table(ev.leases(stream), out, cp).awaitTermination(120)
    got = {(r.image, r.state) for r in spark.read.parquet(out).collect()}
    assert ("a", "running") in got and ("b", "done") in got and ("a", "stale") in got


def test_rate_equals_its_sql_on_odd_points(spark, tmp_path):
    import duckdb

    from hullscope import plans

    day = "2024-01-01 "
    points = {
        "brief": [(5, day + "00:00:01.9"), (25, day + "00:00:31.1")],
        "one second": [(5, day + "00:00:01.1"), (25, day + "00:00:01.9")],
        "falls in one second": [(25, day + "00:00:01.1"), (5, day + "00:00:01.9")],
        "single": [(5, day + "00:00:01")],
        "copies of an instant": [(i, day + "00:00:01") for i in range(20)],
        "no instant": [(3, None), (9, None)],
        "some without instant": [(3, None), (50, day + "00:00:00"), (60, day + "00:05:00"), (99, None)],
        "no count": [(None, day + "00:00:00"), (None, day + "00:05:00")],
        "ends without count": [(None, day + "00:00:00"), (10, day + "00:01:00"), (20, day + "00:02:00"), (None, day + "00:05:00")],
        "half of the last digit": [(0, day + "00:00:00"), (41, day + "10:40:00")],
        "before 1970": [(1, "1969-12-31 23:59:58.7"), (4, "1969-12-31 23:59:59.2"), (8, "1970-01-01 00:00:00.1")],
        "many": [(m * m, f"{day}00:{m:02d}:00") for m in range(30)],
        None: [(1, day + "00:00:00"), (4, day + "00:00:30")],
    }
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", [(n, ts, kind) for kind, rows in points.items() for n, ts in rows])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    queries, sql = plans.load()
    want = {kind: repr(v) for kind, v in con.execute(sql["events_rate"]).fetchall()}  # tells null, nan and inf apart
    assert {r.event_type: repr(r.per_minute) for r in queries["events_rate"](spark, str(tmp_path)).collect()} == want
    assert {want[k] for k in ("one second", "copies of an instant", "no instant")} == {"inf", "nan", "0.0"}
    rows = ev.instants(readers.table(spark, str(tmp_path), "events"))
    floor = {r.event_type: r.per_minute for r in ev.rate(rows, "event_type", "ts", "event_id").collect()}
    assert floor["brief"] is None and floor["single"] is None and floor["no instant"] is None and floor["some without instant"] == 2.0


def test_rate_takes_the_largest_count_of_an_instant(spark):
    rows = ev.instants(spark.createDataFrame([("a", f"2024-01-01 00:0{m}:00", 10 * m + n) for m in range(6) for n in range(3)], "k string, ts string, n long"))
    for few in (rows, rows.orderBy("n"), rows.orderBy(F.col("n").desc())):  # the last eight: minutes 5 and 4, two of 3
        assert [r.per_minute for r in ev.rate(few, "k", "ts", "n").collect()] == [10.0]
