"""Readers, sinks and streams through files."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.operators import checks, weblog
from spanlake.sources import readers, sinks
from spanlake.streaming import weblog as streams


def test_landed_files_repair_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\u00e9".encode())
    (tmp_path / "b.txt").write_bytes("caf\u00e9".encode("latin-1"))
    assert [r["text"] for r in readers.landed_files(spark, str(tmp_path)).collect()] == ["caf\u00e9"] * 2


def test_json_and_yaml(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"vote_id": "v1", "status": "approved", "issues": ["a"], "votes": {"m": "for"}}]))
    row = readers.json_records(spark, str(tmp_path / "x.json"), readers.REVIEW).first()
    assert row["vote_id"] == "v1" and row["votes"] == {"m": "for"} and row["summary"] is None
    for body in ("- {id: a, n: 1}\n", "entries:\n  - {id: a, n: 1}\n"):
        (tmp_path / "d.yaml").write_text(body)
        assert [tuple(r) for r in readers.yaml_dimension(spark, str(tmp_path / "d.yaml"), "id string, n int").collect()] == [("a", 1)]


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, x string")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    sinks.publish(df, path, least_rows=1)
    with pytest.raises(checks.CheckFailed):
        sinks.publish(df.limit(1), path, problems={"ids": checks.duplicate_keys(df.union(df), ["i"])})
    with pytest.raises(checks.CheckFailed):
        sinks.publish(df, path, least_rows=3)
    assert sinks.published(spark, path).count() == 2

    def failing(*_):
        raise OSError("no rename today")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_replace", failing)
        with pytest.raises(OSError):
            sinks.publish(df.union(df), path)
    assert sinks.published(spark, path).count() == 2  # the version before is still there and still the current one
    for _ in range(3):
        sinks.publish(df.union(df).union(df), path, partition_by=("i",), keep=1)
    assert sinks.published(spark, path).count() == 6 and len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v-")]) == 2
    assert sorted(r["value"] for r in sinks.as_json_lines(df, ["x", "i"]).collect()) == ['{"x":"a","i":1}', '{"x":null,"i":2}']
    assert sorted(r["value"] for r in sinks.as_json_lines(df).collect()) == ['{"i":1,"x":"a"}', '{"i":2,"x":null}']
    old = spark.createDataFrame([("a", "edited")], "k string, v string")
    new = spark.createDataFrame([("a", "draft"), ("b", "draft")], "k string, v string")
    assert [tuple(r) for r in sinks.appended(old, new, "k", ["k"]).collect()] == [("a", "edited"), ("b", "draft")]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 2.0), (1, "2024-01-01 05:00:00", "b", 4.0), (2, "2024-01-03 00:00:00", "a", 8.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = {(str(r["began"]), r["event_type"], r["n"]) for r in streams.event_windows(events).collect()}
    late = {(str(r["began"]), r["event_type"], r["n"]) for r in spark.table("w").collect()}
    assert late == {b for b in batch if b[0] < "2024-01-02"}
    assert sorted(r["n"] for r in streams.sessions(events).collect()) == [1, 1, 2]
    target = str(tmp_path / "up")
    q = stream.writeStream.foreachBatch(streams.upsert_batches(target)).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["value"]) for r in streams.upserted(spark, target, "user_id", "ts").collect()) == [(1, 4.0), (2, 8.0)]


def test_upserts_cost_their_batch_and_compact(spark, tmp_path):
    target = str(tmp_path / "up")
    apply = streams.upsert_batches(target)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int, v string")
    read = lambda: sorted(tuple(r) for r in streams.upserted(spark, target, "k", "at").collect())
    with pytest.raises(FileNotFoundError):
        read()
    streams.compacted(spark, target, "k", "at")
    apply(rows((1, 1, "a"), (2, 1, "b")), 0)
    apply(rows((1, 2, "c"), (3, 1, "d")), 1)
    apply(rows((1, 2, "c"), (3, 1, "d")), 1)  # run again after a failure
    apply(rows((2, 1, "tie"), (1, 0, "late")), 2)
    want = [(1, 2, "c"), (2, 1, "tie"), (3, 1, "d")]
    assert read() == want
    streams.compacted(spark, target, "k", "at")
    assert read() == want and not list((tmp_path / "up" / "deltas").iterdir())
    apply(rows((3, 5, "e")), 3)
    assert read() == [(1, 2, "c"), (2, 1, "tie"), (3, 5, "e")]
    streams.compacted(spark, target, "k", "at")
    assert read() == [(1, 2, "c"), (2, 1, "tie"), (3, 5, "e")] and len([p for p in (tmp_path / "up" / "base").iterdir() if p.name.startswith("v-")]) == 1


def test_streamed_days_are_the_batch_days(spark, tmp_path):
    line = '{"msg":"handled request","status":200,"ts":"%s","request":{"uri":"/a","client_ip":"10.0.%d.9","headers":{"User-Agent":["Mozilla/5.0 (X11)"]}}}'
    rows = [(line % (t, i),) for i, t in enumerate(("2024-01-02T06:59:59Z", "2024-01-02T07:00:00Z", "2024-01-02T23:59:59Z", "2024-01-03T00:00:00Z", "2024-01-03T06:59:59Z", "2024-01-03T07:00:00Z", "2024-01-09T12:00:00Z"))]
    spark.createDataFrame(rows, "value string").write.text(str(tmp_path / "in"))
    lines = readers.log_lines(spark, str(tmp_path / "in"))
    batch = {(str(r["day"]), r["views"]) for r in weblog.daily(weblog.views(weblog.requests(lines))).collect()}
    q = streams.daily_stream(readers.log_lines(spark, str(tmp_path / "in"), stream=True)).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert batch == {("2024-01-01", 1), ("2024-01-02", 4), ("2024-01-03", 1), ("2024-01-09", 1)}
    assert {(str(r["day"]), r["views"]) for r in spark.table("days").collect()} == {b for b in batch if b[0] < "2024-01-08"}


def test_a_log_line_is_parsed_once(spark):
    reqs = weblog.requests(spark.createDataFrame([("{}",)], "value string"))
    for df in (weblog.daily(weblog.views(reqs)), weblog.returning(weblog.views(reqs)), weblog.totals(reqs)):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json") <= 1
