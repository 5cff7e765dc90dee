"""Streams over several files: numbering continued and replayed, watches due by timer."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.operators import watch
from riskframe.streaming import streams

START = datetime(2024, 1, 1)
EVENTS = "repo_id long, event_id long, ts timestamp, message string"
CHECKS = "watch_id long, ts timestamp, hours double"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def at(hours):
    return START + timedelta(hours=hours)


def test_numbers_go_on_and_a_batch_written_again_keeps_them(spark, tmp_path):
    source, out, checkpoint, earlier = (str(tmp_path / n) for n in ("in", "out", "chk", "chk-earlier"))
    put(spark, source, [(1, 10, at(0), "a"), (1, 11, at(3), "b"), (2, 12, at(1), "c")], EVENTS)
    schema = spark.read.parquet(source).schema

    def run(folder):
        streams.append_numbered(streams.read_events(spark, source, schema, 1), out, folder).awaitTermination()
        return sorted((r.repo_id, r.event_id, r.seq) for r in spark.read.parquet(out).collect())

    first = [(1, 10, 1), (1, 11, 2), (2, 12, 1)]
    assert run(checkpoint) == first
    shutil.copytree(checkpoint, earlier)
    put(spark, source, [(1, 13, at(9), "d"), (3, 14, at(9), "e")], EVENTS)
    both = sorted([*first, (1, 13, 3), (3, 14, 1)])
    assert run(checkpoint) == both
    assert run(earlier) == both
    put(spark, source, [(2, 15, at(10), "f"), (1, 16, at(10), "g"), (1, 17, at(10), None)], EVENTS)
    assert run(checkpoint) == sorted([*both, (2, 15, 2), (1, 16, 4), (1, 17, 5)])
    high = spark.read.parquet(f"{out}/_high_water/batch=2").collect()
    assert sorted((r.repo_id, r.high_water) for r in high) == [(1, 5), (2, 2), (3, 1)]


@pytest.fixture
def due(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "chk"))

    def run(*files):
        for rows in files:
            put(spark, source, rows, CHECKS)
            stream = streams.read_events(spark, source, spark.read.parquet(source).schema, 1)
            found = streams.due_by_timer(stream, "watch_id", "ts", "hours")
            streams.append_to_table(found, out, checkpoint).awaitTermination()
        return sorted((r.watch_id, r.due_at) for r in spark.read.parquet(out).collect())

    return run


def test_timers_fire_once_event_time_has_passed(due):
    # Watch 1 is checked anew before its hour is over; 2 is due; 3 is manual; 4 is due only after the second file.
    assert due([(1, at(0), 1.0), (1, at(4.5), 1.0), (2, at(1), 1.0), (3, at(0), None), (4, at(4), 3.0), (5, at(5), 1.0)]) == [(2, at(2))]


def test_timers_over_several_files(due):
    found = due(
        [(1, at(0), 1.0), (2, at(0), 24.0), (None, at(1), 1.0), (3, None, 1.0)],
        [(2, at(3), 1.0), (9, at(3), None)],
        [(1, at(8), 1.0), (1, at(8), 6.0)],
        [(9, at(20), None)],
    )
    assert found == [(1, at(1)), (1, at(9)), (2, at(4))]


def test_no_rows(spark, due):
    assert due([]) == []


def test_removed_modules_are_changes(spark):
    fields = (
        "library string, name string, kind string, file string, line long, params array<struct<name:string,kind:string,`default`:string>>, deprecated boolean, "
        "body string, target string, bases array<string>, deprecated_params map<string,string>, required_params map<string,string>"
    )
    row = ("lib", "lib.a.f", "function", "a.py", 1, [], False, "x", "lib.a.f", [], None, None)
    snapshot = spark.createDataFrame([row], fields)
    old = spark.createDataFrame([("lib", "lib.a"), ("lib", "lib.b"), ("lib", "lib._c"), ("lib", "lib.b")], "library string, module string")
    gone = watch.removed_modules(old, old.where("module = 'lib.a'"))
    found = watch.diff_snapshots(snapshot, snapshot, gone)
    assert [(r.kind, r.severity, r.target, r.names) for r in found.collect()] == [("module_removed", "breaking", "lib.b", ["lib.b"])]
    none = spark.createDataFrame([], "project_id long, file string, impacts long, project string, level string, library string")
    stats = watch.watch_stats(found, none.select("library", "project_id", "file", "level")).first()
    assert (stats.changes, stats.changes_module_removed, stats.impact_level) == (1, 1, "none")
    assert found.where(F.col("detail").contains("lib.b")).count() == 1
