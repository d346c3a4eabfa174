"""Event feeds as streams over files that arrive in two batches."""

from __future__ import annotations

import json
import time

import pytest
from tallyspark.streaming import events as feed


def put(folder, name: str, rows: list[tuple]) -> None:
    folder.mkdir(exist_ok=True)
    keys = ("run_id", "seq", "ts", "kind", "stage", "progress", "status")
    (folder / name).write_text("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows))


def event(run: str, seq: int, status: str = "running", kind: str = "progress", progress: float = 1.0) -> tuple:
    return run, seq, f"2024-01-01T00:{seq:02d}:00Z", kind, f"s{seq}", progress, status


FIRST = [event("a", 1, "queued"), event("a", 2), event("a", 2), event("b", 1, "queued"), event("c", 5, "queued")]
SECOND = [event("a", 4), event("a", 5, "queued"), event("b", 2), event("b", 3, "done", "complete", 150.0), event("b", 3, "done", "complete", 150.0), event("c", 6, "done")]
ALLOWED = {"queued": ["running"], "running": ["running", "done"], "done": []}


def run(stream, name: str, folder, mode: str) -> None:
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_transitions_and_numbers_are_followed_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "1.json", FIRST)
    put(source, "2.json", SECOND)
    stream = feed.transition_stream(feed.read_events(spark, str(source), files_a_batch=1), ALLOWED)
    run(stream, "issues", tmp_path / "c1", "append")
    found = sorted(map(tuple, spark.table("issues").collect()))
    assert found == [("a", 2, "repeated"), ("a", 4, "gap"), ("a", 5, "transition"), ("b", 3, "repeated"), ("c", 6, "transition")]


def test_events_are_written_once_across_restarts(spark, tmp_path):
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c2")
    for name, rows in (("1.json", FIRST), ("2.json", SECOND)):
        put(source, name, rows)
        feed.write_events(feed.once(feed.read_events(spark, str(source))), out, at).awaitTermination(120)
    written = sorted((r.run_id, r.seq) for r in spark.read.schema(feed.EVENT).json(out).collect())
    assert written == sorted({(r[0], r[1]) for r in FIRST + SECOND})


def test_latest_and_issues(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "1.json", FIRST)
    put(source, "2.json", SECOND)
    batch = spark.read.schema(feed.EVENT).json(str(source))
    latest = {r.run_id: tuple(r)[1:] for r in feed.latest(batch).collect()}
    assert latest == {"a": (5, "s5", "queued", 1.0, False), "b": (3, "s3", "done", 100.0, True), "c": (6, "s6", "done", 1.0, False)}
    run(feed.latest(feed.read_events(spark, str(source))), "latest", tmp_path / "c3", "complete")
    assert {r.run_id: tuple(r)[1:] for r in spark.table("latest").collect()} == latest
    issues = sorted(map(tuple, feed.feed_issues(batch).collect()))
    assert issues == [("a", 2, "repeated"), ("a", 4, "gap"), ("b", 3, "repeated")]
    late = batch.unionByName(spark.createDataFrame([("b", 4, None, "progress", "s", 1.0, "x")], feed.EVENT))
    assert ("b", 4, "after_end") in set(map(tuple, feed.feed_issues(late).collect()))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_run_states_over_restarts_with_bounded_state(rocks, tmp_path):
    """Each batch is a query of its own on one checkpoint; state is left for open runs alone."""
    source, at = tmp_path / "in", tmp_path / "c4"
    ended = [event(f"r{i}", k, s, kind) for i in range(30) for k, s, kind in ((1, "queued", "progress"), (2, "running", "progress"), (3, "done", "complete"))]
    found: list[set] = [set()]
    for n, rows in enumerate((FIRST + [e for e in ended if e[1] < 3], SECOND + [e for e in ended if e[1] == 3], [event("a", 6, "running"), event("b", 4, "queued")])):
        put(source, f"{n}.json", rows)
        query = feed.write_events(feed.run_states(feed.read_events(rocks, str(source)), ALLOWED), str(tmp_path / "out"), str(at))
        assert query.awaitTermination(120) and query.exception() is None
        found.append({tuple(r) for r in rocks.read.schema("run_id string, seq long, code string").json(str(tmp_path / "out")).collect() if r.run_id[0] != "r"})
        left = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    assert found[1] == {("a", 2, "repeated")}
    assert found[2] - found[1] == {("a", 4, "gap"), ("a", 5, "transition"), ("c", 6, "transition")}
    assert found[3] == found[2]
    assert left == [3]  # a and c, which are open, and b, which began anew: none of the thirty that ended


def test_silent_runs_are_told_and_forgotten(rocks, tmp_path):
    source = tmp_path / "in"
    put(source, "0.json", [event("q", 1, "queued"), event("done", 1, "done", "complete")])
    query = feed.run_states(feed.read_events(rocks, str(source)), ALLOWED, idle_hours=1 / 3600).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c5")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not rocks.table("silent").count():
            time.sleep(1)
        assert [tuple(r) for r in rocks.table("silent").collect()] == [("q", 1, "silent")]
    finally:
        query.stop()
