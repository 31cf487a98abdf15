import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators.incremental import IncrementalTarget, PublishConflict, new_or_changed, replay_changes, run_listing, succeeded_runs

FILES = "repo string, run_id long, path string, hash string, listed_at timestamp, PATH string"
RUNS = "run_id long, repo string, started_at timestamp, finished_at timestamp, status string, recorded_at timestamp"


def frames(spark, files, runs):
    f = spark.createDataFrame(files, FILES.replace(", PATH string", "")).withColumn("extra", F.lit(1))
    return f, spark.createDataFrame(runs, RUNS)


def ts(k):
    from datetime import datetime, timedelta

    return datetime(2025, 1, 1) + timedelta(hours=k)


def test_replay_gives_new_and_changed_paths_of_succeeded_runs(spark):
    runs = [
        (2, "r", ts(2), ts(3), "failed", ts(3)), (1, "r", ts(0), ts(1), "ok", ts(1)), (3, "r", ts(4), ts(5), " OK ", ts(5)), (4, "r", ts(6), None, "ok", ts(6)),
        (3, "r", ts(4), ts(5), "failed", ts(4)), (9, "q", ts(0), ts(1), None, ts(1)), (None, "r", ts(0), ts(1), "ok", ts(1)),
    ]
    files = [
        ("r", 1, "a", "AA", ts(0)), ("r", 1, "b", "bb", ts(0)), ("r", 1, "./c", "cc", ts(0)), ("r", 2, "z", "zz", ts(2)),
        ("r", 3, "a", "aa", ts(4)), ("r", 3, "b", "b2", ts(4)), ("r", 3, "b", "bb", ts(3)), ("r", 3, "c", "cc", ts(4)), ("r", 3, "d\\e", None, ts(4)), ("r", 3, None, "x", ts(4)), ("r", 4, "y", "y", ts(6)),
    ]
    got = {tuple(r) for r in replay_changes(*frames(spark, files, runs)).collect()}
    assert got == {(3, "b"), (3, "d/e")}


def test_empty_tables_and_clashing_columns(spark):
    f, r = frames(spark, [], [])
    assert replay_changes(f, r).count() == 0
    assert succeeded_runs(r).count() == 0
    clash = spark.createDataFrame([("r", 1, "a", "h", ts(0), "other")], FILES.replace("PATH", "`Path2`"))
    assert run_listing(clash.toDF("repo", "run_id", "path", "hash", "listed_at", "PATH")).first().path == "a"


def test_null_versions_are_equal_only_to_each_other(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (None, "y")], "k int, v string")
    assert [r.k for r in new_or_changed(a, b, ["k"], "v").collect()] == [2]


def target(spark, tmp_path):
    return IncrementalTarget(spark, f"file://{tmp_path}/target", ["k"], "v")


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, x int")


def test_each_run_processes_only_what_is_new(spark, tmp_path):
    t = target(spark, tmp_path)
    assert t.read() is None and t.sync(frame(spark, [])) == 0
    first = frame(spark, [(1, "a", 1), (2, "b", 2), (1, "a", 1), (None, "c", 3)])
    assert t.sync(first) == 1 and t.sync(first) == 1
    second = frame(spark, [(1, "a", 9), (2, "z", 2), (4, "d", 4)])
    assert {r.k for r in t.pending(second).collect()} == {2, 4}
    assert t.sync(second, lambda d: d.where("k <> 4")) == 2
    assert t.pending(second).count() == 0
    assert {(r.k, r.v, r.x) for r in t.read().collect()} == {(1, "a", 1), (2, "z", 2), (None, "c", 3)}
    assert t.compact() == 3 and t.read().count() == 3 and t.pending(second).count() == 0


def test_clashing_columns_are_kept_under_other_names(spark, tmp_path):
    t = target(spark, tmp_path)
    rows = spark.createDataFrame([(1, "a", 2, "x" * 100_000, None)], "k int, v string, c2 int, c3 string, c4 string").toDF("k", "v", "K", "_kept", "V")
    assert t.sync(rows) == 1 and t.sync(rows) == 1
    assert t.read().columns == ["k", "v", "K__2", "_kept__2", "V__2"] and t.read().count() == 1


def test_a_failed_run_leaves_the_version_before(spark, tmp_path):
    t = target(spark, tmp_path)
    t.sync(frame(spark, [(1, "a", 1)]))
    publish, t.log.publish = t.log.publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.sync(frame(spark, [(2, "b", 2)]))
    t.log.publish = publish
    assert [r.k for r in t.read().collect()] == [1]
    assert t.sync(frame(spark, [(2, "b", 2)])) == 2
    assert sorted(r.k for r in t.read().collect()) == [1, 2]
    with pytest.raises(PublishConflict):
        t.log.publish(2, {})


def test_the_later_row_counts_whatever_its_hash(spark, tmp_path):
    t = IncrementalTarget(spark, f"file://{tmp_path}/target", ["k"], "v", order="at")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, at int")
    t.sync(rows((1, "f0", 1), (1, "00", 2), (2, "a", 5)))
    assert {(r.k, r.v) for r in t.read().collect()} == {(1, "00"), (2, "a")}
    t.sync(rows((1, "ff", 1), (2, "b", 6)))
    assert {(r.k, r.v) for r in t.read().collect()} == {(1, "00"), (2, "b")}


def test_removed_keys_leave_and_return_as_new(spark, tmp_path):
    t = IncrementalTarget(spark, f"file://{tmp_path}/target", ["g", "k"], "v")
    rows = lambda *r: spark.createDataFrame(r, "g string, k int, v string")
    scope = lambda *g: spark.createDataFrame([(x,) for x in g], "g string")
    t.sync(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")), complete=True)
    t.sync(rows(("a", 1, "x")), complete=scope("a"))
    assert {(r.g, r.k) for r in t.read().collect()} == {("a", 1), ("b", 1), (None, 1)}
    t.sync(rows(("a", 1, "x"), ("a", 2, "y")), complete=scope("a"))
    assert [(r.k, r._change) for r in t.changes(2).collect()] == [(2, "new")]
    t.sync(rows(), complete=scope("b", None))
    assert {(r.g, r.k) for r in t.read().collect()} == {("a", 1), ("a", 2)}
    t.sync(rows(), complete=True)
    assert t.read().count() == 0


def test_segments_are_merged_by_rule(spark, tmp_path):
    t = target(spark, tmp_path)
    for k in range(6):
        t.sync(frame(spark, [(i, f"{k}" if i == k else "same", i) for i in range(20)]))
        assert len(t.log.current()[1]["segments"]) <= t.MOST_SEGMENTS
    t.sync(frame(spark, [(i, "other", i) for i in range(20)]))
    assert len(t.log.current()[1]["segments"]) == 1 and t.read().count() == 20


def test_a_replay_that_died_goes_on(spark, tmp_path, monkeypatch):
    runs = [(k, "r", ts(2 * k), ts(2 * k + 1), "ok", ts(2 * k + 1)) for k in range(1, 5)] + [(9, "q", ts(0), ts(1), "ok", ts(1))]
    listed = {1: {"a": "1", "b": "1"}, 2: {"a": "1"}, 3: {"a": "2", "b": "1"}, 4: {"a": "2", "b": "1", "c": "1"}}
    files = [("r", k, p, h, ts(2 * k)) for k, own in listed.items() for p, h in own.items()] + [("q", 9, "z", "z", ts(0))]
    f, r = frames(spark, files, runs)
    root = f"file://{tmp_path}/replay"
    sync = IncrementalTarget.sync
    monkeypatch.setattr(IncrementalTarget, "sync", lambda self, *a, note=None, **k: (_ for _ in ()).throw(RuntimeError("lost")) if note == 3 else sync(self, *a, note=note, **k))
    with pytest.raises(RuntimeError):
        replay_changes(f, r, root)
    monkeypatch.setattr(IncrementalTarget, "sync", sync)
    expected = {(3, "a"), (3, "b"), (4, "c")}
    assert sorted(map(tuple, replay_changes(f, r, root).collect())) == sorted(expected)
    assert {tuple(x) for x in replay_changes(f, r).collect()} == expected


def test_random_edits_reach_the_same_state_as_one_full_run(spark, tmp_path):
    rng = random.Random(5)
    state: dict[int, str] = {}
    t = target(spark, tmp_path)
    for step in range(4):
        for _ in range(5):
            state[rng.randrange(8)] = f"v{step}{rng.randrange(3)}"
        t.sync(frame(spark, [(k, v, len(v)) for k, v in state.items()]))
    assert {(r.k, r.v) for r in t.read().collect()} == set(state.items())
