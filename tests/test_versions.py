import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import records
from tessera.sources.versions import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", groups=8)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tables_appear_together_and_readers_keep_their_version(spark, store):
    assert store.current().number == 0
    one = store.change().replace("a", spark.range(3)).replace("b", spark.range(5)).commit()
    # a change reads what it replaces, and the reader of the old version is not disturbed
    pinned = store.current()
    store.change().replace("a", one.read("a").withColumn("id", F.col("id") + 10)).commit()
    assert pairs(pinned.read("a"), "id") == [(0,), (1,), (2,)] and pairs(store.current().read("a"), "id") == [(10,), (11,), (12,)]
    assert store.current().number == 2 and store.at(1).read("b").count() == 5


def test_a_job_that_dies_leaves_the_version_before_it(spark, store):
    store.change().replace("a", spark.range(3)).commit()
    change = store.change().replace("a", spark.range(7))
    with pytest.raises(Exception, match="boom|USER_RAISED"):
        change.replace("b", spark.range(2).select(F.raise_error(F.lit("boom")).alias("x")))
    assert store.current().number == 1 and store.current().read("a").count() == 3 and "b" not in store.current().tables
    assert len(store.unreferenced()) >= 1


def test_two_writers_conflict_visibly(spark, store):
    store.change().replace("a", spark.range(1)).commit()
    first, second = store.change().replace("a", spark.range(2)), store.change().replace("a", spark.range(3))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert store.current().read("a").count() == 2
    # many at once: one wins
    changes, won, lost = [store.change() for _ in range(6)], [], []

    def run(c):
        try:
            won.append(c.commit().number)
        except Conflict:
            lost.append(c)

    threads = [threading.Thread(target=run, args=(c,)) for c in changes]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [3] and len(lost) == 5


def rows(spark, ids, status="RENDERED"):
    return spark.createDataFrame([(f"t{i}", i, i + 1, 120.0, status) for i in ids], "transition_id string, track_a_id bigint, track_b_id bigint, session_bpm double, status string")


def test_metrics_that_arrive_later_rewrite_only_their_groups(spark, store):
    v1 = records.save_transitions(store.change(), rows(spark, range(100))).commit()
    v2 = records.save_transitions(store.change(), rows(spark, range(100, 120))).commit()
    # an append rewrites nothing
    assert v1.folders() < v2.folders() and records.transitions(v2).count() == 120
    metrics = spark.createDataFrame([("t7", 1.5, "D"), ("t110", 2.5, "C")], "transition_id string, alignment_error_ms double, strategy string")
    v3 = records.attach_metrics(store.change(), metrics).commit()
    touched = set(map(str, store.groups_of(metrics, "transition_id")))
    before, after = v2.tables["transitions"]["parts"], v3.tables["transitions"]["parts"]
    assert len(touched) <= 2 and {g for g in before if before[g] != after[g]} == touched
    assert v3.folders() & v2.folders() and records.transitions(v3).count() == 120
    ids = spark.createDataFrame([("t7",), ("t8",), ("t110",), ("none",)], "transition_id string")
    assert pairs(records.transitions(v3, ids), "transition_id", "alignment_error_ms", "strategy", "session_bpm") == [("t110", 2.5, "C", 120.0), ("t7", 1.5, "D", 120.0), ("t8", None, None, 120.0)]
    assert pairs(records.transitions(v2, ids).where("transition_id = 't7'"), "alignment_error_ms") == [(None,)]
    # a second measurement replaces one metric and keeps the other
    v4 = records.attach_metrics(store.change(), spark.createDataFrame([("t7", 9.0)], "transition_id string, render_seconds double")).commit()
    assert pairs(records.transitions(v4, ids.where("transition_id = 't7'")), "alignment_error_ms", "render_seconds") == [(1.5, 9.0)]
    assert len(records.METRICS) == 12


def test_keys_are_there_once_and_known(spark, store):
    store.change().replace("x", spark.range(1)).commit()
    records.save_transitions(store.change(), rows(spark, range(5))).commit()
    with pytest.raises(ValueError, match="already"):
        records.save_transitions(store.change(), rows(spark, [4]))
    with pytest.raises(ValueError, match="more than once"):
        records.save_transitions(store.change(), rows(spark, [9, 9]))
    with pytest.raises(ValueError, match="has no"):
        records.attach_metrics(store.change(), spark.createDataFrame([("t77", 1.0)], "transition_id string, render_seconds double"))
    with pytest.raises(ValueError, match="no metrics"):
        records.attach_metrics(store.change(), spark.createDataFrame([("t1", 1.0)], "transition_id string, session_bpm double"))
    assert store.current().number == 2


def test_row_and_audio_appear_together(spark, store):
    mixes = spark.createDataFrame(
        [("t1", 1, 2, [0.0, 0.5, -0.5, 0.25], 2, 44100, None), ("t2", 1, 3, None, 2, 44100, "NO_PLAN")],
        "transition_id string, track_a_id bigint, track_b_id bigint, samples array<float>, channels int, rate int, failure_reason string",
    )
    version = records.publish_renders(store, mixes)
    found = {r.transition_id: r for r in records.transitions(version).collect()}
    assert found["t1"].status == "RENDERED" and Path(found["t1"].wav_path).read_bytes()[:4] == b"RIFF"
    assert found["t2"].status == "FAILED" and found["t2"].wav_path is None
    # one mix cannot be written: neither row nor audio of any is in a version
    broken = mixes.withColumn("transition_id", F.concat(F.lit("u"), "transition_id")).withColumn("channels", F.lit(0))
    with pytest.raises(Exception):
        records.publish_renders(store, broken)
    assert store.current().number == version.number and records.transitions(store.current()).count() == 2


def test_sessions_move_through_their_states(spark, store):
    asked = lambda *r: spark.createDataFrame(list(r), "session_id string, status string, payload string, config_snapshot string")
    v, refused = records.save_sessions(store, asked(("s1", "RENDERING", "p", "first"), ("s2", "READY", "p", "c"), ("s3", "RENDERING", "p", "c"), (None, "RENDERING", None, None)))
    assert sorted(refused.select("to_status", "failure_reason").collect()) == [("READY", "ILLEGAL_MOVE"), ("RENDERING", "MISSING_ID")]
    v, refused = records.save_sessions(store, asked(("s1", "READY", "done", "second"), ("s3", "FAILED", "x", "c"), ("s3", "READY", "y", "c")))
    assert [tuple(r) for r in refused.orderBy("to_status").collect()] == [("s3", "RENDERING", "FAILED", "SEVERAL_MOVES"), ("s3", "RENDERING", "READY", "SEVERAL_MOVES")]
    assert pairs(v.read("sessions"), "session_id", "status", "payload", "config_snapshot") == [("s1", "READY", "done", "first"), ("s3", "RENDERING", "p", "c")]
    v, refused = records.save_sessions(store, asked(("s1", "RENDERING", "again", "third")))
    assert refused.count() == 1 and pairs(records.session(v, asked(("s1", "", "", ""))), "status") == [("READY",)]


def test_keys_of_a_wide_table_are_not_broadcast(spark, store):
    """A wide, mostly empty table has small files: by their size alone its keys would go through the driver."""
    executions = spark._jsparkSession.sharedState().statusStore()
    before = executions.executionsCount()
    ids = spark.range(2000).select(F.col("id").cast("string").alias("transition_id"), F.lit("RENDERED").alias("status"))
    records.save_transitions(store.change(), ids.where("transition_id < '5'")).commit()
    records.save_transitions(store.change(), ids.where("transition_id >= '5'")).commit()
    version = records.attach_metrics(store.change(), ids.select("transition_id", F.lit("D").alias("strategy"))).commit()
    assert records.transitions(version).where("strategy = 'D'").count() == 2000
    after = [executions.executionsList().apply(i) for i in range(before, executions.executionsCount())]
    assert after and not any("BroadcastExchange" in e.physicalPlanDescription() for e in after)
