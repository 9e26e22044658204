"""The job queue on fixtures: an expired lease, two claimants, retries, and a stream that is read in several batches."""

from datetime import datetime, timedelta

import pytest

from tracemill.streaming import queue as Q
from tracemill.streaming.jobs import run_available

START = datetime(2026, 1, 1)
NAMES = [f.split()[0] for f in Q.COMMANDS.split(", ")]


def command(minute, seq, kind, job=None, **more):
    row = dict.fromkeys(NAMES) | {"queue": "q", "at": START + timedelta(minutes=minute), "seq": seq, "kind": kind, "job_id": job} | more
    return tuple(row[n] for n in NAMES)


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, Q.STATE_STORE)
    yield
    spark.conf.set(key, old)


def stream(spark, path, batches):
    """Each batch of commands is a file of its own, and each file a micro-batch; what has come out so far after each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, Q.COMMANDS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run_available(Q.job_outcomes(Q.read_commands(spark, f"{path}/in", 1)), f"{path}/out", f"{path}/state")
    return [r.asDict() for r in spark.read.parquet(f"{path}/out").collect()]


def told(rows, kind):
    return sorted(((int((r["at"] - START).total_seconds() // 60), r["job_id"], r["worker"], r["attempts"]) for r in rows if r["kind"] == kind), key=str)


def test_leases_and_two_claimants(spark, store, tmp_path):
    rows = stream(
        spark,
        str(tmp_path),
        [
            [command(0, 1, "enqueue", "a", max_attempts=2), command(0, 2, "enqueue", "b", priority=1), command(0, 1, "enqueue", "other", queue="p")],
            [command(1, 3, "claim", worker="w1"), command(1, 4, "claim", worker="w2"), command(1, 5, "claim", worker="w3")],  # two jobs for three claimants
            [command(2, 6, "complete", "b", worker="w2"), command(2, 7, "complete", "b", worker="w1"), command(10, 8, "claim", worker="w3")],  # w2 never had b; a's lease holds
            [command(17, 9, "claim", worker="w4"), command(17, 10, "complete", "a", worker="w2")],  # a's lease has run out; w2 lost it
            [command(40, 11, "claim", worker="w5"), command(41, 12, "retry", "a"), command(41, 13, "nonsense", "a")],  # no attempts left
            [command(60, 14, "enqueue", "late")],
        ],
    )
    assert told(rows, "claimed") == [(1, "a", "w2", 1), (1, "b", "w1", 1), (17, "a", "w4", 2)]
    assert told(rows, "nothing_to_claim") == [(1, None, "w3", None), (10, None, "w3", None), (40, None, "w5", None)]
    assert told(rows, "complete") == [(2, "b", "w1", 1)]
    assert [r["status"] for r in rows if r["kind"] == "lease_expired" and r["job_id"] == "a" and r["attempts"] == 2] == ["failed"]
    assert sorted((r["seq"] for r in rows if r["kind"] == "ignored")) == [6, 10, 12, 13]
    assert {r["queue"] for r in rows} == {"q", "p"}


def test_bounded_claims_retries_and_guards(spark, store, tmp_path):
    jobs = [command(0, k, "enqueue", f"j{k}", job_type="parse" if k % 2 else "rules", priority=k % 3) for k in range(7)]
    rows = stream(
        spark,
        str(tmp_path),
        [
            [*jobs, command(0, 90, "enqueue", "j1"), command(0, 91, "enqueue", "later", available_at=START + timedelta(minutes=30), job_type="parse")],
            [command(1, 100, "claim", worker="w", job_types=["parse"], max_jobs=2), command(1, 101, "claim", worker="w", max_jobs=50)],
            [command(2, 102, "fail", "j3", retryable=True), command(2, 103, "fail", "j1", retryable=False), command(3, 104, "claim", worker="x", max_jobs=9)],
            [command(7, 105, "claim", worker="x", max_jobs=1), command(7, 106, "retry", "j1"), command(8, 107, "claim", worker="y", max_jobs=2), command(8, 108, "retry", "j1")],
        ],
    )
    assert [(r["job_id"], r["continues"]) for r in sorted((r for r in rows if r["kind"] == "claimed" and r["seq"] == 100), key=lambda r: r["job_id"])] == [("j1", True), ("j3", True)]
    assert {(r["job_id"], r["continues"]) for r in rows if r["kind"] == "claimed" and r["seq"] == 101} == {(f"j{k}", False) for k in (0, 2, 4, 5, 6)}
    assert [r["job_id"] for r in rows if r["seq"] == 104] == [None]  # five minutes aren't over
    assert [(r["job_id"], r["attempts"], r["continues"]) for r in rows if r["seq"] == 105] == [("j3", 2, True)]
    assert [(r["job_id"], r["attempts"], r["continues"]) for r in rows if r["seq"] == 107] == [("j1", 2, False)]
    assert [r["status"] for r in rows if r["seq"] == 106] == ["retryable"] and {r["kind"] for r in rows if r["seq"] in (90, 108)} == {"ignored"}


def test_a_table_needs_no_state_store(spark):
    """The rules go through sorted rows: no call of a state store for each job, and the same outcomes, nulls and unknown kinds included."""
    jobs = [command(0, k, "enqueue", f"j{k}", job_type="parse", priority=k % 3) for k in range(7)] + [command(0, 20, "enqueue", "j1"), command(0, 21, "enqueue", None), command(0, 1, "enqueue", "n", queue=None)]
    later = [command(3, 30, "claim", worker="w", max_jobs=4, job_types=["parse"]), command(4, 31, "complete", "j0", worker="w"), command(4, 32, "fail", "j3"), command(5, 33, "retry", "j3"), command(5, 34, "odd", "j3")]
    wave = [command(30, 35, "claim", worker="v", max_jobs=50), command(31, 36, "complete", "j0"), command(31, 1, "claim", worker="v", queue=None), command(32, 2, "claim", worker="v", queue="empty")]
    df = Q.job_outcomes(spark.createDataFrame([*wave, *later, *jobs], Q.COMMANDS))
    assert "StateStore" not in df._jdf.queryExecution().executedPlan().toString() and "TransformWithState" not in df._jdf.queryExecution().executedPlan().toString()
    rows = [r.asDict() for r in df.collect()]
    first, second = [(3, f"j{k}", "w", 1) for k in (0, 1, 3, 6)], [(30, f"j{k}", "v", 1 + (k in (1, 3, 6))) for k in range(1, 7)]
    assert sorted(told(rows, "claimed")) == sorted([*first, *second, (31, "n", "v", 1)])
    assert sorted((r["seq"] for r in rows if r["kind"] == "ignored")) == [20, 21, 34, 36]
    assert [(r["queue"], r["continues"]) for r in rows if r["kind"] == "nothing_to_claim"] == [("empty", False)]
    assert {(r["seq"], r["status"], r["attempts"]) for r in rows if r["seq"] in (31, 32, 33)} == {(31, "succeeded", 1), (32, "failed", 1), (33, "retryable", 1)}
