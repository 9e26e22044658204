"""The job queue as keyed stream state: commands go in, what became of them comes out.

A queue's commands are handled one after the other by the one task that holds its key, so two claims never win the same job,
whatever the number of workers. Open jobs are a map in the state store, closed ones another that is only looked up; leases are
timers in event time, so a lease ends on time even if nobody asks. Everything is told in the commands' own time: a stream that
is read again from its checkpoint gives the same answers.

A table of commands needs no state store: its rows are sorted by queue and time, and the same rules go through each queue's rows in one pass.

A queue is one key. A queue with very many commands should be sharded by its caller (job type and a hash of the job's id);
a claim then goes to a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMANDS = (
    "queue string, at timestamp, seq long, kind string, job_id string, job_type string, priority int, available_at timestamp, max_attempts int, "
    "worker string, job_types array<string>, max_jobs int, retryable boolean"
)
OUTCOMES = "queue string, at timestamp, seq long, kind string, job_id string, worker string, attempts int, status string, available_at timestamp, continues boolean"
JOB = "job_type string, status string, priority int, available_at timestamp, created_at timestamp, order_ long, attempts int, max_attempts int, worker string, locked_at timestamp"
# --- Fixed values: minutes of a lease, minutes before a failed job is tried again, and attempts and priority where none are given.
LEASE_MINUTES, RETRY_MINUTES, MAX_ATTEMPTS, PRIORITY = 15, 5, 3, 100
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Outcomes that a task holds before it hands them on.
ROWS_AT_ONCE = 10_000

_FIELDS = [f.split()[0] for f in JOB.split(", ")]


def _plain(value: Any) -> Any:
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return None if value is pd.NaT or (isinstance(value, float) and value != value) else value


def _millis(moment: datetime) -> int:
    """Milliseconds since the epoch of a moment in the session's zone, which the streams here keep at UTC."""
    return int(moment.replace(tzinfo=timezone.utc).timestamp() * 1000)


class Rules:
    """What commands do to the jobs of one queue, all of which are given.

    claim: up to max_jobs jobs of the wanted types (none named: all) that are queued or retryable, or whose lease has run out, are available and have attempts
    left, by priority, availability, creation; `continues` tells whether as many as wanted were found. complete: done, from running. fail: retryable after five minutes,
    or failed. retry: by hand, from failed or retryable only, while attempts are left; available at once. A command for a job
    that isn't there, or not in such a state, or of a worker that no longer holds the lease, is ignored and reported so. A job queued twice stays as it was.
    """

    def __init__(self, lease_minutes: int = LEASE_MINUTES, retry_minutes: int = RETRY_MINUTES):
        self.lease, self.pause = timedelta(minutes=lease_minutes), timedelta(minutes=retry_minutes)

    def tell(self, jobs: dict[str, dict], command: dict) -> list[tuple]:
        return getattr(self, f"_{command['kind']}", self._unknown)(jobs, command)

    def closed(self, job_id: str) -> dict | None:
        """A job that isn't among the given ones."""

    def reopened(self, job_id: str) -> None:
        pass

    def leased(self, until: datetime) -> None:
        pass

    def _said(self, command: dict, job_id: str, job: dict | None, kind: str | None = None, continues: bool | None = None) -> tuple:
        seen = job or dict.fromkeys(_FIELDS)
        return (command["at"], command["seq"], kind or command["kind"], job_id, command["worker"] or seen["worker"], seen["attempts"], seen["status"], seen["available_at"], continues)

    def _unknown(self, jobs: dict, command: dict) -> list[tuple]:
        return [self._said(command, command["job_id"], None, "ignored")]

    def _find(self, jobs: dict, job_id: str) -> dict | None:
        if job_id not in jobs and (job := self.closed(job_id)):
            jobs[job_id] = job
        return jobs.get(job_id)

    def _enqueue(self, jobs: dict, command: dict) -> list[tuple]:
        job_id = command["job_id"]
        if job_id is None or self._find(jobs, job_id):
            return self._unknown(jobs, command)
        pick = lambda name, usual: int(command[name]) if command[name] is not None else usual
        jobs[job_id] = {
            "job_type": command["job_type"], "status": "queued", "priority": pick("priority", PRIORITY), "available_at": command["available_at"] or command["at"],
            "created_at": command["at"], "order_": command["seq"], "attempts": 0, "max_attempts": pick("max_attempts", MAX_ATTEMPTS), "worker": None, "locked_at": None,
        }
        return [self._said(command, job_id, jobs[job_id])]

    def _claim(self, jobs: dict, command: dict) -> list[tuple]:
        now, types = command["at"], command["job_types"]
        wanted = int(command["max_jobs"]) if command["max_jobs"] is not None else 1

        def may(job: dict) -> bool:
            lapsed = job["status"] == "running" and job["locked_at"] < now - self.lease
            free = job["status"] in ("queued", "retryable") or lapsed
            return free and job["available_at"] <= now and job["attempts"] < job["max_attempts"] and (types is None or job["job_type"] in types)

        order = lambda i: (jobs[i]["priority"], jobs[i]["available_at"], jobs[i]["created_at"], jobs[i]["order_"], i)
        won = sorted((i for i, job in jobs.items() if may(job)), key=order)[:wanted]
        for job_id in won:
            jobs[job_id].update(status="running", worker=command["worker"], locked_at=now, attempts=jobs[job_id]["attempts"] + 1)
        if won:
            self.leased(now + self.lease)
        told = [self._said(command, i, jobs[i], "claimed", len(won) == wanted) for i in won]
        return told or [self._said(command, None, None, "nothing_to_claim", False)]

    def _held(self, jobs: dict, command: dict) -> dict | None:
        """The running job that the command is about, if its worker (when named) holds the lease."""
        job = self._find(jobs, command["job_id"]) if command["job_id"] is not None else None
        return job if job and job["status"] == "running" and command["worker"] in (None, job["worker"]) else None

    def _complete(self, jobs: dict, command: dict) -> list[tuple]:
        job = self._held(jobs, command)
        if not job:
            return self._unknown(jobs, command)
        job.update(status="succeeded", worker=None, locked_at=None)
        return [self._said(command, command["job_id"], job)]

    def _fail(self, jobs: dict, command: dict) -> list[tuple]:
        job = self._held(jobs, command)
        if not job:
            return self._unknown(jobs, command)
        again = bool(command["retryable"])
        job.update(status="retryable" if again else "failed", worker=None, locked_at=None, available_at=command["at"] + self.pause if again else job["available_at"])
        return [self._said(command, command["job_id"], job)]

    def _retry(self, jobs: dict, command: dict) -> list[tuple]:
        job = self._find(jobs, command["job_id"]) if command["job_id"] is not None else None
        if not job or job["status"] not in ("failed", "retryable") or job["attempts"] >= job["max_attempts"]:
            return self._unknown(jobs, command)
        self.reopened(command["job_id"])
        job.update(status="retryable", available_at=command["at"], worker=None, locked_at=None)
        return [self._said(command, command["job_id"], job)]


class Queue(Rules, StatefulProcessor):
    """The rules over a stream: open jobs are read for each micro-batch, closed ones looked up, and what has changed is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_jobs = handle.getMapState("open_jobs", "job_id string", JOB)
        self.closed_jobs = handle.getMapState("closed_jobs", "job_id string", JOB)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")  # as many as a micro-batch has for the queue
        jobs = {k[0]: dict(zip(_FIELDS, v, strict=True)) for k, v in self.open_jobs.iterator()}
        before, out = {k: dict(v) for k, v in jobs.items()}, []
        for command in commands.to_dict("records"):
            command = {k: _plain(v) for k, v in command.items()}
            out += self.tell(jobs, command)
        self._keep(jobs, before)
        if out:
            yield _frame(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Leases that end at this timer: their jobs may be claimed again if attempts are left, else they have failed."""
        due = expiredTimerInfo.getExpiryTimeInMs()
        jobs = {k[0]: dict(zip(_FIELDS, v, strict=True)) for k, v in self.open_jobs.iterator()}
        before, out = {k: dict(v) for k, v in jobs.items()}, []
        for job_id, job in sorted(jobs.items()):
            if job["status"] == "running" and _millis(job["locked_at"] + self.lease) <= due:
                job["status"] = "retryable" if job["attempts"] < job["max_attempts"] else "failed"
                out.append((job["locked_at"] + self.lease, None, "lease_expired", job_id, job["worker"], job["attempts"], job["status"], job["available_at"], None))
                job["worker"] = job["locked_at"] = None
        self._keep(jobs, before)
        if out:
            yield _frame(key[0], out)

    def close(self) -> None:
        pass

    def closed(self, job_id: str) -> dict | None:
        return dict(zip(_FIELDS, self.closed_jobs.getValue((job_id,)), strict=True)) if self.closed_jobs.containsKey((job_id,)) else None

    def reopened(self, job_id: str) -> None:
        self.closed_jobs.removeKey((job_id,))

    def leased(self, until: datetime) -> None:
        self.handle.registerTimer(_millis(until))

    def _keep(self, jobs: dict[str, dict], before: dict[str, dict]) -> None:
        for job_id, job in jobs.items():
            if job != before.get(job_id):
                row = tuple(job[f] for f in _FIELDS)
                if job["status"] in ("succeeded", "failed"):
                    self.closed_jobs.updateValue((job_id,), row)
                    if job_id in before:
                        self.open_jobs.removeKey((job_id,))
                else:
                    self.open_jobs.updateValue((job_id,), row)


def _frame(queue: str, rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in OUTCOMES.split(", ")]
    frame = pd.DataFrame([(queue, *r) for r in rows], columns=names)
    kinds = {"at": "datetime64[us]", "available_at": "datetime64[us]", "seq": "Int64", "attempts": "Int64", "continues": "boolean"}
    return frame.astype(kinds)


def _values(column: pa.Array) -> list:
    """As to_pylist, by way of an array where that keeps the values as they are."""
    if column.null_count == len(column):
        return [None] * len(column)
    whole = pa.types.is_timestamp(column.type) or pa.types.is_string(column.type) or (not column.null_count and pa.types.is_primitive(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if whole else column.to_pylist()


def _of_table(commands: DataFrame, rules: Rules) -> DataFrame:
    """OUTCOMES of a table: a task goes through its queues one after the other and holds the jobs of one of them."""
    names = [f.split()[0] for f in OUTCOMES.split(", ")]
    zoned = ("at", "available_at")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, jobs, out = object(), {}, []

        def told() -> pa.RecordBatch:
            kinds = {"seq": pa.int64(), "attempts": pa.int32(), "continues": pa.bool_()} | dict.fromkeys(zoned, pa.timestamp("us"))
            columns = [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*out, strict=True), strict=True)]
            columns = [c.cast(pa.timestamp("us", "UTC")) if n in zoned else c for n, c in zip(names, columns, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for frame in frames:
            for n in zoned:
                k = frame.schema.get_field_index(n)
                frame = frame.set_column(k, n, frame.column(k).cast(pa.timestamp("us")))
            for command in zip(*map(_values, frame.columns), strict=True):
                command = dict(zip(frame.schema.names, command, strict=True))
                if command["queue"] != queue:
                    queue, jobs = command["queue"], {}
                out += [(queue, *row) for row in rules.tell(jobs, command)]
                if len(out) >= ROWS_AT_ONCE:
                    yield told()
                    out = []
        if out:
            yield told()

    # a number is given, as narrow rows would be merged by their size to a few tasks, while the rules are what takes time
    tasks = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = commands.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in COMMANDS.split(", "))).repartition(tasks, "queue")
    return rows.sortWithinPartitions("queue", F.col("at").asc_nulls_last(), F.col("seq").asc_nulls_last()).mapInArrow(run, OUTCOMES)


def job_outcomes(commands: DataFrame, late: str = "0 seconds", lease_minutes: int = LEASE_MINUTES, retry_minutes: int = RETRY_MINUTES) -> DataFrame:
    """OUTCOMES of a stream or table of COMMANDS, for append mode. Timers fire once the watermark has passed them; a table has none, as nothing follows it.

    The session's time zone has to be UTC and, for a stream, its state store STATE_STORE. Commands of a stream that are later than the watermark are dropped by Spark.
    """
    if not commands.isStreaming:
        return _of_table(commands, Rules(lease_minutes, retry_minutes))
    keyed = commands.withWatermark("at", late).groupBy("queue")
    return keyed.transformWithStateInPandas(Queue(lease_minutes, retry_minutes), OUTCOMES, "append", "eventTime")


def read_commands(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
