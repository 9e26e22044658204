"""The job queue over commands that the shared event table gives rise to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.plans.registry import register, table
from tracemill.streaming import queue as Q

_START = "2026-01-01 00:00:00"


def _commands(spark, d):
    """Each user's events as jobs of a queue, claimed by four workers in three waves; after the first one jobs end well, fail or are left, by their id."""
    events = table(spark, d, "events")
    job = F.col("event_id")
    later = lambda minutes: F.expr(f"timestamp'{_START}' + interval {minutes} minutes").alias("at")
    names = [f.split() for f in Q.COMMANDS.split(", ")]

    def rows(source, minute, seq, kind, **columns):
        given = {"queue": F.col("user_id").cast("string"), "seq": seq, "kind": kind, **columns}
        return source.select(*(later(minute) if n == "at" else given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names))

    users = events.select("user_id").distinct()
    claim = lambda minute, seq, worker, most: rows(users, minute, F.lit(seq), F.lit("claim"), worker=F.lit(worker), max_jobs=F.lit(most))
    last = 1 << 40  # after all jobs
    ends = rows(events.filter("event_id % 3 < 2"), 2, job, F.when(job % 3 == 0, "complete").otherwise("fail"), job_id=job, retryable=F.lit(True))
    out = rows(events, 0, job, F.lit("enqueue"), job_id=job, priority=job % 3).unionByName(ends)
    for part in (claim(1, last, "w1", 2), claim(1, last + 1, "w2", 2), claim(4, last, "w3", 1), claim(20, last, "w4", 1_000_000)):
        out = out.unionByName(part)
    return out


@register(
    "TQ3_job_queue",
    """WITH ranked AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
       SELECT user_id::VARCHAR AS queue, 1 AS minute, event_id::VARCHAR AS job_id, CASE WHEN r <= 2 THEN 'w1' ELSE 'w2' END AS worker, 1 AS attempts, CASE WHEN r <= 2 THEN n >= 2 ELSE n >= 4 END AS continues FROM ranked WHERE r <= 4
       UNION ALL SELECT user_id::VARCHAR, 4, event_id::VARCHAR, 'w3', 1, true FROM ranked WHERE r = 5
       UNION ALL SELECT user_id::VARCHAR, 20, event_id::VARCHAR, 'w4', CASE WHEN r <= 5 THEN 2 ELSE 1 END, false FROM ranked WHERE r > 4 OR event_id % 3 <> 0""",
)
def job_queue(spark, d):
    """What each worker won: leases that ran out and failed jobs come back at the third wave, failed ones not yet at the second."""
    won = Q.job_outcomes(_commands(spark, d)).filter("kind = 'claimed'")
    minute = ((F.unix_timestamp("at") - F.unix_timestamp(F.lit(_START).cast("timestamp"))) / 60).cast("int")
    return won.select("queue", minute.alias("minute"), "job_id", "worker", "attempts", "continues")
