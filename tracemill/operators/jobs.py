"""Chained jobs of the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def follow_ups(jobs: DataFrame, after: str = "parse_customer_workbook", then: str = "execute_approved_rules", usual: int = 100, later: int = 10) -> DataFrame:
    """Jobs to queue: a rule execution after each parse that succeeded and names a rule package, at a later place in the queue.

    jobs: job_id, run_id, job_type, status, priority, package_id, previous_job_id. A parse that a queued job already follows makes none, so a
    micro-batch that runs again (foreachBatch) adds nothing. A null or zero priority counts as the usual one.
    """
    done = jobs.filter((F.col("job_type") == after) & (F.col("status") == "succeeded") & (F.coalesce("package_id", F.lit("")) != ""))
    queued = jobs.filter(F.col("job_type") == then).select(F.col("previous_job_id").alias("job_id")).distinct()
    priority = F.coalesce(F.nullif("priority", F.lit(0)), F.lit(usual)) + later
    return done.join(queued, "job_id", "left_anti").select(
        F.concat_ws(":", F.lit(then), F.col("job_id").cast("string")).alias("job_id"), "run_id", F.lit(then).alias("job_type"), F.lit("queued").alias("status"),
        priority.alias("priority"), "package_id", F.col("job_id").alias("previous_job_id"),
    )
