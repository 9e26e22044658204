"""What a user looks at first: counters over all evidence, readiness of a run, its blockers and coverage, and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evidence_summary(records: DataFrame, suggestions: DataFrame, classified: DataFrame, least_confidence: float = 0.6) -> DataFrame:
    """(metric, key, n): one aggregate for each family, none collected.

    records: any; suggestions: confidence; classified: final, suppressed (arrays of names) and questions (array).
    """
    one = lambda df, **counts: df.agg(*(c.alias(k) for k, c in counts.items())).unpivot([], list(counts), "metric", "n").select("metric", F.lit("").alias("key"), "n")
    n = F.count(F.lit(1))
    named = lambda column, metric: classified.select(F.explode(column).alias("key")).groupBy("key").agg(n.alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    some = F.coalesce(F.size("final"), F.lit(0)) > 0
    parts = [
        one(records, evidence_records=n),
        one(suggestions, field_mapping_suggestions=n, low_confidence_mappings=F.count_if(F.col("confidence") < least_confidence)),
        one(classified, event_nodes=n, classified_events=F.count_if(some), abstained_events=F.count_if(~some), review_required_events=F.count_if(F.size("questions") > 0)),
        named("final", "final_cte"),
        named("suppressed", "suppressed_cte"),
    ]
    return reduce(DataFrame.unionByName, parts)


def readiness(runs: DataFrame) -> DataFrame:
    """runs (run_id, status, readiness) with the readiness in force: the stated one, else ready for a run that succeeded, else its status."""
    fallback = F.when(F.col("status") == "succeeded", "ready").otherwise(F.col("status"))
    return runs.withColumn("readiness", F.coalesce("readiness", fallback))


def blockers(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, blocker), a row each: findings (run_id, finding_id, status) of runs in review, a note for runs without one, open findings otherwise."""
    rows = readiness(runs).join(findings.withColumnRenamed("status", "finding_status"), "run_id", "left")
    held = F.col("readiness").isin("blocked", "needs_review")
    note = F.when(F.col("status").isin("queued", "running"), F.concat(F.lit("audit run is "), "status")).when(F.col("status") == "failed", "audit run failed")
    open_finding = F.when(~F.col("finding_status").isin("pass", "not_applicable"), F.col("finding_id"))
    why = F.when(held, F.coalesce("finding_id", F.concat(F.lit("readiness status: "), "readiness"))).otherwise(F.coalesce(note, open_finding))
    return rows.select("run_id", why.alias("blocker")).filter(F.col("blocker").isNotNull()).distinct()


def coverage(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, area, status, reason): parser, rule execution and findings of every run (run_id, status, parser_version, execution_version)."""
    count = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("found"))
    rows = runs.join(count, "run_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    done, parsed = F.col("status") == "succeeded", F.col("parser_version").isNotNull()
    area = lambda name, status, reason: F.struct(F.lit(name).alias("area"), status.alias("status"), reason.alias("reason"))
    areas = F.array(
        area(
            "Parser",
            F.when(parsed, "ready").when(F.col("status") == "queued", "queued").otherwise("pending"),
            F.coalesce("parser_version", F.lit("The workbook has not been parsed.")),
        ),
        area(
            "Rule execution",
            F.when(done, "ready").otherwise(F.coalesce("status", F.lit("pending"))),
            F.coalesce("execution_version", F.lit("The approved rules have not been executed.")),
        ),
        area(
            "Findings",
            F.when(F.col("found") > 0, "review").when(done, "ready").otherwise("pending"),
            F.when(F.col("found") > 0, F.concat(F.col("found").cast("string"), F.lit(" to review"))).otherwise("No findings of this run."),
        ),
    )
    return rows.select("run_id", F.inline(areas))


def report_lines(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, line_number, line): a markdown report of each run, its findings by severity and id, as rows that a sink writes in order.

    findings: run_id, finding_id, severity (critical, high, medium, low), title. Lines are numbered by counts for each severity and a rank in it.
    """
    order = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("severity")).cast("long")
    head = runs.select("run_id", F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("part"), F.lit("").alias("id"), F.concat(F.lit("# Audit "), F.col("run_id").cast("string")).alias("line")),
        F.struct(F.lit(0).cast("long").alias("part"), F.lit("~").alias("id"), F.concat(F.lit("Status: "), "readiness").alias("line")),
    )))
    body = findings.select("run_id", order.alias("part"), F.col("finding_id").cast("string").alias("id"), F.concat(F.lit("- ["), "severity", F.lit("] "), "title").alias("line"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("part", "id"))
    return head.unionByName(body).select("run_id", place.alias("line_number"), "line")
