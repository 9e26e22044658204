"""Review, approval and release rules: ordered ladders over record columns, and the rows that they produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder(steps: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(default)
    for condition, name in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def review_status(conflict: Column, rejected: Column, ready: Column) -> Column:
    """Conflicts before rejections before readiness; never approved without a person."""
    return ladder([(conflict, "conflict"), (rejected, "rejected"), (ready, "ready_for_review")], "needs_review")


def approval_ready(confidence: Column, deterministic: Column, complete: Column, codified: Column) -> Column:
    return (confidence == "HIGH") & deterministic & complete & codified


def trace_rows(findings: DataFrame, key: str) -> DataFrame:
    """Three rows per finding: its evidence, its rule, its decision."""
    steps = F.array(*(F.struct(F.lit(n).alias("step"), F.lit(k).alias("kind")) for n, k in enumerate(("evidence", "rule", "decision"), 1)))
    return findings.select(key, F.inline(steps))


def publishable(checks: DataFrame) -> DataFrame:
    """One row: green if every check passed or was overridden with a reason."""
    bad = ~F.col("passed") & (F.coalesce(F.col("override_reason"), F.lit("")) == "")
    out = checks.agg(F.count(F.lit(1)).alias("checks"), F.count_if(bad).alias("failed"))
    return out.withColumn("gate", F.when(F.col("failed") == 0, "green").otherwise("blocked"))


def drop_or_annotate(chunks: DataFrame, text: str, codified: Column, boilerplate: Column, least: int = 40) -> DataFrame:
    """Adds fate: dropped boilerplate (never codified rules), citation_only for short text, else kept."""
    return chunks.withColumn("fate", ladder([(boilerplate & ~codified, "dropped"), (F.length(text) < least, "citation_only")], "kept"))


def finding_blockers(findings: DataFrame, cards: DataFrame, scenarios: DataFrame, requirements: DataFrame) -> DataFrame:
    """(finding_id, blocker): what keeps a finding from being shown to a customer, one row each; findings that pass or don't apply have none.

    findings: finding_id, status, card_id, chunk_id, evidence (array), review_state, requirement_id; cards: card_id, finalized; scenarios:
    status, card_ids (array); requirements: requirement_id, status. A finding without its card has that one blocker.
    """
    covered = scenarios.filter("status = 'approved'").select(F.explode("card_ids").alias("card_id")).distinct().withColumn("_covered", F.lit(True))
    known = cards.select("card_id", "finalized").dropDuplicates(["card_id"]).withColumn("_card", F.lit(True))
    approved = requirements.filter("status = 'approved'").select("requirement_id").distinct().withColumn("_required", F.lit(True))
    rows = findings.filter(~F.coalesce(F.col("status").isin("pass", "not_applicable"), F.lit(False)))
    rows = rows.join(known, "card_id", "left").join(covered, "card_id", "left").join(approved, "requirement_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacking = [
        (F.col("_covered").isNull(), "no approved scenario"),
        (blank("chunk_id"), "no source chunk"),
        (F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no evidence"),
        (blank("review_state"), "no review state"),
        (~F.coalesce(F.col("review_state") == "approved", F.lit(False)), "review not approved"),
        (~blank("requirement_id") & F.col("_required").isNull(), "no approved requirement"),
        (~F.coalesce("finalized", F.lit(False)) & ~F.coalesce(F.col("status").isin("proposed_change", "needs_expert_review"), F.lit(False)), "source not final"),
    ]
    all_of_them = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in lacking)))
    found = F.when(F.col("_card").isNull(), F.array(F.lit("no approved card"))).otherwise(all_of_them)
    return rows.select("finding_id", F.explode(found).alias("blocker"))


def auto_review(drafts: DataFrame, least: float = 0.9) -> DataFrame:
    """Review actions on mapping drafts (draft_id, confidence, questions, review_status): sure ones without questions are approved, the rest waits for a person."""
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False)) & (F.coalesce(F.size("questions"), F.lit(0)) == 0)
    return drafts.select(
        "draft_id", F.when(sure, "approve").otherwise("hold_for_review").alias("action"), F.col("review_status").alias("before_status"), F.when(sure, "approved").otherwise("needs_review").alias("after_status")
    )


def import_drafts(records: DataFrame, with_rejected: bool = True, only_ready: bool = False) -> DataFrame:
    """Rows to upsert from draft records; ids are needed, other texts default to unknown, and a record without a status is a draft. Nothing is approved by an import.

    records: draft_id, collection, record_id, source_phase, confidence, review_status, citation_count; a record without an id is an error.
    """
    text = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)).alias(c)
    needed = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"draft without {c}"))).alias(c)
    rows = records.select(
        *map(needed, ("draft_id", "collection", "record_id")), text("source_phase", "unknown"), text("confidence", "unknown"), text("review_status", "draft"), F.coalesce("citation_count", F.lit(0)).alias("citation_count")
    )
    if only_ready:
        rows = rows.filter("review_status = 'needs_review'")
    return rows if with_rejected else rows.filter("review_status <> 'rejected'")
