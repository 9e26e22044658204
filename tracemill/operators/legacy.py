"""Single rules over a workbook's records, each a filter that makes a finding; and the three tabs of the audit's package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: findings by rule: title, status, severity, type.
RULES = {
    "entity_scope": ("Business/entity scope cannot be determined", "not_determined", "medium", "entity_scope_not_determined"),
    "product_scope": ("Product FTL scope cannot be determined", "not_determined", "medium", "product_scope_not_determined"),
    "exemption": ("Exemption claim needs evidence: ", "not_determined", "medium", "exemption_evidence_missing"),
    "assignment": ("TLC missing from event line", "gap", "high", "tlc_assignment_gap"),
    "preservation": ("TLC changed outside transformation", "conflict", "high", "tlc_preservation_conflict"),
    "lineage": ("TLC lineage gap", "gap", "high", "lineage_gap"),
}


def _finding(rows: DataFrame, rule: str, subject: Column, title: Column | None = None, status: Column | None = None, observed: Column | None = None) -> DataFrame:
    name, usual, severity, kind = RULES[rule]
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(kind).alias("finding_type"), subject.cast("string").alias("subject"), (F.lit(name) if title is None else title).alias("title"), (F.lit(usual) if status is None else status).alias("status"),
        F.lit(severity).alias("severity"), (none if observed is None else observed.cast("string")).alias("observed"),
    )


def scope_findings(profiles: DataFrame, decisions: DataFrame) -> DataFrame:
    """Businesses (profile_id, covered_entity_status, business_type) and products (product_id, status) whose scope isn't determined."""
    one = _finding(profiles.filter("covered_entity_status = 'not_determined'"), "entity_scope", F.col("profile_id"), observed=F.col("business_type"))
    return one.unionByName(_finding(decisions.filter("status = 'not_determined'"), "product_scope", F.col("product_id"), observed=F.col("product_id")))


def exemption_findings(claims: DataFrame) -> DataFrame:
    """Claims (claim_id, claim_type, evidence_provided) without evidence; null is none."""
    rows = claims.filter(~F.coalesce("evidence_provided", F.lit(False)))
    return _finding(rows, "exemption", F.col("claim_id"), F.concat(F.lit(RULES["exemption"][0]), "claim_type"), observed=F.col("claim_type"))


def lot_findings(lines: DataFrame, events: DataFrame, lineage: DataFrame) -> DataFrame:
    """Lines without any lot, lines whose lot changes though their event is no transformation, and lineage with gaps or conflicts.

    lines: line_id, event_id, lot, source_lot, output_lot; events: event_id, event_type; lineage: lineage_id, status, source_lot. Empty lots are none.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    missing = _finding(lines.filter(~has("lot") & ~has("source_lot") & ~has("output_lot")), "assignment", F.col("line_id"))
    transforming = events.filter("event_type = 'transformation'").select("event_id").distinct()
    changed = lines.filter(has("source_lot") & has("output_lot")).join(transforming, "event_id", "left_anti")
    changed = _finding(changed, "preservation", F.col("line_id"), observed=F.col("output_lot"))
    torn = lineage.filter(F.col("status").isin("gap", "conflicting"))
    torn = _finding(torn, "lineage", F.col("lineage_id"), status=F.when(F.col("status") == "conflicting", "conflict").otherwise("gap"), observed=F.col("source_lot"))
    return missing.unionByName(changed).unionByName(torn)


def summary_rows(audits: DataFrame, findings: DataFrame) -> DataFrame:
    """(audit_id, metric, value): the package's summary tab. audits: audit_id, file_name, passed; findings: audit_id, status."""
    row = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("string").alias("value"))
    total = findings.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n"))
    rows = audits.join(total, "audit_id", "left")
    gate = F.when(F.col("passed"), "passed").otherwise("blocked")
    plain = rows.select("audit_id", F.inline(F.array(row("audit_id", F.col("audit_id")), row("file_name", F.col("file_name")), row("readiness_gate", gate), row("findings", F.coalesce("n", F.lit(0))))))
    by_status = findings.groupBy("audit_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return plain.unionByName(by_status.select("audit_id", F.concat(F.lit("findings_"), "status").alias("metric"), F.col("n").cast("string").alias("value")))


def export_check_rows(events: DataFrame, documents: DataFrame) -> DataFrame:
    """The package's export tab: each event (event_id, event_type, event_datetime, reference_record_no) with whether a document (event_id, evidence_status) of it is available; missing values are empty."""
    there = documents.filter("evidence_status = 'available'").select("event_id").distinct().withColumn("_there", F.lit(True))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = events.join(there, "event_id", "left")
    return rows.select("event_id", text("event_type"), text("event_datetime"), text("reference_record_no"), F.when(F.col("_there").isNull(), "no").otherwise("yes").alias("has_source_document"))
