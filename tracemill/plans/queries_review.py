"""Header bands, scope, review, release and corpus-building operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import checks, evidence, review
from tracemill.plans.registry import register, table


def customer_sheets(spark, d):
    """A sheet for each nation: a title, a header band, its customers, a note and the header again."""
    customers = table(spark, d, "customer").select(
        F.lit("f").alias("file"), F.col("c_nationkey").cast("string").alias("sheet"), F.col("c_custkey"), F.array("c_mktsegment", F.col("c_custkey").cast("string")).alias("cells")
    )
    n = F.row_number().over(Window.partitionBy("sheet").orderBy("c_custkey"))
    body = customers.select("file", "sheet", (n + 2).cast("int").alias("row_number"), "cells")
    last = body.groupBy("file", "sheet").agg(F.max("row_number").alias("last"))
    extra = lambda at, *cells: F.struct(at.cast("int").alias("row_number"), F.array(*(F.lit(c).cast("string") for c in cells)).alias("cells"))
    rows = F.array(
        extra(F.lit(1), "Customer report", None), extra(F.lit(2), "Product", "Lot #"), extra(F.col("last") + 1, "Notes: checked", None), extra(F.col("last") + 2, "Product", "Lot #")
    )
    return body.unionByName(last.select("file", "sheet", F.inline(rows)))


@register("P1_header_detection", "SELECT DISTINCT 'f' AS file, c_nationkey::VARCHAR AS sheet, 2 AS header_row FROM customer")
def header_detection(spark, d):
    return evidence.detect_header(customer_sheets(spark, d))


@register("P2_header_build", "SELECT DISTINCT c_nationkey::VARCHAR AS sheet, 'Product,Lot #' AS headers FROM customer")
def header_build(spark, d):
    rows = customer_sheets(spark, d)
    return evidence.build_headers(rows, evidence.detect_header(rows)).select("sheet", F.concat_ws(",", "headers").alias("headers"))


@register("P3_noise_rows", "SELECT c_nationkey::VARCHAR AS sheet, count(*) + 1 AS kept FROM customer GROUP BY 1")
def noise_rows(spark, d):
    headers = F.array(F.lit("Product"), F.lit("Lot #"))
    kept = customer_sheets(spark, d).filter(~evidence.is_noise(F.col("cells"), headers))
    return kept.groupBy("sheet").agg(F.count(F.lit(1)).alias("kept"))


@register(
    "C1_obligation_mapping",
    "SELECT o_orderkey::VARCHAR AS event_id, CASE o_orderstatus WHEN 'O' THEN 'shipping' ELSE 'receiving' END AS cte, CASE o_orderstatus WHEN 'O' THEN 'OB-1' ELSE 'OB-2' END AS obligation_id FROM orders WHERE o_orderstatus <> 'P'",
)
def obligations(spark, d):
    cards = [("OB-1", ["shipping", "other"], "21 CFR 1.1340(a)"), ("OB-2", ["receiving"], "21 CFR 1.1345"), ("OB-3", ["shipping"], "21 CFR 1.1315")]
    wanted = spark.createDataFrame(cards, "obligation_id string, applies_to array<string>, section string")
    kind = F.when(F.col("o_orderstatus") == "O", "shipping").when(F.col("o_orderstatus") == "F", "receiving")
    events = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), F.array_compact(F.array(kind)).alias("final_ctes"))
    return checks.map_obligations(events, wanted)


@register("C13_trace_rows", "SELECT o_orderkey, step, kind FROM orders, (VALUES (1, 'evidence'), (2, 'rule'), (3, 'decision')) t(step, kind) WHERE o_orderstatus = 'P'")
def trace_rows(spark, d):
    return review.trace_rows(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey")


@register(
    "C16_finding_gate",
    """WITH f AS (SELECT *, 'K' || p_partkey % 4 AS card FROM part WHERE p_size % 6 <> 0)
       SELECT p_partkey::VARCHAR AS finding_id, 'no approved card' AS blocker FROM f WHERE card = 'K3'
       UNION ALL SELECT p_partkey::VARCHAR, b FROM (SELECT *, unnest([CASE WHEN card <> 'K0' THEN 'no approved scenario' END, CASE WHEN p_size % 5 = 0 THEN 'no source chunk' END, CASE WHEN p_size > 40 THEN 'no evidence' END,
         CASE WHEN p_size % 7 = 0 THEN 'no review state' END, CASE WHEN p_size % 7 <= 1 THEN 'review not approved' END, CASE WHEN p_size % 9 = 0 THEN 'no approved requirement' END, CASE WHEN card = 'K1' THEN 'source not final' END]) AS b
         FROM f WHERE card <> 'K3') WHERE b IS NOT NULL""",
)
def finding_gate(spark, d):
    """Parts as findings of four cards, of which one is unknown, one isn't final and one is covered by an approved scenario."""
    size = F.col("p_size")
    seventh = size % 7
    findings = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("finding_id"),
        F.when(size % 6 == 0, "pass").otherwise("fail").alias("status"),
        F.concat(F.lit("K"), (F.col("p_partkey") % 4).cast("string")).alias("card_id"),
        F.when(size % 5 == 0, "").otherwise("chunk").alias("chunk_id"),
        F.when(size > 40, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("evidence"),
        F.when(seventh == 1, "draft").when(seventh > 1, "approved").alias("review_state"),
        F.when(size % 9 == 0, "R2").when(size % 9 == 1, "R1").alias("requirement_id"),
    )
    cards = spark.createDataFrame([("K0", True), ("K1", False), ("K2", True)], "card_id string, finalized boolean")
    scenarios = spark.createDataFrame([("approved", ["K0"]), ("draft", ["K1", "K2"])], "status string, card_ids array<string>")
    requirements = spark.createDataFrame([("R1", "approved"), ("R2", "draft")], "requirement_id string, status string")
    return review.finding_blockers(findings, cards, scenarios, requirements)


@register(
    "C18_review_status",
    "SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'conflict' WHEN p_size % 5 = 0 THEN 'rejected' WHEN p_size > 25 THEN 'ready_for_review' ELSE 'needs_review' END AS status FROM part",
)
def review_status(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", review.review_status(size % 11 == 0, size % 5 == 0, size > 25).alias("status"))


@register("C19_approval_ready", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_type <> 'PROMO' AND p_name IS NOT NULL AND p_partkey % 2 = 0")
def approval_ready(spark, d):
    confidence = F.when(F.col("p_size") > 40, "HIGH").otherwise("LOW")
    ready = review.approval_ready(confidence, F.col("p_type") != "PROMO", F.col("p_name").isNotNull(), F.col("p_partkey") % 2 == 0)
    return table(spark, d, "part").filter(ready).select("p_partkey")


@register(
    "C21_publish_gate",
    """SELECT count(*) AS checks, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 9 <> 0) AS failed,
       CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 9 <> 0) = 0 THEN 'green' ELSE 'blocked' END AS gate FROM orders""",
)
def publish_gate(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderstatus") != "P").alias("passed"), F.when(F.col("o_orderkey") % 9 == 0, "accepted").alias("override_reason"))
    return review.publishable(rows)


@register(
    "C24_mapping_auto_review",
    """SELECT p_partkey AS draft_id, CASE WHEN p_size >= 45 AND p_type <> 'PROMO' THEN 'approve' ELSE 'hold_for_review' END AS action, 'draft' AS before_status,
       CASE WHEN p_size >= 45 AND p_type <> 'PROMO' THEN 'approved' ELSE 'needs_review' END AS after_status FROM part""",
)
def auto_review(spark, d):
    questions = F.array_compact(F.array(F.when(F.col("p_type") == "PROMO", F.lit("which type?"))))
    drafts = table(spark, d, "part").select(F.col("p_partkey").alias("draft_id"), (F.col("p_size") / 50).alias("confidence"), questions.alias("questions"), F.lit("draft").alias("review_status"))
    return review.auto_review(drafts)


@register("X11_drop_or_annotate", "SELECT doc_id, CASE WHEN contains(lower(text), '!!') AND source <> 'src1' THEN 'dropped' WHEN length(text) < 40 THEN 'citation_only' ELSE 'kept' END AS fate FROM documents")
def drop_or_annotate(spark, d):
    docs = table(spark, d, "documents")
    return review.drop_or_annotate(docs, "text", F.col("source") == "src1", F.contains(F.lower("text"), F.lit("!!"))).select("doc_id", "fate")


@register(
    "X24_draft_import",
    """SELECT o_orderkey::VARCHAR AS draft_id, o_orderpriority AS collection, 'r' || o_orderkey AS record_id, 'unknown' AS source_phase, 'unknown' AS confidence,
       CASE o_orderstatus WHEN 'F' THEN 'needs_review' ELSE 'draft' END AS review_status, 0::BIGINT AS citation_count FROM orders WHERE o_orderstatus <> 'P'""",
)
def draft_import(spark, d):
    """Orders as draft records; those that are pending were rejected and stay out."""
    state = F.when(F.col("o_orderstatus") == "F", "needs_review").when(F.col("o_orderstatus") == "P", "rejected").otherwise(" ")
    key = F.col("o_orderkey").cast("string")
    records = table(spark, d, "orders").select(
        key.alias("draft_id"), F.col("o_orderpriority").alias("collection"), F.concat(F.lit("r"), key).alias("record_id"), F.lit("").alias("source_phase"), F.lit(None).cast("string").alias("confidence"),
        state.alias("review_status"), F.lit(None).cast("long").alias("citation_count"),
    )
    return review.import_drafts(records, with_rejected=False)


@register("K4_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def upsert(spark, d):
    from tracemill.sources.sinks import upserted

    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = old.filter("o_orderkey % 4 = 0").withColumn("status", F.lit("new"))
    return upserted(old, new, ["o_orderkey"])
