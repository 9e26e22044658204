"""Rule checks, classification, findings and the job queue on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import checks, classify
from tracemill.operators.relational import first_of
from tracemill.plans import cards
from tracemill.plans.registry import register, table

_TEXTS = "array<string>"
_CONTRACT = [
    (1, "priority", ["priority"], "required", "medium"),
    (2, "flag", ["flags"], "required", "medium"),
    (3, "traceability_lot_code", ["absent", "status"], "required", "high"),
    (4, "never", ["absent"], "conditional", "medium"),
    (5, "gap", ["absent"], "required", "medium"),
]


def order_events(spark, d):
    """Orders as events: their type is their status; lines give the flags; one priority is a placeholder."""
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"))
    orders = table(spark, d, "orders").join(flags, "o_orderkey", "left")
    priority = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "N/A").otherwise(F.col("o_orderpriority"))
    facts = F.create_map(
        F.lit("priority"), F.array(priority), F.lit("flags"), F.coalesce("flags", F.array().cast(_TEXTS)), F.lit("status"), F.array("o_orderstatus")
    )
    return orders.select(F.col("o_orderkey").cast("string").alias("event_id"), F.array("o_orderstatus").alias("final_ctes"), facts.alias("facts"))


def order_contract(spark):
    rows = [(cte, "s", n, kde, kde, fields, need, severity) for cte in ("O", "F", "P") for n, kde, fields, need, severity in _CONTRACT]
    return spark.createDataFrame(rows, cards.contracts(spark).schema)


_KDE = """WITH e AS (SELECT o_orderkey::VARCHAR AS event_id, o_orderstatus AS cte, o_orderpriority AS p, (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS k FROM orders),
  kde AS (SELECT event_id, cte, 1 AS ordinal, 'priority' AS field_key, CASE WHEN p = '4-NOT SPECIFIED' THEN 'missing' ELSE 'present' END AS status FROM e
    UNION ALL SELECT event_id, cte, 2, 'flag', CASE WHEN k = 0 THEN 'missing' WHEN k > 1 THEN 'conflicting' ELSE 'present' END FROM e
    UNION ALL SELECT event_id, cte, 3, 'traceability_lot_code', 'present' FROM e UNION ALL SELECT event_id, cte, 4, 'never', 'not_applicable' FROM e
    UNION ALL SELECT event_id, cte, 5, 'gap', 'missing' FROM e)"""


@register("C2_kde_completeness", _KDE + " SELECT event_id, cte, ordinal, field_key, status FROM kde")
def kde_completeness(spark, d):
    return checks.kde_checks(order_events(spark, d), order_contract(spark)).select("event_id", "cte", "ordinal", "field_key", "status")


@register(
    "C8_sortable_export",
    _KDE
    + """ SELECT event_id, cte, CASE WHEN count(*) FILTER (WHERE status IN ('missing', 'conflicting')) = 0 THEN 'ready' ELSE 'blocked' END AS status,
          coalesce(string_agg(field_key, ',' ORDER BY ordinal) FILTER (WHERE status IN ('missing', 'conflicting')), '') AS missing,
          coalesce(string_agg(field_key, ',' ORDER BY ordinal) FILTER (WHERE status = 'present'), '') AS populated FROM kde GROUP BY event_id, cte""",
)
def sortable_export(spark, d):
    found = checks.export_readiness(checks.kde_checks(order_events(spark, d), order_contract(spark)))
    return found.select("event_id", "cte", "status", F.concat_ws(",", "missing_fields").alias("missing"), F.concat_ws(",", "populated_fields").alias("populated"))


def part_events(spark, d):
    """Parts as events: brand is the lot, type the output lot for large ones, name the source lot."""
    kind = F.when(F.col("p_size") % 3 == 0, "transformation").when(F.col("p_size") % 3 == 1, "shipping").otherwise("initial_packing")
    lot = F.when(F.col("p_size") % 5 == 0, "TBD").otherwise(F.col("p_brand"))
    source = F.when(F.col("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.lit("nowhere"))
    output = F.when(F.col("p_size") > 20, F.col("p_type"))
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("event_id"), F.array(kind).alias("final_ctes"), lot.alias("lot_or_tlc"), source.alias("source_lot_or_tlc"), output.alias("output_lot_or_tlc")
    )


_LOTS = """WITH e AS (SELECT p_partkey::VARCHAR AS event_id, CASE p_size % 3 WHEN 0 THEN 'transformation' WHEN 1 THEN 'shipping' ELSE 'initial_packing' END AS cte,
    CASE WHEN p_size % 5 <> 0 THEN p_brand END AS lot, CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE 'nowhere' END AS source, CASE WHEN p_size > 20 THEN p_type END AS output FROM part),
  known AS (SELECT lower(lot) AS k FROM e WHERE lot IS NOT NULL UNION SELECT lower(output) FROM e WHERE output IS NOT NULL),
  found AS (SELECT event_id, cte, CASE WHEN cte = 'transformation' AND (output IS NULL OR source IS NULL) THEN 'source_or_output_lot_missing'
    WHEN cte = 'transformation' AND lower(source) NOT IN (SELECT k FROM known) THEN 'source_lot_not_upstream'
    WHEN cte = 'initial_packing' AND lot IS NULL AND output IS NULL THEN 'lot_not_assigned' WHEN cte = 'shipping' AND lot IS NULL THEN 'lot_missing' ELSE 'linked' END AS reason FROM e)"""


@register("C3_lot_lineage", _LOTS + " SELECT event_id, cte, CASE WHEN reason = 'linked' THEN 'linked' ELSE 'gap' END AS status, reason FROM found")
def lot_lineage(spark, d):
    return checks.lot_checks(part_events(spark, d))


@register(
    "C4_traceability_plan",
    """WITH parts(ordinal, component, term, farm) AS (VALUES (1, 'nations_a', 'nation_1', false), (2, 'farm_map', 'nation_2', true), (3, 'absent', 'no such', false))
       SELECT ordinal, component, CASE WHEN farm THEN 'not_applicable' WHEN EXISTS (SELECT 1 FROM nation WHERE contains(lower(n_name), term)) THEN 'present' ELSE 'missing' END AS status FROM parts""",
)
def plan(spark, d):
    parts = spark.createDataFrame([(1, "nations_a", ["nation_1"], False), (2, "farm_map", ["nation_2"], True), (3, "absent", ["no such"], False)], cards.plan_parts(spark).schema)
    answers = table(spark, d, "nation").select(F.col("n_name").alias("item"), F.lit("documented").alias("answer"))
    return checks.plan_checks(answers, parts, False)


@register(
    "C6_exemption_claims",
    """SELECT c_custkey::VARCHAR AS claim_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'small_producer' WHEN 'MACHINERY' THEN 'transporter' END AS exemption_type,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 2 = 0 THEN 'not_determined' ELSE 'needs_review' END AS status FROM customer""",
)
def exemption_claims(spark, d):
    claim = F.when(F.col("c_mktsegment") == "BUILDING", "Small_Producer").when(F.col("c_mktsegment") == "MACHINERY", "our carrier only").otherwise("moon dust")
    claims = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("claim_id"), claim.alias("claim_type"), F.when(F.col("c_custkey") % 2 == 1, "yes").otherwise("").alias("evidence"))
    return checks.exemption_checks(claims, cards.exemptions(spark))


_FINDINGS = (
    _KDE
    + """, g AS (SELECT event_id, string_agg(field_key, ',' ORDER BY ordinal) AS fields FROM kde WHERE status NOT IN ('present', 'not_applicable') GROUP BY event_id),
    lots AS (SELECT o_orderkey::VARCHAR AS event_id FROM orders WHERE o_orderstatus = 'P')"""
)


@register(
    "C9_record_findings",
    _FINDINGS
    + """ SELECT g.event_id, CASE WHEN l.event_id IS NULL THEN 'kde_completeness' ELSE 'tlc_lineage' END AS finding_type, CASE WHEN l.event_id IS NULL THEN 'medium' ELSE 'high' END AS severity,
          fields FROM g LEFT JOIN lots l ON l.event_id = g.event_id""",
)
def record_findings(spark, d):
    found = findings(spark, d)
    return found.select("event_id", "finding_type", "severity", F.concat_ws(",", "fields").alias("fields"))


def findings(spark, d):
    kde = checks.kde_checks(order_events(spark, d), order_contract(spark))
    lots = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    lots = lots.select(F.col("o_orderkey").cast("string").alias("event_id"), F.lit("P").alias("cte"), F.lit("gap").alias("status"), F.lit("lot_missing").alias("reason"))
    return checks.record_findings(kde, lots)


@register(
    "C10_exception_queue",
    """SELECT 'exception-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS exception_id, event_id, queue_type, priority FROM (
       SELECT o_orderkey::VARCHAR AS event_id, CASE WHEN o_orderstatus = 'P' THEN 'tlc_gap' ELSE 'missing_kde' END AS queue_type,
         CASE WHEN o_orderstatus = 'P' THEN 'high' ELSE 'medium' END AS priority, row_number() OVER (ORDER BY o_orderkey::VARCHAR) AS n FROM orders)""",
)
def exception_queue(spark, d):
    return checks.exception_queue(findings(spark, d), "run-1").select("exception_id", "event_id", "queue_type", "priority")


@register("C12_readiness", "SELECT CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'blocked' ELSE 'needs_review' END AS status, count(*) AS findings FROM orders")
def readiness(spark, d):
    return checks.readiness(findings(spark, d))


@register(
    "C14_normalized_entities",
    """SELECT 'customer' AS kind, c_custkey AS id, 'n' || c_nationkey AS place FROM customer UNION ALL SELECT 'supplier', s_suppkey, 'n' || s_nationkey FROM supplier""",
)
def entities(spark, d):
    side = lambda t, kind, key, nation: table(spark, d, t).select(
        F.lit(kind).alias("kind"), F.col(key).alias("id"), F.concat(F.lit("n"), F.col(nation).cast("string")).alias("place")
    )
    return side("customer", "customer", "c_custkey", "c_nationkey").unionByName(side("supplier", "supplier", "s_suppkey", "s_nationkey"))


@register(
    "B1_classify_events",
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'shipping' ELSE '' END WHEN 'click' THEN 'transformation' ELSE '' END AS final,
       CASE event_type WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN '' ELSE 'shipping' END ELSE '' END AS suppressed FROM events""",
)
def classify_events(spark, d):
    """Purchases ship, half of them to consumers; clicks transform with both lots; the rest carries no signal."""
    buys, clicks = F.col("event_type") == "purchase", F.col("event_type") == "click"
    text = lambda c, v: F.when(c, F.lit(v))
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(buys, "shipping").when(clicks, "transformation").alias("event_type_claim"),
        F.lit(None).cast("string").alias("document_type"),
        F.when(buys, "shipper").when(clicks, "processor").alias("actor_role"),
        F.lit(0.9).alias("actor_confidence"),
        F.lit("x").alias("product_name"),
        F.lit(None).cast("string").alias("from_partner_id"),
        F.lit(None).cast("string").alias("to_partner_id"),
        F.when(buys, F.when(F.col("user_id") % 2 == 0, "Regional distributor").otherwise("direct to consumer")).alias("destination_type"),
        text(buys | clicks, "TLC-1").alias("lot_or_tlc"),
        text(clicks, "S-1").alias("source_lot_or_tlc"),
        text(clicks, "O-1").alias("output_lot_or_tlc"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_datetime"),
        F.array("event_type").alias("action_terms"),
        F.lit(True).alias("remains_listed"),
        F.lit(False).alias("review_required"),
        F.array().cast(_TEXTS).alias("conflict_fields"),
    )
    out = classify.classify(rows)
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.concat_ws(",", "final_ctes").alias("final"), F.concat_ws(",", "suppressed_ctes").alias("suppressed"))


@register(
    "TQ1_claim_next_job",
    """SELECT o_custkey AS worker, o_orderkey AS job FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1998-01-01'
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) = 1""",
)
def claim_next(spark, d):
    open_jobs = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp")))
    first = first_of(open_jobs, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")])
    return first.select(F.col("o_custkey").alias("worker"), F.col("o_orderkey").alias("job"))


@register(
    "TQ2_retry_state",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN user_id % 4 < 3 THEN 'retryable' ELSE 'failed' END AS status,
       CASE WHEN event_type = 'error' AND user_id % 4 < 3 THEN ts + INTERVAL 5 MINUTE END AS available_at FROM events""",
)
def retry_state(spark, d):
    failed = F.col("event_type") == "error"
    again = failed & (F.col("user_id") % 4 < 3)
    later = F.when(again, F.col("ts") + F.expr("interval 5 minutes"))
    return table(spark, d, "events").select("event_id", F.when(~failed, "done").when(again, "retryable").otherwise("failed").alias("status"), later.alias("available_at"))


@register("TQ4_current_status", "SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS status, count(*) AS changes FROM events GROUP BY user_id")
def current_status(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("changes"))


@register(
    "TQ4_latest_events",
    "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 25",
)
def latest_events(spark, d):
    window = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = table(spark, d, "events").withColumn("n", F.row_number().over(window))
    return ranked.filter("n <= 25").select("user_id", "event_id")  # the last 25 of each job is the feature
