"""Stored rows of evidence, questions, exports, profiles and packages over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import normalized as N
from tracemill.operators import profiles as P
from tracemill.plans.registry import register, table

_TEXTS = "array<string>"


def _id(prefix, *parts):
    """SQL: prefix and 24 hexadecimal digits of the parts joined by bars."""
    return f"'{prefix}' || left(sha256('run|' || " + " || '|' || ".join(parts) + "), 24)"


def lots():
    key = F.col("event_id")
    name = lambda tag, n: F.concat(F.lit(tag), n.cast("string"))
    own = F.when(key % 5 > 0, name("L", key % 40))
    source = F.when(key % 3 == 0, name("L", (key + 7) % 40)).otherwise("")
    output = F.when(key % 6 == 0, name("L", (key + 11) % 60))
    return own.alias("lot_or_tlc"), source.alias("source_lot_or_tlc"), output.alias("output_lot_or_tlc")


_LOTS = """SELECT *, CASE WHEN event_id % 5 > 0 THEN 'L' || event_id % 40 END AS own, CASE WHEN event_id % 3 = 0 THEN 'L' || (event_id + 7) % 40 END AS source, CASE WHEN event_id % 6 = 0 THEN 'L' || (event_id + 11) % 60 END AS output,
  'nev_' || left(sha256('run|' || event_id), 24) AS nid FROM events"""


def graph(spark, d):
    """Every event with its lots, an actor, questions, and doubts about its food's form and its actor's role."""
    key = F.col("event_id")
    asked = F.array_compact(F.array(F.when(key % 11 == 0, "Is this a shipment?"), F.when(key % 22 == 0, "Which lot was it?"))).cast(_TEXTS)
    ids = F.array(F.concat(F.lit("c"), key.cast("string")), F.concat(F.lit("d"), (key % 9).cast("string")))
    none = F.lit(None).cast("string")
    return table(spark, d, "events").select(
        key.cast("string").alias("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor_id"), F.concat(F.lit("p"), (key % 30).cast("string")).alias("product_id"), *lots(),
        none.alias("from_partner_id"), F.concat(F.lit("u"), (key % 17).cast("string")).alias("to_partner_id"), ((key % 100) / 100).alias("confidence"), asked.alias("reviewer_questions"), ids.alias("evidence_ids"),
        (key % 13 == 0).alias("form_review"), F.when(key % 26 == 0, "Form is unlisted.").alias("form_reason"), ((key % 7) / 8).alias("role_confidence"),
    )


def objects(spark, d):
    """Actors, counterparties, lots and products that events name; some lots are named in no object."""
    events = table(spark, d, "events")
    kind = lambda name, key, where="true": events.filter(where).select(F.lit(name).alias("object_type"), key.alias("entity_id"))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = kind("actor", user).unionByName(kind("counterparty", user, "user_id % 2 = 0"))
    rows = rows.unionByName(kind("lot", F.concat(F.lit("L"), (F.col("event_id") % 35).cast("string")))).unionByName(kind("product", F.concat(F.lit("p"), (F.col("event_id") % 20).cast("string"))))
    rows = rows.distinct().withColumns({"name": F.concat(F.lit(" The  "), "entity_id"), "confidence": F.lit(0.9), "ordinal": F.lit(1)})
    return N.business_objects(rows, "run")


_OBJECTS = """SELECT DISTINCT 'actor' AS t, 'u' || user_id AS k FROM events UNION SELECT 'counterparty', 'u' || user_id FROM events WHERE user_id % 2 = 0 UNION SELECT 'lot', 'L' || event_id % 35 FROM events UNION SELECT 'product', 'p' || event_id % 20 FROM events"""


@register("C14_business_objects", f"SELECT {_id('nbo_', 't', 'k')} AS id, t AS object_type, k AS object_key, 'the ' || lower(k) AS normalized_name FROM ({_OBJECTS})")
def business_objects(spark, d):
    return objects(spark, d).select("id", "object_type", "object_key", "normalized_name")


def _object_sql(kind, key):
    return f"CASE WHEN EXISTS (SELECT 1 FROM ({_OBJECTS}) o WHERE o.t = '{kind}' AND o.k = {key}) THEN {_id('nbo_', repr(kind), key)} END"


@register(
    "C14_event_rows",
    f"""SELECT event_id::VARCHAR AS event_id, nid AS id, {_object_sql('actor', "'u' || user_id")} AS actor_object_id, {_object_sql('lot', 'own')} AS lot_object_id, {_object_sql('lot', 'output')} AS output_lot_object_id,
          {_object_sql('counterparty', "'u' || event_id % 17")} AS to_object_id, CASE WHEN event_id % 100 < 75 OR event_id % 11 = 0 THEN 'needs_review' ELSE 'unreviewed' END AS review_status FROM ({_LOTS})""",
)
def event_rows(spark, d):
    rows = N.event_rows(graph(spark, d), objects(spark, d), "run")
    return rows.select("event_id", "id", "actor_object_id", "lot_object_id", "output_lot_object_id", "to_object_id", "review_status")


def with_ids(spark, d):
    from tracemill.functions.scalars import row_hash_id

    return graph(spark, d).withColumn("id", row_hash_id("nev_", F.lit("run"), "event_id"))


@register(
    "C14_lot_links",
    """SELECT 'tlc_' || left(sha256('run|' || event_id || '|' || CASE WHEN flows THEN 'input_output' ELSE 'event_lot' END), 24) AS id, nid AS normalized_event_id, CASE WHEN flows THEN source ELSE own END AS source_tlc, coalesce(output, own) AS output_tlc,
         CASE WHEN source IS NOT NULL AND output IS NOT NULL THEN 0.85 WHEN flows THEN 0.65 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN flows AND (source IS NULL OR output IS NULL) THEN 'needs_review' ELSE 'unreviewed' END AS review_status
       FROM (SELECT *, source IS NOT NULL OR output IS NOT NULL AS flows FROM ("""
    + _LOTS
    + ")) WHERE flows OR own IS NOT NULL",
)
def lot_links(spark, d):
    return N.lot_links(with_ids(spark, d), "run").select("id", "normalized_event_id", "source_tlc", "output_tlc", "confidence", "review_status")


@register("C14_evidence_links", f"SELECT nid AS normalized_event_id, unnest(['c' || event_id, 'd' || event_id % 9]) AS evidence_item_id, 'source_cell' AS role FROM ({_LOTS})")
def evidence_links(spark, d):
    return N.evidence_links(with_ids(spark, d))


def torn(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("n"))
    return rows.filter("n > 1").select(F.col("p_brand").alias("conflict_id"), F.concat(F.lit("type of "), "p_brand").alias("field_key"), F.lit("high").alias("severity"))


@register(
    "C14_review_items",
    f"""WITH e AS (SELECT event_id, nid, unnest(list_filter([CASE WHEN event_id % 11 = 0 THEN struct_pack(t := 'event_ambiguity', q := 'Is this a shipment?', k := 'Is this a shipment?') END, CASE WHEN event_id % 22 = 0 THEN struct_pack(t := 'event_ambiguity', q := 'Which lot was it?', k := 'Which lot was it?') END,
            CASE WHEN event_id % 13 = 0 THEN struct_pack(t := 'food_form_review', q := '{N.FORM_QUESTION}', k := 'food_form') END, CASE WHEN event_id % 7 < 6 THEN struct_pack(t := 'actor_role_review', q := '{N.ROLE_QUESTION}', k := 'actor_role') END], lambda x: x IS NOT NULL)) AS i FROM ({_LOTS}))
        SELECT 'nri_' || left(sha256('run|' || event_id || '|' || i.k), 24) AS id, nid AS normalized_event_id, i.t AS review_type, i.q AS question, 'medium' AS severity FROM e
        UNION ALL SELECT 'nri_' || left(sha256('run|conflict|' || p_brand), 24), NULL, 'evidence_conflict', 'Resolve conflicting values for type of ' || p_brand || '.', 'high' FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""",
)
def review_items(spark, d):
    return N.review_items(with_ids(spark, d), torn(spark, d), "run")


def records(spark, d):
    """A record for each line: its confidence and its place."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    sure = F.when(F.col("l_orderkey") % 97 == 0, None).otherwise((F.col("l_partkey") % 101) / 100)
    return table(spark, d, "lineitem").select(F.format_string("%012d-%d", key, F.col("l_partkey")).alias("evidence_id"), sure.alias("confidence"), "l_orderkey", "l_linenumber")


_RECORDS = "SELECT lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 12, '0') || '-' || l_partkey AS evidence_id, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE (l_partkey % 101) / 100.0 END AS confidence FROM lineitem"


@register(
    "P6_confidence_filters",
    f"SELECT CASE WHEN coalesce(confidence, 0) < 0.5 THEN 'asked' WHEN confidence < 0.6 THEN 'unmapped' WHEN confidence < 0.8 THEN 'low' ELSE 'sure' END AS band, CASE WHEN confidence < 0.75 THEN 'needs_review' ELSE 'unreviewed' END AS review, count(*) AS n FROM ({_RECORDS}) GROUP BY 1, 2",
)
def confidence_filters(spark, d):
    rows = records(spark, d)
    return rows.groupBy(N.confidence_band(F.col("confidence")).alias("band"), N.review_status(F.col("confidence")).alias("review")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "P8_event_rows",
    "SELECT o_orderkey, (o_orderkey % 5 IN (0, 1, 2)) AND (o_orderkey % 5 IN (0, 1) OR o_orderkey % 3 = 0) AS event FROM orders",
)
def p8_event_rows(spark, d):
    key = F.col("o_orderkey")
    names = F.array_compact(F.array(F.when(key % 5 < 2, "traceability_lot_code"), F.when(key % 5 == 2, "event_type"), F.when(key % 3 == 0, "product_name"), F.lit("quantity"), F.when(key % 5 == 3, "note")))
    return table(spark, d, "orders").select("o_orderkey", N.is_event(F.map_from_arrays(names, F.transform(names, lambda n: F.upper(n)))).alias("event"))


@register(
    "X26_reviewer_questions",
    f"""SELECT 1 AS ordinal, event_id::VARCHAR AS event_id, 'Is this a shipment?' AS question, (event_id % 100) / 100.0 AS confidence, 2 AS evidence FROM events WHERE event_id % 11 = 0
        UNION ALL SELECT 2, event_id::VARCHAR, 'Which lot was it?', (event_id % 100) / 100.0, 2 FROM events WHERE event_id % 22 = 0
        UNION ALL SELECT 1, NULL, '{N.UNMAPPED}', 0.45, least(50, count(*))::INTEGER FROM ({_RECORDS}) WHERE coalesce(confidence, 0) < 0.5 HAVING count(*) > 0""",
)
def reviewer_questions(spark, d):
    found = N.reviewer_questions(graph(spark, d), records(spark, d))
    return found.select("ordinal", "event_id", "question", "confidence", F.size("evidence_ids").alias("evidence"))


@register(
    "X30_finding_messages",
    """WITH f AS (SELECT l_orderkey, list_sort(list_distinct(list('f' || l_linenumber))) AS missing, bool_or(l_linenumber = 1) AS lot FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), n AS (SELECT *, len(list_filter(missing, lambda x: x <> 'f1')) AS others FROM f)
       SELECT l_orderkey, CASE WHEN lot THEN 'Shipping is missing its Traceability Lot Code (TLC)' || CASE WHEN others > 0 THEN ' and ' || others || ' other required field' || CASE WHEN others = 1 THEN '' ELSE 's' END ELSE '' END || '.'
         WHEN len(missing) = 1 THEN 'Shipping is missing a required field: ' || missing[1] || '.' ELSE 'Shipping is missing ' || len(missing) || ' required fields.' END AS message,
         array_to_string(list_concat(list_transform(missing, lambda x: 'Missing ' || x), CASE WHEN list_contains(missing, 'f2') THEN ['no source lot'] ELSE ['no source lot', 'Lot is open'] END), '; ') AS issues FROM n""",
)
def finding_messages(spark, d):
    field = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(field)).alias("missing"))  # an order's own lines
    reasons = F.when(F.array_contains("missing", "f2"), F.array(F.lit("Missing f2"), F.lit("no source lot"))).otherwise(F.array(F.lit("no source lot"), F.lit("Lot is open")))
    text = N.gap_message(F.lit("Shipping"), F.col("missing"), ["f1"], F.array_contains("missing", "f1"))
    return rows.select("l_orderkey", text.alias("message"), F.array_join(N.sub_issues(F.col("missing"), reasons), "; ").alias("issues"))


@register(
    "C5_scope_uncertainty",
    """SELECT event_id::VARCHAR AS event_id, 'scope_or_exemption_uncertainty' AS check_type, CASE WHEN event_id % 26 = 0 THEN 'Form is unlisted.' WHEN event_id % 13 = 0 THEN 'Food form requires review.' ELSE 'Is this a shipment?' END AS reason FROM events WHERE event_id % 13 = 0 OR event_id % 11 = 0
       UNION ALL SELECT NULL, 'customer_evidence_quality_gate', 'Customer evidence quality gate is needs_review.'
       UNION ALL SELECT NULL, 'evidence_conflicts', 'Customer evidence conflicts must be resolved before final execution.' WHERE EXISTS (SELECT 1 FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1)""",
)
def scope_checks(spark, d):
    return N.scope_checks(graph(spark, d), torn(spark, d), "needs_review")


@register(
    "C7_records_readiness",
    """SELECT unnest(['legible_linked_records', 'fda_24_hour_response_readiness', 'sortable_export_source_data']) AS check_type,
         unnest([CASE WHEN (SELECT count(*) FROM lineitem) > 0 AND NOT EXISTS (SELECT 1 FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1) THEN 'present' ELSE 'needs_review' END, 'present', CASE WHEN (SELECT count(*) FROM events) > 0 THEN 'present' ELSE 'missing' END]) AS status""",
)
def records_readiness(spark, d):
    return N.records_readiness(records(spark, d), graph(spark, d), torn(spark, d), "pass")


@register(
    "C11_export_tabs",
    """WITH c AS (SELECT l_orderkey % 3 AS t, l_orderkey, 'f' || l_linenumber AS f, max(CASE WHEN l_returnflag <> 'R' THEN l_shipdate::DATE::VARCHAR END) AS v FROM lineitem GROUP BY 1, 2, 3),
         s AS (SELECT l_orderkey, string_agg(f, ', ' ORDER BY f) FILTER (WHERE v IS NULL) AS missing, count(*) AS n FROM c GROUP BY l_orderkey)
       SELECT ['receiving', 'shipping', 'transformation'][o_orderkey % 3 + 1] AS cte, o_orderkey AS event_id, (2 + coalesce(n, 0))::INTEGER AS columns, CASE WHEN missing IS NOT NULL THEN 'Sortable export blocked by missing fields: ' || missing || '.' END AS message FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""",
)
def export_tabs(spark, d):
    """A tab's row for each order with a column for each of its lines; lines that were returned have no value."""
    name = lambda key: F.get(F.array(F.lit("receiving"), F.lit("shipping"), F.lit("transformation")), (F.col(key) % 3).cast("int"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.array(name("o_orderkey")).alias("final_ctes"), F.col("o_orderpriority").alias("product_name"), F.col("o_orderstatus").alias("traceability_lot_code"))
    value = F.when(F.col("l_returnflag") != "R", F.array(F.col("l_shipdate").cast("date").cast("string"))).otherwise(F.array().cast(_TEXTS))
    checks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), name("l_orderkey").alias("cte"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"), value.alias("observed_values"))
    rows = N.export_rows(events, checks)
    told = N.export_blockers(rows).select("event_id", "cte", "message")
    return rows.join(told, ["event_id", "cte"], "left").select("cte", "event_id", F.size("values").alias("columns"), "message")


@register(
    "X28_mapping_drafts",
    f"""WITH firsts AS (SELECT p_type, p_brand, p_name, min(p_partkey) AS place FROM part WHERE p_size > 2 GROUP BY ALL), ten AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY place, p_name) <= 10)
        SELECT s.p_type AS source_sheet, s.p_brand AS source_column, (max_size / 50.0)::DOUBLE AS confidence, coalesce((SELECT string_agg(p_name, ',' ORDER BY place, p_name) FROM ten t WHERE t.p_type = s.p_type AND t.p_brand = s.p_brand), '') AS examples,
          CASE WHEN max_size / 50.0 < 0.8 THEN '{P.CONFIRM}' ELSE '' END AS question, CASE WHEN max_size % 2 = 0 THEN 'deterministic_header_mapping_draft' ELSE 'ai_assisted_mapping_draft' END AS extraction_method
        FROM (SELECT p_type, p_brand, max(p_size) AS max_size FROM part GROUP BY ALL) s""",
)
def mapping_drafts(spark, d):
    part = table(spark, d, "part")
    size = F.max("p_size")
    suggestions = part.groupBy(F.col("p_type").alias("source_sheet"), F.col("p_brand").alias("source_column")).agg((size / 50).alias("confidence"), F.when(size % 2 == 0, "spreadsheet_header").otherwise("inferred").alias("method"))
    values = part.select(F.col("p_type").alias("source_sheet"), F.col("p_brand").alias("source_column"), F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") > 2, F.col("p_name")).alias("normalized_value"))
    drafts = P.mapping_drafts(suggestions.withColumn("field_key", F.lower("source_column")), values)
    joined = lambda c: F.array_join(c, ",")
    return drafts.select("source_sheet", "source_column", "confidence", joined("examples").alias("examples"), joined("reviewer_questions").alias("question"), "extraction_method")


@register(
    "X29_profile_hash",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
         m AS (SELECT o_custkey, string_agg('{"canonical_field": "' || lower(o_orderpriority) || '", "confidence_floor": 0.5, "draft_id": ' || o_orderkey || ', "evidence_ids": ["e' || o_orderkey || '"], "mapping_id": "approved-' || lpad(n::VARCHAR, 4, '0') || '", "source_column_pattern": "' || o_orderpriority || '", "source_sheet_pattern": "Orders"}', ', ' ORDER BY o_orderkey) AS text, count(*) AS k FROM a GROUP BY o_custkey)
       SELECT o_custkey AS customer_id, coalesce(max(k), 0)::INTEGER AS approved, count(*) FILTER (WHERE o_orderstatus = 'O')::INTEGER AS pending, count(*) FILTER (WHERE o_orderstatus = 'P')::INTEGER AS rejected,
         sha256('{"approved_mappings": [' || coalesce(max(text), '') || '], "customer_id": ' || o_custkey || ', "version": 1}') AS profile_hash FROM orders LEFT JOIN m USING (o_custkey) GROUP BY o_custkey""",
)
def profile_hash(spark, d):
    """A profile for each customer (some dozens of orders at every scale), an order a mapping."""
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected")
    drafts = table(spark, d, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("draft_id"), F.lit("Orders").alias("sheet_pattern"), F.col("o_orderpriority").alias("source_column"), F.lower("o_orderpriority").alias("canonical_field"),
        F.lit(0.5).alias("confidence"), F.array(F.concat(F.lit("e"), F.col("o_orderkey").cast("string"))).alias("evidence_ids"), status.alias("review_status"),
    )
    size = lambda c: F.size(c).alias(c)
    return P.approved_profiles(drafts, ["customer_id"]).select("customer_id", size("approved"), size("pending"), size("rejected"), "profile_hash")


@register(
    "X14_review_package",
    """SELECT p_partkey::VARCHAR AS draft_id, CASE WHEN p_partkey % 2 = 0 THEN 'deterministic' ELSE 'assisted' END AS source_phase, CASE WHEN p_size % 11 = 0 THEN 'conflict_detected' WHEN p_size % 5 = 0 OR p_size > 40 THEN 'rejected' ELSE 'needs_review' END AS review_status,
         array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'citation_coverage_failed' END, CASE WHEN p_size % 5 = 0 THEN 'unsupported_claim' END], lambda b: b IS NOT NULL), ',') AS blockers FROM part""",
)
def review_package(spark, d):
    return _package(spark, d).select("draft_id", "source_phase", "review_status", F.array_join("blockers", ",").alias("blockers"))


def _package(spark, d):
    part = table(spark, d, "part").withColumn("draft_id", F.col("p_partkey").cast("string"))
    drafts = part.select("draft_id", "p_partkey", F.col("p_type").alias("collection"), F.lit("medium").alias("confidence"), F.when(F.col("p_size") <= 40, "complete").otherwise("partial").alias("citation_status"))
    side = lambda n: drafts.filter(F.col("p_partkey") % 2 == n).drop("p_partkey")
    codes = F.array_compact(F.array(F.when(F.col("p_size") % 5 == 0, "unsupported_claim"), F.when(F.col("p_size") % 11 == 0, "conflict_detected")))
    return P.review_package(side(0), side(1), part.select("draft_id", F.explode(codes).alias("code")))


@register(
    "X14_action_log",
    """SELECT p_partkey::VARCHAR AS draft_id, 1 AS step, 'draft_ingested' AS action FROM part UNION ALL SELECT p_partkey::VARCHAR, 2, CASE WHEN p_size % 11 = 0 THEN 'conflict_detected' ELSE 'validation_rejected' END FROM part WHERE p_size % 11 = 0 OR p_size % 5 = 0 OR p_size > 40""",
)
def action_log(spark, d):
    return P.review_log(_package(spark, d)).select("draft_id", "step", "action")


@register(
    "X16_source_versions",
    """SELECT source AS source_id, 'Title of ' || source AS title, count(*) OVER (PARTITION BY source) AS cited_chunks, doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'h' || doc_id ELSE sha256(coalesce(text, '')) END AS chunk_hash FROM documents WHERE doc_id % 3 = 0""",
)
def source_versions(spark, d):
    docs = table(spark, d, "documents")
    cited = docs.filter("doc_id % 3 = 0").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_id"))
    sources = docs.select(F.col("source").alias("source_id")).distinct().withColumn("title", F.concat(F.lit("Title of "), "source_id"))
    prints = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("h"), F.col("doc_id").cast("string"))).otherwise("")
    return P.source_versions(cited.unionByName(cited), sources, docs.select(F.col("doc_id").alias("chunk_id"), prints.alias("text_hash"), "text"))


def _seed(spark, d):
    key = F.col("c_custkey")
    path = lambda kind: F.concat(F.lit(f"{kind}/"), key.cast("string"))
    customer = table(spark, d, "customer")
    sources = customer.select(F.when(key % 10 > 0, key.cast("string")).alias("source_id"), path("raw").alias("raw_path"), path("text").alias("normalized_path"), F.when(key % 4 == 0, "failed").otherwise("ingested").alias("source_status"))
    there = customer.filter("c_custkey % 3 > 0").select(path("raw").alias("path")).unionByName(customer.filter("c_custkey % 7 > 0").select(path("text").alias("path")))
    section = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1.1"), F.col("o_orderkey").cast("string"))).otherwise("")
    chunks = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("section_label"), section.alias("section_ref"), F.lit("").alias("citation_anchor"),
        F.col("o_orderstatus").alias("text"), F.lit(None).cast("string").alias("text_hash"),
    )
    return P.seed_import(sources, chunks, there)


_USABLE = "(c_custkey % 10 > 0 AND c_custkey % 3 > 0 AND c_custkey % 7 > 0)"


@register(
    "X23_seed_import",
    f"""SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey::VARCHAR ELSE '<missing-source-id>' END AS source_id, CASE WHEN {_USABLE} THEN 'imported' ELSE 'skipped' END AS fate, CASE WHEN {_USABLE} THEN coalesce(n, 0) ELSE 0 END AS chunks, {_USABLE} AND c_custkey % 4 > 0 AS is_finalized
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def seed_import(spark, d):
    return _seed(spark, d)[1]


@register(
    "X23_seed_chunks",
    f"""SELECT o_orderkey AS id, o_custkey::VARCHAR AS regulatory_source_id, CASE WHEN o_orderkey % 2 = 0 THEN '1.1' || o_orderkey ELSE 'document' END AS source_location, sha256(o_orderstatus) AS text_hash FROM orders JOIN customer ON c_custkey = o_custkey WHERE {_USABLE}""",
)
def seed_chunks(spark, d):
    return _seed(spark, d)[0].select("id", "regulatory_source_id", "source_location", "text_hash")


@register(
    "X32_coverage_areas",
    """SELECT n AS ordinal, area, CASE WHEN ruled THEN 'ready' ELSE 'blocked' END AS status, CASE WHEN NOT ruled THEN 'Missing rule card.' WHEN EXISTS (SELECT 1 FROM events WHERE contains(event_type || '_of_' || ['shipping', 'cooling', 'harvest', 'other'][event_id % 4 + 1], area)) THEN 'Evaluated with findings.' ELSE 'Evaluated or not applicable.' END AS reason
       FROM (SELECT row_number() OVER () AS n, area, EXISTS (SELECT 1 FROM part WHERE p_size % 3 > 0 AND area IN (['entity_scope', 'shipping', 'cooling', 'exemptions'][p_size % 4 + 1], ['receiving', 'none'][p_size % 2 + 1])) AS ruled FROM (SELECT unnest(['"""
    + "', '".join(P.AREAS)
    + "']) AS area))",
)
def coverage_areas(spark, d):
    pick = lambda n, *names: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    size = F.col("p_size")
    rules = table(spark, d, "part").filter("p_size % 3 > 0").select(pick(size % 4, "entity_scope", "shipping", "cooling", "exemptions").alias("rule_area"), pick(size % 2, "receiving", "none").alias("cte_type"))
    kind = F.concat("event_type", F.lit("_of_"), pick(F.col("event_id") % 4, "shipping", "cooling", "harvest", "other"))
    return P.area_coverage(rules, table(spark, d, "events").select(kind.alias("finding_type")))
