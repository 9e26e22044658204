"""Scalar functions, projections and filters on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.plans import cards
from tracemill.plans.registry import register, table

_PLACEHOLDERS = ", ".join(f"'{p}'" for p in cards.PLACEHOLDERS)


@register("F1_cell_to_string", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ordered, trim('  ' || o_orderstatus || ' ') AS status FROM orders")
def cell_to_string(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), S.strip(F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))).alias("status"))


@register(
    "F2_normalize_value",
    """SELECT p_partkey, replace(upper(p_brand), ' ', '') AS lot, regexp_extract(replace('1,' || p_size || ' lb', ',', ''), '-?\\d+(?:\\.\\d+)?') AS quantity,
       CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS flag FROM part""",
)
def normalize_value(spark, d):
    part = table(spark, d, "part")
    amount = F.concat(F.lit("1,"), F.col("p_size").cast("string"), F.lit(" lb"))
    flag = F.when(F.col("p_size") % 2 == 0, "Y").otherwise("false")
    return part.select(
        "p_partkey",
        S.normalize_value("p_brand", F.lit("traceability_lot_code")).alias("lot"),
        S.normalize_value(amount, F.lit("quantity")).alias("quantity"),
        S.normalize_value(flag, F.lit("is_ftl_maybe")).alias("flag"),
    )


@register("F3_parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS us, strftime(o_orderdate, '%Y-%m-%d') AS packed, strftime(o_orderdate, '%Y-%m-%d') AS named FROM orders")
def parse_date(spark, d):
    written = lambda pattern: S.parse_date(F.date_format("o_orderdate", pattern))
    return table(spark, d, "orders").select("o_orderkey", written("M/d/yyyy").alias("us"), written("yyyyMMdd").alias("packed"), written("d-MMM-yyyy").alias("named"))


@register(
    "F4_unit_and_quantity",
    "SELECT l_orderkey, l_linenumber, l_quantity::INTEGER::VARCHAR AS quantity, CASE l_returnflag WHEN 'R' THEN 'lb' WHEN 'A' THEN 'case' ELSE 'kg' END AS unit FROM lineitem",
)
def unit_quantity(spark, d):
    said = F.when(F.col("l_returnflag") == "R", "Pounds").when(F.col("l_returnflag") == "A", "CS").otherwise("kgs.")
    amount = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" units"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.normalize_quantity(amount).alias("quantity"), S.normalize_unit(said).alias("unit"))


@register(
    "F5_slug_and_key",
    "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, replace(lower(p_name), '_', ' ') AS header, 'part-' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS stable FROM part",
)
def slugs(spark, d):
    both = F.concat_ws(" / ", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", S.slug(both).alias("slug"), S.header_key("p_name").alias("header"), S.stable_id("part", "p_brand").alias("stable"))


@register("F6_title", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def titles(spark, d):
    return table(spark, d, "part").select("p_partkey", S.title("p_name").alias("title"))


_TYPE_NAMES = "CASE event_type WHEN 'purchase' THEN 'ship' WHEN 'click' THEN 'Initial_Packing' WHEN 'view' THEN 'blending' ELSE 'first land-based receiving' END"


@register(
    "F7_normalize_event_type",
    "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'shipping' WHEN 'click' THEN 'initial_packing' WHEN 'view' THEN NULL ELSE 'first_land_based_receiving' END AS evidence, CASE event_type WHEN 'purchase' THEN 'shipping' WHEN 'click' THEN 'initial_packing' WHEN 'view' THEN 'transformation' ELSE NULL END AS classifier FROM events",
)
def event_types(spark, d):
    said = F.expr(_TYPE_NAMES)
    return table(spark, d, "events").select("event_id", S.evidence_cte(said).alias("evidence"), S.classifier_cte(said).alias("classifier"))


@register(
    "F8_field_type",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'number' WHEN 2 THEN 'formula' ELSE 'text' END AS kind FROM orders",
)
def field_types(spark, d):
    n = F.col("o_orderkey") % 4
    value = F.when(n == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n == 1, F.col("o_orderkey").cast("string")).when(n == 2, "=A1+2").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", S.field_type(F.lit("remark"), value).alias("kind"))


@register(
    "F9_inferred_facts",
    """SELECT o_orderkey, unnest(['traceability_lot_code', 'event_datetime', 'source_document_type', 'product_name', 'product_name', 'location_name']) AS field_key,
         unnest(['T' || o_orderkey || '-Z', '2024 11 0' || (1 + o_custkey % 9), 'transformation_batch_record', 'Lettuce', 'Melon', 'dock 0' || o_custkey]) AS raw_value FROM orders""",
)
def inferred_facts(spark, d):
    """Six facts in a name for each order; of two kinds of document with a word each the first counts."""
    from tracemill.operators.ontology import name_facts

    key = F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("melon and Lettuce BATCH # t"), key, F.lit("-z 2024_11-0"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit(" @ dock 0"), F.col("o_custkey").cast("string"), F.lit("_q"))
    return table(spark, d, "orders").select("o_orderkey", F.inline(name_facts(name))).select("o_orderkey", "field_key", "raw_value")


@register(
    "F10_food_form",
    """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY') THEN false WHEN p_size > 10 THEN true END AS remains, (p_type = 'ECONOMY' OR p_size <= 10) AS review,
       CASE WHEN p_type = 'ECONOMY' THEN 'canned' WHEN p_type = 'PROMO' THEN 'frozen' ELSE '' END AS states FROM part""",
)
def food_forms(spark, d):
    form = F.when(F.col("p_type") == "ECONOMY", "Canned").when(F.col("p_type") == "PROMO", "FROZEN pack")
    category = F.when(F.col("p_size") > 10, "listed")
    found = S.food_form(F.lit("plain item"), category, form)
    rows = table(spark, d, "part").select("p_partkey", found.alias("f"))
    return rows.select("p_partkey", F.col("f.remains_listed").alias("remains"), F.col("f.review_required").alias("review"), F.concat_ws(",", "f.form_state").alias("states"))


@register(
    "F11_actor_role",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'distributor' WHEN 'MACHINERY' THEN 'farm' WHEN 'FURNITURE' THEN 'shipper' ELSE 'unknown' END AS role FROM customer",
)
def roles(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "cold warehouse").when(F.col("c_mktsegment") == "MACHINERY", "Grower")
    event = F.when(F.col("c_mktsegment") == "FURNITURE", "ship")
    return table(spark, d, "customer").select("c_custkey", S.actor_role(F.lit("x"), kind, event)["role"].alias("role"))


@register("F12_match_token", "SELECT p_partkey, trim(regexp_replace(lower(p_name || '--' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS token FROM part")
def match_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", S.match_token(F.concat_ws("--", "p_name", "p_brand")).alias("token"))


@register("F14_summary", "SELECT doc_id, CASE WHEN length(text) > 180 THEN left(text, 177) || '...' ELSE text END AS summary FROM documents")
def summary(spark, d):
    return table(spark, d, "documents").select("doc_id", S.shortened("text").alias("summary"))


@register("F15_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digests(spark, d):
    return table(spark, d, "documents").select("doc_id", S.sha256("text").alias("digest"))


@register("F16_row_hash_id", "SELECT o_orderkey, 'run-' || left(sha256(o_orderkey || '|' || coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '')), 24) AS row_id FROM orders")
def row_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.row_hash_id("run-", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("row_id"))


@register(
    "F20_token_support",
    """WITH w AS (SELECT item_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark), c AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ds FROM documents)
       SELECT item_id, len(list_filter(ws, lambda x: list_contains(ds, x))) AS overlap,
              len(list_filter(ws, lambda x: list_contains(ds, x))) >= greatest(2, floor(0.35 * len(list_distinct(ws)))) AS supported FROM w JOIN c ON doc_id = item_id""",
)
def token_support(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), words.alias("ws"))
    joined = claims.join(table(spark, d, "documents").select("doc_id", S.distinct_words("text").alias("ds")), "doc_id")
    overlap = F.size(F.filter("ws", lambda w: F.array_contains("ds", w)))
    need = F.greatest(F.lit(2), F.floor(0.35 * F.size(F.array_distinct("ws"))))
    return joined.select(F.col("doc_id").alias("item_id"), overlap.cast("long").alias("overlap"), (overlap >= need).alias("supported"))


@register("F26_boolean", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS answer FROM lineitem")
def booleans(spark, d):
    said = F.when(F.col("l_returnflag") == "R", " Yes").when(F.col("l_returnflag") == "A", "N").otherwise("perhaps")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.tri_state(said).alias("answer"))


@register("P5_field_mapping", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'quantity' WHEN p_size % 3 = 1 THEN 'traceability_lot_code' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') END AS field_key, CASE WHEN p_size % 3 = 0 THEN 0.98 WHEN p_size % 3 = 1 THEN 0.9 ELSE 0.45 END::DOUBLE AS confidence FROM part")
def field_mapping(spark, d):
    from tracemill.operators.evidence import map_field

    header = F.when(F.col("p_size") % 3 == 0, "Quantity").when(F.col("p_size") % 3 == 1, "Lot #").otherwise(F.col("p_brand"))
    rows = table(spark, d, "part").select("p_partkey", map_field(header).alias("m"))
    return rows.select("p_partkey", "m.field_key", F.col("m.confidence").alias("confidence"))


@register("P7_placeholders", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ' TBD ' WHEN 1 THEN o_orderstatus ELSE '' END AS raw, lower(trim(CASE o_orderkey % 3 WHEN 0 THEN ' TBD ' WHEN 1 THEN o_orderstatus ELSE '' END)) NOT IN ({_PLACEHOLDERS}) AS answered FROM orders")
def placeholders(spark, d):
    n = F.col("o_orderkey") % 3
    raw = F.when(n == 0, " TBD ").when(n == 1, F.col("o_orderstatus")).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), S.is_answered(raw).alias("answered"))


@register("P9_first_present", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE c_name END AS value FROM customer")
def first_present(spark, d):
    values = F.array(F.lit(""), F.lit("None"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.lit("null"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.first_present(values).alias("value"))


@register(
    "P4_unpivot",
    """SELECT o_orderkey AS k, 1 AS column_index, 'status' AS column_name, o_orderstatus AS raw_value FROM orders
       UNION ALL SELECT o_orderkey, 2, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 3, 'customer', o_custkey::VARCHAR FROM orders""",
)
def unpivot(spark, d):
    from tracemill.operators.relational import unpivot_cells

    wide = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer")
    )
    return unpivot_cells(wide, ["k"], ["status", "priority", "customer"])
