"""Extraction, citation and read-side operators on texts and rows built from the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import extract, markup, readside
from tracemill.plans.registry import register, table


def region_chunks(spark, d, sentence, gap=" "):
    """A chunk for each region: a sentence for each of its nations (25 at every scale), in the order of their keys."""
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("chunk_id"), F.struct("n_nationkey", sentence.alias("s")).alias("part"))
    said = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["s"])
    return rows.groupBy("chunk_id").agg(F.array_join(said, gap).alias("text"))


NATIONS = [f"NATION_{k}" for k in range(25)]


def nation_key():
    return F.col("n_nationkey").cast("string")


TERMS_SQL = "SELECT n_regionkey AS chunk_id, 'term_nation_' || n_nationkey AS term_id, n_name AS term, 'nation number ' || n_nationkey || '.' AS definition FROM nation"


@register("X4_defined_terms", TERMS_SQL)
def defined_terms(spark, d):
    chunks = region_chunks(spark, d, F.concat(F.col("n_name"), F.lit("  MEANS nation number "), nation_key(), F.lit(" .")))
    markers = {n: f"{n} means" for n in NATIONS}
    # markers are found without case but taken away as they are spelled, so the texts are spelled alike first
    return extract.defined_terms(chunks.withColumn("text", F.replace("text", F.lit("MEANS"), F.lit("means"))), markers)


@register(
    "X1_list_items",
    """SELECT n_regionkey AS chunk_id, 'ftl_item_' || lpad(n_nationkey::VARCHAR, 2, '0') AS item_id, 'Item ' || lpad(n_nationkey::VARCHAR, 2, '0') AS commodity, 'covers ' || n_name || ' kinds.' AS description,
       'apples|' || n_name || '|pears' AS examples, 'Does not include dried ' || n_name || '.' AS exclusions, 'Fresh only.' AS notes FROM nation""",
)
def list_items(spark, d):
    said = F.concat(
        F.lit("Item "), F.lpad(nation_key(), 2, "0"), F.lit("[1] covers "), F.col("n_name"), F.lit(" kinds. Examples include apples[2], "), F.col("n_name"), F.lit(" and pears. Does not include dried "), F.col("n_name"),
        F.lit(".\n Fresh only."),
    )
    found = extract.list_items(region_chunks(spark, d, said), [f"Item {k:02d}[1]" for k in range(25)])
    return found.select("chunk_id", "item_id", "commodity", "description", *(F.array_join(c, "|").alias(c) for c in ("examples", "exclusions", "notes")))


@register(
    "X2_export_fields",
    """SELECT 'Tab ' || n_nationkey AS tab, position, CASE position WHEN 4 THEN n_name ELSE field_name END AS field_name,
       'tab_' || n_nationkey || '_00' || position || '_' || CASE position WHEN 4 THEN lower(n_name) ELSE key END AS field_key, examples
       FROM nation, (VALUES (1, 'Name', 'name', ''), (2, 'Lot code (e.g., TLC-1, TLC-2 or TLC-3)', 'lot_code_e_g_tlc_1_tlc_2_or_tlc_3', 'TLC-1|TLC-2|TLC-3'),
         (3, 'Date (mm/dd/yyyy)', 'date_mm_dd_yyyy', ''), (4, NULL, NULL, '')) t(position, field_name, key, examples)""",
)
def export_fields(spark, d):
    cells = F.array(F.lit("Name"), F.lit(None), F.lit("Lot code (e.g., TLC-1, TLC-2  or TLC-3)"), F.lit(" Date (mm/dd/yyyy) "), F.lit(""), F.col("n_name"))
    found = extract.export_fields(table(spark, d, "nation").select(F.concat(F.lit("Tab "), nation_key()).alias("tab"), cells.alias("cells")))
    return found.withColumn("examples", F.array_join("examples", "|"))


@register(
    "X3_bullet_candidates",
    """SELECT n_regionkey AS page_number, position, 'kde_' || kind || '_0' || position || '_traceability_lot_of_nation_' || n_nationkey AS kde_id, 'Traceability lot of ' || n_name AS kde_name
       FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position FROM nation) JOIN (VALUES (0, 'shipping'), (2, 'cooling')) t(n_regionkey, kind) USING (n_regionkey)""",
)
def bullet_candidates(spark, d):
    said = F.concat(F.lit("Traceability  lot of "), F.col("n_name"), F.lit("."))
    pages = region_chunks(spark, d, said, " • ").select(F.col("chunk_id").alias("page_number"), F.concat(F.lit("Title • "), F.col("text"), F.lit(" • tiny • Provide to the buyer • "), F.col("text"), F.lit("\nFood Traceability Rule: end")).alias("text"))
    return extract.bullet_candidates(pages, {0: "shipping", 2: "cooling"})


@register(
    "X5_definitions",
    "SELECT CASE n_nationkey WHEN 3 THEN 'shipping' ELSE 'cooling' END AS kind, 'nation number ' || n_nationkey || '.' AS definition FROM nation WHERE n_nationkey IN (3, 7) UNION ALL SELECT 'receiving', 'an event in a supply chain'",
)
def definitions(spark, d):
    return extract.definitions_of(defined_terms(spark, d), {"NATION_3": "shipping", "NATION_7": "cooling"}, [("receiving", "an event in a supply chain")])


@register(
    "X6_plan_requirements",
    "SELECT spec || ':' || r_regionkey AS id, r_name AS cited FROM region JOIN (VALUES ('map', 0), ('contact', 1), ('retention', 1)) t(spec, r_regionkey) USING (r_regionkey)",
)
def plan_requirements(spark, d):
    specs = spark.createDataFrame([("map", 0), ("contact", 1), ("retention", 1)], "spec string, section int")
    chunks = table(spark, d, "region").select(F.col("r_regionkey").alias("section"), F.col("r_regionkey").alias("chunk_id"), F.col("r_name").alias("text"))
    return extract.cited_specs(specs, chunks, ["section"]).select(F.concat_ws(":", "spec", F.col("section").cast("string")).alias("id"), F.col("text").alias("cited"))


@register(
    "X7_scenario_benchmarks",
    """SELECT 'scenario_slides_' || replace(lower(r_name), ' ', '_') || '_page_2' AS scenario_id, r_name AS scenario_name, 'event_' || pos || '_' || kind AS event_id, kind, r_regionkey AS chunk_id
       FROM region, (VALUES (1, 'receiving'), (2, 'shipping')) t(pos, kind)""",
)
def scenario_benchmarks(spark, d):
    source = F.concat(F.lit("slides-"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))).alias("source_id")
    rows = table(spark, d, "region").select(source, F.lit(2).alias("page_number"), "r_regionkey", "r_name")
    specs = rows.select("source_id", "page_number", F.col("r_name").alias("scenario_name"), F.array(F.lit("receiving"), F.lit("shipping")).alias("kinds"))
    chunks = rows.select("source_id", "page_number", F.col("r_regionkey").alias("chunk_id"), F.col("r_name").alias("text"))
    return extract.scenario_events(specs, chunks)


@register("S4_html_sections")
def html_sections(spark, d):
    """The sections of raw pages; markup that SQL can't read, tested on fixtures."""
    return markup.html_sections(table(spark, d, "pages"))


@register(
    "S4_built_sections",
    """SELECT c_custkey AS page_id, n AS ordinal, CASE n WHEN 1 THEN 'Document' WHEN 2 THEN 'Customer ' || c_custkey ELSE '21 CFR 1.1340 Shipping' END AS section_label,
         CASE n WHEN 1 THEN 'Document' WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN '1.1325' ELSE 'Customer ' || c_custkey END ELSE '21 CFR 1.1340' END AS section,
         CASE n WHEN 1 THEN 'before' WHEN 2 THEN c_name || ' second third' || CASE WHEN c_custkey % 2 = 0 THEN ' see 1.1325' ELSE '' END || ' & fourth' ELSE c_mktsegment || ' last' END AS text
       FROM customer, (VALUES (1), (2), (3)) t(n)""",
)
def built_sections(spark, d):
    """A page for each customer, with void tags, end tags that are missing or too many, entities and markup within headings."""
    key = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit("<div>before</b></div><h1 class=x>Customer <i>"), key, F.lit("</i></h1><p>"), F.col("c_name"), F.lit("<br>second<img src=x>third<p>"),
        F.when(F.col("c_custkey") % 2 == 0, "see 1.1325").otherwise(""), F.lit("<ul><li>&amp;<li>fourth</ul></section><h4>no</h4><h2>21 CFR 1.1340 Shipping</h2><table><tr><td>"),
        F.col("c_mktsegment"), F.lit("<td><span>last</table><script>var x = '<p>no</p>';</script>bare"),
    )
    # narrow rows are read by a few tasks only, and a shuffle without a number would be merged by its size to a few again, while parsing is what takes time
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(tasks, "c_custkey")
    return markup.html_sections(rows.select(F.col("c_custkey").alias("page_id"), html.alias("html")))


@register(
    "S9_rules_rows",
    "SELECT n_nationkey::BIGINT AS page_id, 2 AS row_number, n_name AS title, 'FDA-2020-N-' || lpad(n_nationkey::VARCHAR, 4, '0') AS docket, '/r/' || n_nationkey || '|/d' AS links FROM nation",
)
def rules_rows(spark, d):
    html = F.concat(
        F.lit("<table><tr><th>Title<th>Docket</tr><tr><td><a href='/r/"), nation_key(), F.lit("'>"), F.col("n_name"), F.lit("</a></td><td><b>FDA-2020-N-"), F.lpad(nation_key(), 4, "0"), F.lit("</b> <a href=/d>docket</a></td></tr></table><p>FDA-2020-N-9999"),
    )
    pages = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), html.alias("html"))
    return markup.rules_rows(pages).withColumn("links", F.array_join("links", "|"))


@register(
    "S12_visibility_events",
    "SELECT 'e' || (event_id // 2) AS event_id, 'ObjectEvent' AS kind, count(*) > 0 AS found FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
)
def visibility_events(spark, d):
    """Events nested two deep in JSON; pairs share an id, and errors are of another type."""
    kind = F.when(F.col("event_type") == "error", "Note").otherwise("ObjectEvent")
    event = F.struct(kind.alias("type"), F.concat(F.lit("e"), F.floor(F.col("event_id") / 2).cast("string")).alias("eventID"), "value")
    rows = table(spark, d, "events").select(F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("Document").alias("type"), F.array(event).alias("eventList"))).alias("items")).alias("body"))).alias("content"))
    return extract.visibility_events(rows, ("ObjectEvent",)).select("event_id", "kind", F.col("body").isNotNull().alias("found"))


@register(
    "S12_xml_events",
    """SELECT 'e' || (event_id // 2) AS event_id, 'ObjectEvent' AS kind, 'shipping' AS biz_step, 'e' || (event_id // 2) || '|' || min(user_id) || ' urn:x' AS said FROM events WHERE event_type <> 'error' GROUP BY event_id // 2
       UNION ALL SELECT 'a' || event_id, 'AggregationEvent', '', 'a' || event_id || '|' FROM events WHERE event_type <> 'error' AND event_id % 5 = 0""",
)
def xml_events(spark, d):
    """The same as XML, namespaced, with an event inside another one for every fifth; errors are broken documents."""
    key, text = F.col("event_id"), lambda c: c.cast("string")
    inner = F.when(key % 5 == 0, F.concat(F.lit("<AggregationEvent><eventID>a"), text(key), F.lit("</eventID></AggregationEvent>"))).otherwise("")
    first = F.min("user_id").over(Window.partitionBy(F.floor(key / 2), F.col("event_type") != "error"))  # both of a pair say the same
    xml = F.concat(
        F.lit("<?xml version='1.0' encoding='UTF-8'?><e:EPCISDocument xmlns:e='urn:epcglobal:epcis:xsd:2'><EPCISBody><EventList><ObjectEvent><eventID>e"), text(F.floor(key / 2)),
        F.lit("</eventID><bizStep>urn:epcglobal:cbv:bizstep:shipping</bizStep><sourceList><s> "), text(F.col("first")), F.lit(" </s><t>urn:x</t></sourceList></ObjectEvent>"),
        inner, F.when(F.col("event_type") == "error", "</wrong>").otherwise("</EventList></EPCISBody></e:EPCISDocument>"),
    )
    rows = table(spark, d, "events").withColumn("first", first).select(xml.alias("content"))
    found = extract.visibility_events(rows, ("ObjectEvent", "AggregationEvent"))
    said = F.concat_ws("|", "event_id", F.coalesce(F.get_json_object("body", "$.sourceList"), F.lit("")))
    return found.select("event_id", "kind", "biz_step", said.alias("said"))



@register(
    "X15_spec_obligations",
    "SELECT spec || '-' || r_regionkey AS obligation_id, r_name AS section FROM region JOIN (VALUES ('keep', 0), ('give', 4)) t(spec, r_regionkey) USING (r_regionkey)",
)
def spec_obligations(spark, d):
    specs = spark.createDataFrame([("keep", 0), ("give", 4)], "spec string, section int")
    chunks = table(spark, d, "region").select(F.col("r_regionkey").alias("section"), F.lit(1).alias("chunk_id"), F.col("r_name").alias("text"))
    return extract.cited_specs(specs, chunks, ["section"]).select(F.concat_ws("-", "spec", F.col("section").cast("string")).alias("obligation_id"), F.col("text").alias("section"))


@register(
    "X27_evidence_summary",
    """SELECT 'evidence_records' AS metric, '' AS key, count(*) AS n FROM lineitem UNION ALL SELECT 'field_mapping_suggestions', '', count(*) FROM part
       UNION ALL SELECT 'low_confidence_mappings', '', count(*) FILTER (WHERE p_size / 50.0 < 0.6) FROM part UNION ALL SELECT 'event_nodes', '', count(*) FROM orders
       UNION ALL SELECT 'classified_events', '', count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders UNION ALL SELECT 'abstained_events', '', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
       UNION ALL SELECT 'review_required_events', '', count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders
       UNION ALL SELECT 'final_cte', CASE o_orderstatus WHEN 'O' THEN 'shipping' ELSE 'receiving' END, count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2
       UNION ALL SELECT 'suppressed_cte', 'cooling', count(*) FROM orders WHERE o_orderstatus = 'O' HAVING count(*) > 0""",
)
def evidence_summary(spark, d):
    named = lambda when, name: F.array_compact(F.array(F.when(when, F.lit(name))))
    state = F.col("o_orderstatus")
    final = F.concat(named(state == "O", "shipping"), named(state == "F", "receiving"))
    events = table(spark, d, "orders").select(final.alias("final"), named(state == "O", "cooling").alias("suppressed"), named(F.col("o_orderpriority") == "1-URGENT", "why").alias("questions"))
    return readside.evidence_summary(table(spark, d, "lineitem"), table(spark, d, "part").select((F.col("p_size") / 50.0).alias("confidence")), events)


RUNS = """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'blocked' END AS stated FROM orders"""
FINDINGS = "SELECT DISTINCT l_orderkey AS run_id, l_orderkey || '-' || l_linenumber AS finding_id, CASE l_returnflag WHEN 'R' THEN 'pass' ELSE 'open' END AS finding_status FROM lineitem"


def audit_runs(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    stated = F.when(F.col("o_orderpriority") == "1-URGENT", "blocked")
    runs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), state.alias("status"), stated.alias("readiness"), F.when(state != "failed", "p1").alias("parser_version"), F.lit(None).cast("string").alias("execution_version")
    )
    finding = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("finding_id")
    findings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), finding, F.when(F.col("l_returnflag") == "R", "pass").otherwise("open").alias("status")).distinct()
    return runs, findings


@register(
    "X33_blockers",
    f"""SELECT DISTINCT run_id, blocker FROM (SELECT run_id, CASE WHEN stated = 'blocked' THEN coalesce(finding_id, 'readiness status: blocked') WHEN status = 'running' THEN 'audit run is running'
        WHEN status = 'failed' THEN 'audit run failed' WHEN finding_status = 'open' THEN finding_id END AS blocker FROM ({RUNS}) LEFT JOIN ({FINDINGS}) USING (run_id)) WHERE blocker IS NOT NULL""",
)
def run_blockers(spark, d):
    return readside.blockers(*audit_runs(spark, d))


@register(
    "X33_coverage",
    f"""WITH r AS ({RUNS}), f AS (SELECT run_id, count(*) AS k FROM ({FINDINGS}) GROUP BY run_id), b AS (SELECT r.*, coalesce(k, 0) AS k FROM r LEFT JOIN f USING (run_id))
        SELECT run_id, 'Parser' AS area, CASE WHEN status <> 'failed' THEN 'ready' ELSE 'pending' END AS status, CASE WHEN status <> 'failed' THEN 'p1' ELSE 'The workbook has not been parsed.' END AS reason FROM b
        UNION ALL SELECT run_id, 'Rule execution', CASE status WHEN 'succeeded' THEN 'ready' ELSE status END, 'The approved rules have not been executed.' FROM b
        UNION ALL SELECT run_id, 'Findings', CASE WHEN k > 0 THEN 'review' WHEN status = 'succeeded' THEN 'ready' ELSE 'pending' END, CASE WHEN k > 0 THEN k || ' to review' ELSE 'No findings of this run.' END FROM b""",
)
def run_coverage(spark, d):
    return readside.coverage(*audit_runs(spark, d))


@register(
    "K7_report_lines",
    """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY part, id) AS line_number, line FROM (
       SELECT c_custkey AS run_id, 0 AS part, '' AS id, '# Audit ' || c_custkey AS line FROM customer UNION ALL SELECT c_custkey, 0, '~', 'Status: ready' FROM customer
       UNION ALL SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 4 END, o_orderkey::VARCHAR, '- [' || CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'medium' ELSE 'low' END || '] ' || o_orderpriority FROM orders)""",
)
def report_lines(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("ready").alias("readiness"))
    severity = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    return readside.report_lines(runs, table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("finding_id"), severity.alias("severity"), F.col("o_orderpriority").alias("title")))


@register(
    "X41_readiness_fallback",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN 'needs_review' WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'failed' END AS readiness FROM orders""",
)
def readiness_fallback(spark, d):
    """Runs without a stated readiness: one that succeeded is ready, another is as its status says."""
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "needs_review").alias("readiness"))
    return readside.readiness(runs).select("run_id", "readiness")
