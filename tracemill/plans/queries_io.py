"""Scans, sinks, legacy workbooks and chained jobs, on files that are made from the shared tables.

Files are held as (path, content) rows where a reader takes such rows, so no folder is shared; the sinks write to the checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import jobs, ontology
from tracemill.plans.registry import register, table
from tracemill.sources import early_stop, readers, sinks, template


def scratch(spark) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or a local one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tracemill-')).rstrip('/')}/io-{uuid.uuid4().hex}"


def customer_orders(spark, d):
    """Each customer's orders (some dozens at every scale), in order of their keys."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))
    return rows.withColumn("name", F.col("o_custkey").cast("string"))


def csv_files(spark, d):
    """A CSV file for each customer: a title, a header with a byte-order mark before it, and a quoted line for each order, blank where pending."""
    line = lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit(',"'), o["o_orderpriority"], F.lit(", "), o["o_orderstatus"], F.lit('",'), F.when(o["o_orderstatus"] == "P", "").otherwise(o["o_orderstatus"]))
    text = F.concat(F.lit("﻿Lot #,Notes,Status\n"), F.array_join(F.transform("orders", line), "\n"))
    return customer_orders(spark, d).select(F.concat("name", F.lit(".csv")).alias("path"), F.encode(text, "UTF-8").alias("content"))


CSV_ROWS = """SELECT o_custkey || '.csv' AS file, 'csv' AS sheet, (1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS row_number,
  o_orderkey || '~' || o_orderpriority || ', ' || o_orderstatus || '~' || CASE WHEN o_orderstatus = 'P' THEN '-' ELSE o_orderstatus END AS cells FROM orders
  UNION ALL SELECT DISTINCT o_custkey || '.csv', 'csv', 1, 'Lot #~Notes~Status' FROM orders"""


def joined_cells(rows):
    return rows.select("file", "sheet", "row_number", F.array_join("cells", "~", "-").alias("cells"))


@register("S1_csv_scan", CSV_ROWS)
def csv_scan(spark, d):
    return joined_cells(readers.csv_cells(csv_files(spark, d)))


def exported(spark, d):
    """A workbook for each customer: a summary, a tab for each kind of order, and findings for urgent orders."""
    orders = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "receiving").when(F.col("o_orderstatus") == "O", "shipping").otherwise("a kind of event whose name is long & odd")
    fields = lambda *pairs: F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))).cast("map<string,string>")
    key = F.col("o_orderkey").cast("string")
    events = orders.select(F.col("o_custkey").alias("run_id"), kind.alias("tab"), F.col("o_orderkey").alias("n"), fields(("key", key), ("a priority", F.col("o_orderpriority"))).alias("fields"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    findings = urgent.select(F.col("o_custkey").alias("run_id"), F.lit("Findings").alias("tab"), F.col("o_orderkey").alias("n"), fields(("finding", F.concat(F.lit("<"), key, F.lit(">")))).alias("fields"))
    summary = orders.groupBy(F.col("o_custkey").alias("run_id")).agg(F.count(F.lit(1)).cast("string").alias("k"))
    summary = summary.select("run_id", F.lit("Summary").alias("tab"), F.lit(0).cast("long").alias("n"), fields(("events", F.col("k"))).alias("fields"))
    return sinks.export_workbooks(events.unionByName(findings).unionByName(summary), ["n"])


def workbook_files(spark, d):
    return exported(spark, d).select(F.concat(F.col("run_id").cast("string"), F.lit(".xlsx")).alias("path"), "content")


# rows of the exported workbooks: headers in order of their names, a long tab's name cut to 31 characters
BOOK_ROWS = """WITH e AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'receiving' WHEN 'O' THEN 'shipping' ELSE 'a kind of event whose name is l' END AS sheet, o_orderkey AS n, o_orderpriority || '~' || o_orderkey AS cells FROM orders
    UNION ALL SELECT o_custkey, 'Findings', o_orderkey, '<' || o_orderkey || '>' FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_custkey, 'Summary', 0, count(*)::VARCHAR FROM orders GROUP BY 1),
  r AS (SELECT o_custkey || '.xlsx' AS file, sheet, (1 + row_number() OVER (PARTITION BY o_custkey, sheet ORDER BY n))::INT AS row_number, cells FROM e
    UNION ALL SELECT DISTINCT o_custkey || '.xlsx', sheet, 1, CASE sheet WHEN 'Findings' THEN 'finding' WHEN 'Summary' THEN 'events' ELSE 'a priority~key' END FROM e)"""


@register("S2_workbook_scan", f"{BOOK_ROWS} SELECT * FROM r")
def workbook_scan(spark, d):
    return joined_cells(readers.workbook_cells(workbook_files(spark, d)))


@register("S8_sheet_text", f"{BOOK_ROWS} SELECT file, sheet, row_number, replace(cells, '~', ' | ') AS text FROM r")
def sheet_text(spark, d):
    return readers.sheet_text(readers.workbook_cells(workbook_files(spark, d)))


@register("K2_workbook_export", f"{BOOK_ROWS} SELECT file, sheet, count(*) AS n FROM r GROUP BY ALL")
def workbook_export(spark, d):
    return readers.workbook_cells(workbook_files(spark, d)).groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("n"))


@register("S3_suffix_dispatch", f"{BOOK_ROWS} SELECT right(file, 4) AS suffix, count(*) AS n FROM (SELECT file FROM r UNION ALL SELECT file FROM ({CSV_ROWS})) GROUP BY ALL")
def suffix_dispatch(spark, d):
    found = readers.evidence_cells(csv_files(spark, d).unionByName(workbook_files(spark, d)))
    return found.groupBy(F.right("file", F.lit(4)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@register("S5_xml_sections", "SELECT '1.' || (1300 + n_nationkey) AS section, n_name AS heading, 'first ' || n_regionkey || chr(10) || 'second' AS text FROM nation WHERE n_nationkey >= 5 AND n_nationkey <> 7")
def xml_sections(spark, d):
    """A file of regulation XML in the checkpoint folder, one section a nation; one is of another kind and the first five are out of range."""
    key = F.col("n_nationkey")
    kind = F.when(key == 7, "PART").otherwise("SECTION")
    section = F.concat(
        F.lit('<DIV8 N="1.'), (key + 1300).cast("string"), F.lit('" TYPE="'), kind, F.lit('"><HEAD>'), F.col("n_name"), F.lit("</HEAD><P>first "), F.col("n_regionkey").cast("string"), F.lit("</P><P>second</P></DIV8>"),
    )
    folder = scratch(spark)
    # one document of 25 sections at every scale
    table(spark, d, "nation").agg(F.concat(F.lit("<R>"), F.array_join(F.collect_list(section), ""), F.lit("</R>"))).write.text(folder)
    return readers.read_xml_sections(spark, folder, 1305, 1399)


@register("S11_json_list", "SELECT o_custkey AS customer, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def json_list(spark, d):
    """One JSON list a customer; a folder that isn't there adds nothing."""
    folder = scratch(spark)
    record = F.transform("orders", lambda o: F.struct(F.col("o_custkey").alias("customer"), o["o_orderkey"].alias("key")))
    customer_orders(spark, d).select(F.to_json(record)).write.text(folder)
    schema = "customer long, key long"
    # a line of such a file is a list by itself, so the scan can split the files
    rows = spark.read.schema(schema).json(folder).unionByName(readers.read_json_list(spark, f"{folder}-none", schema))
    return rows.groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


@register("S15_registry_scan", "SELECT 'region-' || n_regionkey AS source, count(*) AS chunks, min(n_name) AS first FROM nation GROUP BY 1")
def registry_scan(spark, d):
    """<source>/normalized/*.json for each region, one record a file, in one scan; the source's name comes from the path."""
    folder = scratch(spark)
    chunks = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name")).alias("chunks"))
    for k in range(5):  # five regions and 25 nations at every scale
        chunks.filter(F.col("n_regionkey") == k).select("chunks").coalesce(1).write.json(f"{folder}/region-{k}/normalized")
    found = readers.read_registry(spark, folder, "sourceId string, chunks array<struct<n_name string>>").select("sourceId", F.inline("chunks"))
    return found.groupBy(F.col("sourceId").alias("source")).agg(F.count(F.lit(1)).alias("chunks"), F.min("n_name").alias("first"))


@register("K1_json_artifacts", "SELECT o_orderstatus AS kind, '{\"key\":' || o_orderkey || ',\"priority\":\"' || o_orderpriority || '\"}' AS line FROM orders")
def json_artifacts(spark, d):
    folder = scratch(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("kind"))
    sinks.write_artifacts(rows, folder, "kind")
    return spark.read.schema("value string, kind string").text(folder).select("kind", F.col("value").alias("line"))


@register("K5_replace_run", "SELECT o_orderstatus AS run_id, o_orderkey AS finding, CASE o_orderstatus WHEN 'P' THEN 'second' ELSE 'first' END AS written FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0")
def replace_run(spark, d):
    """All runs are written, then one of them again with half of its findings."""
    folder = scratch(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run_id"), F.col("o_orderkey").alias("finding"), F.lit("first").alias("written"))
    sinks.replace_run(rows, folder)
    sinks.replace_run(rows.filter("run_id = 'P' AND finding % 2 = 0").withColumn("written", F.lit("second")), folder)
    return spark.read.schema("finding long, written string, run_id string").parquet(folder)


@register("K3_append", "SELECT o_orderkey, n FROM orders, (VALUES (1), (2)) t(n)")
def append(spark, d):
    """Inserts keep what is there, repeated rows too."""
    folder = scratch(spark)
    rows = table(spark, d, "orders").select("o_orderkey")
    for n in (1, 2):
        sinks.append_rows(rows.withColumn("n", F.lit(n)), folder)
    return sinks.read_current(spark, folder)


@register(
    "X25_name_facts",
    """WITH f AS (SELECT p_partkey, 'farm ' || p_partkey || '/Basil_lot-ab' || p_partkey || '_2024-01-0' || (1 + p_size % 9) || '.csv' AS file FROM part)
       SELECT file, 'sheet_name' AS source_kind, 1 AS position, 'traceability_lot_code' AS field_key, 'K' || p_partkey || 'X' AS raw_value FROM f
       UNION ALL SELECT file, 'sheet_name', 2, 'product_name', 'Tuna' FROM f
       UNION ALL SELECT file, 'filename', 1, 'event_datetime', '2024 01 0' || (1 + p_size % 9) FROM f JOIN part USING (p_partkey)
       UNION ALL SELECT file, 'filename', 2, 'product_name', 'Basil' FROM f""",
)
def name_facts(spark, d):
    """A file and a sheet for each part; a row repeats, its facts don't."""
    key = F.col("p_partkey").cast("string")
    file = F.concat(F.lit("farm "), key, F.lit("/Basil_lot-ab"), key, F.lit("_2024-01-0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(".csv"))
    rows = table(spark, d, "part").select(file.alias("file"), F.concat(F.lit("tuna lot k"), key, F.lit("x")).alias("sheet"), F.explode(F.array(F.lit(1), F.lit(2))).alias("row_number"))
    return ontology.inferred_facts(rows).select("file", "source_kind", "position", "field_key", "raw_value")


def legacy_rows(spark, d):
    """A legacy workbook for each customer (nine sheets' fields from its orders)."""
    fields = lambda **named: F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))).cast("map<string,string>")
    rows = customer_orders(spark, d).select(F.col("o_custkey").alias("workbook"), F.posexplode("orders").alias("_at", "o"))
    key, status, first = F.col("o.o_orderkey").cast("string"), F.col("o.o_orderstatus"), F.col("_at") == 0
    # a branch for each sheet, so that a projection of one sheet makes no rows of the others
    row = lambda sheet, values, when=F.lit(True): rows.filter(when).select("workbook", (F.col("_at") + 1).alias("position"), F.lit(sheet).alias("sheet"), values.alias("fields"))
    flag = F.when(status == "F", "Yes").when(status == "O", " no").otherwise("perhaps")
    sheets = [
        row(ontology.BUSINESS, fields(company_name=F.lit(""), covered_entity_status=F.lit("Covered"), handles_ftl_foods=flag), first),
        row(ontology.PRODUCTS, fields(product_id=key, is_ftl_maybe=flag)),
        row(ontology.PLAN, fields(plan_item=F.lit("point_of_contact"), answer=key), first),
        row(ontology.EVENTS, fields(event_id=key, event_type=F.when(status == "F", "Ship").when(status == "O", " First Land-Based Receiving ").otherwise("unheard of"))),
        row(ontology.LINES, fields(event_line_id=key, quantity=F.when(status == "P", "some").otherwise("2.5"))),
        row(ontology.VALUES, fields(event_id=key, kde_name=F.lit("Lot"), field_key=F.when(status == "F", "lot").otherwise(""), kde_value=F.when(status == "P", "").otherwise("x"))),
        row(ontology.LINEAGE, fields(lineage_id=key, lineage_status=F.when(status == "F", "GAP").otherwise("?"))),
        row(ontology.DOCUMENTS, fields(evidence_id=key, evidence_status=F.when(status == "O", "Optional"))),
        row(ontology.CLAIMS, fields(claim_id=key, evidence_provided=flag)),
    ]
    return reduce(DataFrame.unionByName, sheets)


_CASE = "CASE o_orderstatus WHEN 'F' THEN '{}' WHEN 'O' THEN '{}' ELSE '{}' END"
_KEYED = "SELECT '{}' AS record, o_orderkey::VARCHAR AS id, " + _CASE + " AS state FROM orders"


@register(
    "X31_workbook_ontology",
    f"""WITH h AS (SELECT o_custkey, min(o_orderkey) AS first, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)
       SELECT 'business_profiles' AS record, 'business-1' AS id, 'Unknown company/covered/' || CASE s WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE '?' END AS state FROM h
       UNION ALL SELECT 'plans', first::VARCHAR, 'true/?' FROM h
       UNION ALL SELECT 'kde_values', 'kde-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), {_CASE.format("lot/present", "Lot/present", "Lot/missing")} FROM orders
       UNION ALL {_KEYED.format("products", "true", "false", "?")} UNION ALL {_KEYED.format("product_scope", "covered/product_master", "not_covered/product_master", "not_determined/needs_review")}
       UNION ALL {_KEYED.format("events", "shipping", "first_land_based_receiving", "receiving")} UNION ALL {_KEYED.format("line_items", "2.5", "2.5", "?")}
       UNION ALL {_KEYED.format("lineage", "gap", "unverified", "unverified")} UNION ALL {_KEYED.format("source_documents", "unverified", "optional", "unverified")}
       UNION ALL {_KEYED.format("exemption_claims", "true/partially_exempt", "false/not_determined", "false/not_determined")}""",
)
def workbook_ontology(spark, d):
    """All ten record tables of a legacy workbook, each shown by an id and its derived states."""
    shown = {
        "business_profiles": ("business_id", ["company_name", "covered_status", "handles_listed_foods"]), "products": ("product_id", ["listed"]), "product_scope": ("product_id", ["status", "reason"]),
        "plans": ("point_of_contact", ["plan_exists", "farm_map_available"]), "events": ("event_id", ["event_type"]), "line_items": ("event_line_id", ["quantity"]), "kde_values": ("kde_id", ["field_key", "status"]),
        "lineage": ("lineage_id", ["lineage_status"]), "source_documents": ("evidence_id", ["evidence_status"]), "exemption_claims": ("claim_id", ["evidence_provided", "decision"]),
    }
    made = ontology.ontology(legacy_rows(spark, d))
    out = None
    for name, (key, columns) in shown.items():
        state = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns))
        rows = made[name].select(F.lit(name).alias("record"), F.col(key).alias("id"), state.alias("state"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "TQ5_chained_jobs",
    """SELECT 'execute_approved_rules:' || o_orderkey AS job_id, o_custkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 110 ELSE o_orderkey % 5 + 10 END::BIGINT AS priority, o_orderkey AS previous_job_id
       FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderkey % 3 <> 0""",
)
def chained_jobs(spark, d):
    """Orders as parses: a third of them is followed already, those of low priority name no rule package."""
    orders = table(spark, d, "orders")
    key, none = F.col("o_orderkey"), F.lit(None).cast("long")
    package = F.when(F.col("o_orderpriority") != "5-LOW", "p1")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running")
    row = lambda job, kind, state, previous: (job.alias("job_id"), F.col("o_custkey").alias("run_id"), F.lit(kind).alias("job_type"), state.alias("status"), (key % 5).alias("priority"), package.alias("package_id"), previous.alias("previous_job_id"))
    parses = orders.select(*row(key, "parse_customer_workbook", status, none))
    followed = orders.filter(key % 3 == 0).select(*row(-key, "execute_approved_rules", F.lit("queued"), key))
    return jobs.follow_ups(parses.unionByName(followed)).select("job_id", "run_id", "priority", "previous_job_id")


@register(
    "S13_early_stop_scan",
    """SELECT o_orderstatus AS status, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey % 3 <> 0
       QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 40""",
)
def early_stop_scan(spark, d):
    """The orders as packed tab-separated files by ranges of their keys; each file is read only as far as two classes need it."""
    name = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" customer "), F.col("o_custkey").cast("string")))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), name.alias("name"))
    folder = scratch(spark)
    rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(folder)
    found = early_stop.first_rows(spark, folder, 40, "status", ("F", "P"), ("o_orderkey", "name"))
    return found.select(F.col("class").alias("status"), F.element_at("values", "o_orderkey").cast("long").alias("o_orderkey"))


#: A template: a tab of the exported workbooks, a column that they don't have, and a tab that is missing in some of them.
TEMPLATE = {"shipping": ["key", "a_priority", "carrier"], "Findings": ["finding"], "Summary": ["events"]}


def template_parts(spark, d):
    # the files' names are those of the customers, so no file is made for its name's sake
    names = table(spark, d, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".xlsx")).alias("file")).distinct()
    return template.template_scan(names, readers.workbook_cells(workbook_files(spark, d)), TEMPLATE)


@register(
    "S14_template_rows",
    """SELECT o_custkey || '.xlsx' AS file, 'shipping' AS sheet, (1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS row_number, o_orderkey || '|' || o_orderpriority AS said FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT o_custkey || '.xlsx', 'Findings', (1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT, '<' || o_orderkey || '>' FROM orders WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT o_custkey || '.xlsx', 'Summary', 2, count(*)::VARCHAR FROM orders GROUP BY o_custkey""",
)
def template_rows(spark, d):
    """Records of the sheets that the template names, of each customer's workbook."""
    get = lambda k: F.try_element_at("values", F.lit(k))
    return template_parts(spark, d)[0].select("file", "sheet", "row_number", F.concat_ws("|", get("key"), get("a_priority"), get("finding"), get("events")).alias("said"))


@register(
    "S14_template_columns",
    """WITH c AS (SELECT o_custkey || '.xlsx' AS file, bool_or(o_orderstatus = 'O') AS s, bool_or(o_orderpriority = '1-URGENT') AS f FROM orders GROUP BY o_custkey)
       SELECT file, 'shipping' AS sheet, CASE WHEN s THEN 'carrier' END AS "column", CASE WHEN s THEN 'Required column is missing.' ELSE 'Required sheet is missing.' END AS reason FROM c
       UNION ALL SELECT file, 'Findings', NULL, 'Required sheet is missing.' FROM c WHERE NOT f""",
)
def template_columns(spark, d):
    return template_parts(spark, d)[1]
