"""Registry records, triage, text functions, single rules and the package's tabs over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import texts as T
from tracemill.operators import drafts as D
from tracemill.operators import evaluation as E
from tracemill.operators import legacy as L
from tracemill.operators import phrases as P
from tracemill.operators import registry_rules as R
from tracemill.plans.queries_evaluation import _EVALUATED, _RECORDS, _ratio_sql, predictor
from tracemill.plans.queries_evaluation import records as event_records
from tracemill.plans.registry import register, table


def pick(n, *names):
    return F.get(F.array(*map(F.lit, names)), n.cast("int"))


def _sql(names):
    return "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in names) + "]"


SOURCES = ["ecfr-21-cfr-1-subpart-s", "cfr-9", "fr-2022-24417-final-rule", "scenario-x", "fda-faq", "other"]
TIERS = ["binding_rule", "guidance", "unknown", None]
URLS = ["https://www.fda.gov/a.XLSX", "https://www.fda.gov/media/1/download", "https://hfpappexternal.fda.gov/x", "https://fda.gov/page", "local://x", "https://www.federalregister.gov/d", None]


@register(
    "X12_source_authority",
    f"""SELECT p_partkey, CASE s WHEN 'ecfr-21-cfr-1-subpart-s' THEN 'codified_rule' WHEN 'fr-2022-24417-final-rule' THEN 'final_rule' ELSE CASE WHEN starts_with(s, 'cfr-') THEN 'codified_rule' WHEN t = 'binding_rule' THEN 'codified_rule' WHEN t = 'guidance' THEN 'guidance' ELSE 'support' END END AS authority,
          CASE WHEN starts_with(s, 'ecfr-') THEN 'ecfr' WHEN starts_with(s, 'cfr-') THEN 'cfr' WHEN starts_with(s, 'fr-') OR coalesce(contains(u, 'federalregister.gov'), false) THEN 'federal_register' WHEN u LIKE '%.XLSX' THEN 'fda_xlsx' WHEN u LIKE '%/media/%' THEN 'fda_pdf' WHEN u LIKE '%hfpapp%' THEN 'fda_web_app' WHEN u LIKE '%fda.gov%' THEN 'fda_html' WHEN u LIKE 'local://%' THEN 'local_document' ELSE 'unknown' END AS source_type
        FROM (SELECT p_partkey, ({_sql(SOURCES)})[p_partkey % 6 + 1] AS s, ({_sql(TIERS)})[p_partkey % 4 + 1] AS t, ({_sql(URLS)})[p_partkey % 7 + 1] AS u FROM part)""",
)
def source_authority(spark, d):
    key = F.col("p_partkey")
    source = pick(key % 6, *SOURCES)
    return table(spark, d, "part").select("p_partkey", R.authority(source, pick(key % 4, *TIERS)).alias("authority"), R.source_type(source, pick(key % 7, *URLS), F.lit(None).cast("string")).alias("source_type"))


@register(
    "X39_source_dispatch",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'ecfr_xml' WHEN 4 THEN 'rules_listing' ELSE 'html' END AS parser FROM pages""",
)
def source_dispatch(spark, d):
    """Pages with the marks of each kind of document: a type, a name, first bytes, or what stands in the text."""
    n, html = F.col("page_id") % 6, F.coalesce("html", F.lit(""))
    url = F.when(n == 1, F.lit("https://x.org/a.XLSM?b=.pdf")).otherwise(F.col("url"))
    kind = F.when(n == 0, "application/PDF").otherwise("text/html")
    body = F.when(n == 2, F.concat(F.lit("PK"), html)).when(n == 3, F.concat(F.lit('<DIV8 N="1" TYPE="SECTION">'), html))
    body = F.coalesce(body, F.when(n == 4, F.concat(html, F.lit("FSMA Rules &amp; Guidance for Industry; Guidance for Industry &amp; Others; customTable"))).otherwise(html))
    return table(spark, d, "pages").select("page_id", R.parser_for(url, kind, F.encode(body, "UTF-8")).alias("parser"))


@register(
    "X10_registry_projection",
    """SELECT CASE WHEN event_id % 3 < 2 THEN 'k' || event_id ELSE 'src-' || left(sha256('{"text":"' || event_type || '"}'), 12) END AS chunk_id, CASE WHEN event_id % 3 = 0 THEN 'L' || user_id WHEN event_id % 3 = 1 THEN 'S' || user_id ELSE 'Document' END AS section_label,
         CASE WHEN event_id % 3 = 1 THEN 'S' || user_id ELSE 'document' END AS section_ref, CASE WHEN event_id % 3 = 0 THEN user_id::INTEGER END AS page_number, CASE WHEN event_id % 3 = 0 THEN 'C' || user_id WHEN event_id % 3 = 1 THEN 'S' || user_id ELSE 'document' END AS citation_anchor,
         CASE WHEN event_id % 3 = 1 THEN 'h' || event_id ELSE 'sha256:' || sha256(event_type) END AS text_hash, count(*) AS n FROM events GROUP BY ALL""",
)
def registry_projection(spark, d):
    """A chunk for each event in one of three spellings: camel case with an anchor, snake case, and a text alone."""
    key, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    named = lambda tag, c: F.concat(F.lit(tag), c)
    camel = F.to_json(F.struct(named("k", key).alias("chunkId"), named("L", user).alias("sectionLabel"), F.lit("").alias("section"), F.col("event_type").alias("text"), F.array(F.struct(named("C", user).alias("citation"), F.col("user_id").alias("pageNumber"))).alias("anchors")))
    snake = F.to_json(F.struct(named("k", key).alias("chunk_id"), named("S", user).alias("section"), F.col("event_type").alias("text"), named("h", key).alias("text_hash")))
    bare = F.to_json(F.struct(F.col("event_type").alias("text")))
    n = F.col("event_id") % 3
    rows = R.chunk_records(table(spark, d, "events").select(F.lit("src").alias("source_id"), F.when(n == 0, camel).when(n == 1, snake).otherwise(bare).alias("body")))
    return rows.groupBy("chunk_id", "section_label", "section_ref", "page_number", "citation_anchor", "text_hash").agg(F.count(F.lit(1)).alias("n"))


ISSUES = ["raw_pdf_bytes", "empty_chunk", "short_chunk", "large_chunk", "odd_chunk"]
TRIAGED = ["scenario-1", "fr-2022-24417-final-rule-pdf", "fda-faq-food-traceability-rule", "fda-fish-guidance-chapter-3", "x"]


@register(
    "C25_registry_triage",
    f"""SELECT doc_id, CASE WHEN i IN ('raw_pdf_bytes', 'empty_chunk') OR doc_id % 11 = 0 THEN 'blocking' WHEN i = 'short_chunk' AND doc_id % 2 = 0 THEN 'accepted_nonblocking' WHEN i = 'large_chunk' AND s = 'fda-fish-guidance-chapter-3' THEN 'accepted_nonblocking' ELSE 'needs_remediation' END AS triage_status,
          left(CASE WHEN i = 'raw_pdf_bytes' THEN 'Raw PDF' WHEN i = 'empty_chunk' THEN 'Chunk cannot' WHEN doc_id % 11 = 0 THEN 'Primary' WHEN i = 'short_chunk' AND doc_id % 2 = 0 THEN 'Known FDA' WHEN i = 'short_chunk' AND s = 'scenario-1' THEN 'Scenario' WHEN i <> 'large_chunk' THEN 'Warning'
            WHEN s = 'fr-2022-24417-final-rule-pdf' THEN 'Final-rule' WHEN s = 'fda-faq-food-traceability-rule' THEN 'FAQ table' WHEN s = 'fda-fish-guidance-chapter-3' THEN 'Fish' ELSE 'Large' END, 4) AS reason
        FROM (SELECT doc_id, ({_sql(ISSUES)})[doc_id % 5 + 1] AS i, ({_sql(TRIAGED)})[(doc_id // 5) % 5 + 1] AS s FROM documents)""",
)
def registry_triage(spark, d):
    key = F.col("doc_id")
    rank = F.when(key % 11 == 0, "codified_rule").otherwise("support")
    text = F.when(key % 2 == 0, "  May\n2023 ").otherwise(F.col("text"))
    issues = table(spark, d, "documents").select("doc_id", pick(key % 5, *ISSUES).alias("issue_type"), pick(F.floor(key / 5) % 5, *TRIAGED).alias("source_id"), rank.alias("authority_rank"), text.alias("text"))
    return R.triage(issues).select("doc_id", "triage_status", F.substring("triage_reason", 1, 4).alias("reason"))


@register(
    "P10_source_selection",
    """WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'fda-traceability-lot-code' ELSE 'ecfr-21-cfr-1-subpart-s' END AS s, '21 CFR 1.1' || (300 + o_orderkey % 12 * 5) AS r FROM orders)
       SELECT 'obligations' AS collection, NULL::INTEGER AS n, k AS chunk_id FROM c WHERE s LIKE 'ecfr%' AND right(r, 3) IN ('300', '325', '330', '335', '340', '345', '350')
       UNION ALL SELECT * FROM (SELECT 'exemption_rules', row_number() OVER (ORDER BY k)::INTEGER AS n, k FROM c WHERE s LIKE 'ecfr%' AND right(r, 3) = '305') WHERE n <= 4
       UNION ALL SELECT * FROM (SELECT 'tlc_rules', row_number() OVER (ORDER BY k)::INTEGER AS n, k FROM c WHERE s LIKE 'fda%' OR right(r, 3) IN ('320', '330', '335', '340', '345', '350')) WHERE n <= 10""",
)
def source_selection(spark, d):
    key = F.col("o_orderkey")
    section = F.concat(F.lit("21 CFR 1.1"), (300 + key % 12 * 5).cast("string"))
    source = F.when(key % 3 == 0, "fda-traceability-lot-code").otherwise("ecfr-21-cfr-1-subpart-s")
    return R.draft_chunks(table(spark, d, "orders").select(key.alias("chunk_id"), source.alias("source_id"), section.alias("section_ref"), key.alias("ordinal")))


@register("P11_approved_only", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def approved_only(spark, d):
    status = F.when(F.col("event_type") == "purchase", "approved").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(F.struct(status.alias("review_status")).alias("metadata"), "props"))
    return R.approved_records(table(spark, d, "events").withColumn("body", body)).select("event_id")


@register("P12_active", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1' AND doc_id % 5 > 0")
def active(spark, d):
    key = F.col("doc_id")
    chunks = table(spark, d, "documents").select("doc_id", F.when(key % 3 == 0, "active").otherwise("old").alias("status"), F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("citation"), F.when(key % 5 > 0, "sha256:x").otherwise("md5:x").alias("text_hash"))
    return R.usable_chunks(chunks).select("doc_id")


STEPS = ["shipping", "arriving", "packing", "departing", "storing", None]


@register(
    "X22_event_labeling",
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE array_to_string(list_filter([CASE WHEN s = 'packing' THEN 'initial_packing' END, CASE WHEN s = 'arriving' THEN 'receiving' END, CASE WHEN s IN ('shipping', 'departing') THEN 'shipping' END, CASE WHEN event_type = 'purchase' THEN 'transformation' END], lambda x: x IS NOT NULL), ',') END AS labels,
          CASE WHEN event_type = 'error' THEN 'shipping' ELSE '' END AS abstain FROM (SELECT *, ({_sql(STEPS)})[event_id % 6 + 1] AS s FROM events)""",
)
def event_labeling(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "TransformationEvent").otherwise("ObjectEvent")
    labels, abstain = R.event_labels(kind, pick(F.col("event_id") % 6, *STEPS), F.col("event_type") == "error")
    return table(spark, d, "events").select("event_id", F.array_join(labels, ",").alias("labels"), F.array_join(abstain, ",").alias("abstain"))


@register(
    "X20_parser_harness",
    f"""SELECT parser_id, count(*) AS record_count, sum(hit)::BIGINT AS tp, sum(said - hit)::BIGINT AS fp, sum(wanted - hit)::BIGINT AS fn, {_ratio_sql('sum(hit)::BIGINT', 'sum(said)::BIGINT', '1.0')} AS precision, {_ratio_sql('sum(hit)::BIGINT', 'sum(wanted)::BIGINT', '1.0')} AS recall FROM (
          SELECT 'verifier' AS parser_id, len(expected_ctes) AS wanted, len(p) AS said, hit FROM ({_EVALUATED})
          UNION ALL SELECT 'silent', len(expected_ctes), 0, 0 FROM ({_RECORDS})
          UNION ALL SELECT 'keyword', len(expected_ctes), len(k), len(list_filter(k, lambda c: list_contains(expected_ctes, c))) FROM (SELECT *, list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(coalesce(observed_text, '')), $${'|'.join(f'(?:{x})' for x in patterns)}$$) THEN '{cte}' END" for cte, patterns in P.CTE_PATTERNS)}], lambda c: c IS NOT NULL) AS k FROM ({_RECORDS}))) GROUP BY parser_id""",
)
def parser_harness(spark, d):
    """Three predictors over the same cases: none sees what is expected, nor changes a rule."""
    none = F.array().cast("array<string>")
    parsers = {"verifier": predictor, "keyword": lambda text: (P.infer_ctes(text), none), "silent": lambda text: (none, none)}
    runs = [E.evaluate(event_records(spark, d), p).withColumn("parser_id", F.lit(name)) for name, p in parsers.items()]
    return E.scores(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["parser_id"]).select("parser_id", "record_count", "tp", "fp", "fn", "precision", "recall")


_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@register("F18_sentence_split", f"SELECT doc_id, len(s)::INTEGER AS sentences, coalesce(s[1], '') AS first FROM (SELECT doc_id, {_SPLIT.format('text')} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", T.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


@register(
    "F18_examples",
    """SELECT p_partkey, p_name || '|' || lower(p_type) || '|and more' AS listed, p_brand || '|' || p_size AS bracketed, p_brand || '|' || p_name AS bullets FROM part""",
)
def examples(spark, d):
    said = F.concat(F.lit("Covered foods include, but are not limited to, "), "p_name", F.lit(", "), F.lower("p_type"), F.lit(" and and more [3]. Others don't."))
    header = F.concat(F.lit("Code (e.g., "), "p_brand", F.lit(" or mm/dd/yyyy) of the unit (example: "), F.col("p_size").cast("string"), F.lit(", if applicable)"))
    listed = F.concat(F.lit("Before • "), "p_brand", F.lit("\n•  "), "p_name", F.lit(" • "), "p_brand", F.lit(" www.fda.gov footer"))
    joined = lambda c, n: F.array_join(c, "|").alias(n)
    return table(spark, d, "part").select("p_partkey", joined(T.listed_examples(said, "covered foods"), "listed"), joined(T.bracketed_examples(header), "bracketed"), joined(T.bullets(listed), "bullets"))


HEADINGS = ["Ship Date, if available", "Quantity (if applicable)", "Phone number", "ZIP or postal code, if needed", "Name"]


@register(
    "F19_inference",
    """SELECT o_orderkey, ['date', 'number', 'phone', 'postal_code', 'text'][o_orderkey % 5 + 1] AS data_type, ['conditional', 'conditional', 'required', 'conditional', 'required'][o_orderkey % 5 + 1] AS required_status,
         CASE o_orderkey % 5 WHEN 0 THEN 'Expected when available from the source event or trading partner.' WHEN 1 THEN 'Required when applicable to the event, product, or entity context.' END AS condition FROM orders""",
)
def inference(spark, d):
    heading = F.concat_ws(" ", pick(F.col("o_orderkey") % 5, *HEADINGS), F.lower("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", T.data_type(heading).alias("data_type"), T.required_status(heading).alias("required_status"), T.condition(heading).alias("condition"))


@register(
    "F25_cell_pointer",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'Lines · row ' || l_orderkey WHEN 1 THEN '07_Other · row ' || l_orderkey END AS cell FROM lineitem""",
)
def cell_pointer(spark, d):
    n = F.col("l_linenumber") % 3
    name = F.when(n == 0, "-06_Event_Lines-r").when(n == 1, "-07_Other-r").otherwise("-06_x-q")
    ref = F.concat(F.lit("run"), name, F.col("l_orderkey").cast("string"), F.lit("-c4"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.evidence_cell(ref, {"06_event_lines": "Lines"}).alias("cell"))


@register("F28_json", """SELECT event_id, '{"k":' || (json_extract_string(props, '$.k'))::BIGINT || ',"manual":{"by":"u' || user_id || '"' || '}}' AS body FROM events""")
def json_ops(spark, d):
    by = F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"'))
    return table(spark, d, "events").select("event_id", T.json_set("props", ["manual", "by"], by).alias("body"))


@register(
    "F21_conflict_signature",
    """SELECT key, count(*) AS drafts, min(said) <> max(said) AS torn FROM (SELECT lower(p_type) || '|' || lower(p_brand) AS key, 'e' || (p_size % 3) || '|' || CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE 'b,c' END AS said FROM part) GROUP BY key""",
)
def conflict_signature(spark, d):
    """Exemption rules of one type and condition; their lists count in order, so that b,a is a,b."""
    size = F.col("p_size")
    fields = F.map_from_arrays(
        F.array(*map(F.lit, ("exemption_type", "eligibility_condition", "effect", "affected_requirements"))),
        F.array(F.concat(F.lit(" "), F.col("p_type")), F.col("p_brand"), F.concat(F.lit("E"), (size % 3).cast("string")), F.when(size % 2 == 0, "b, a").otherwise("b,c")),
    )
    rows = table(spark, d, "part").select(F.lit("exemption_rules").alias("collection"), fields.alias("fields"))
    rows = rows.select(D.conflict_key().alias("key"), D.conflict_content().alias("said"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("drafts"), (F.min("said") != F.max("said")).alias("torn"))


@register(
    "C15_single_filters",
    """SELECT 'entity_scope_not_determined' AS finding_type, c_custkey::VARCHAR AS subject, 'not_determined' AS status, 'medium' AS severity, c_mktsegment AS observed FROM customer WHERE c_custkey % 6 = 0
       UNION ALL SELECT 'product_scope_not_determined', p_partkey::VARCHAR, 'not_determined', 'medium', p_partkey::VARCHAR FROM part WHERE p_size > 45
       UNION ALL SELECT 'exemption_evidence_missing', s_suppkey::VARCHAR, 'not_determined', 'medium', s_name FROM supplier WHERE s_suppkey % 2 = 0
       UNION ALL SELECT 'tlc_assignment_gap', l_orderkey || '/' || l_linenumber, 'gap', 'high', NULL FROM lineitem WHERE l_linenumber % 4 = 0
       UNION ALL SELECT 'tlc_preservation_conflict', l_orderkey || '/' || l_linenumber, 'conflict', 'high', 'o' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 4 = 1 AND o_orderstatus <> 'F'
       UNION ALL SELECT 'lineage_gap', o_orderkey::VARCHAR, CASE WHEN o_orderstatus = 'P' THEN 'conflict' ELSE 'gap' END, 'high', o_orderpriority FROM orders WHERE o_orderstatus IN ('P', 'O')""",
)
def single_filters(spark, d):
    t = lambda name: table(spark, d, name)
    open_ = lambda when: F.when(when, "not_determined").otherwise("covered")
    scope = L.scope_findings(
        t("customer").select(F.col("c_custkey").alias("profile_id"), open_(F.col("c_custkey") % 6 == 0).alias("covered_entity_status"), F.col("c_mktsegment").alias("business_type")),
        t("part").select(F.col("p_partkey").alias("product_id"), open_(F.col("p_size") > 45).alias("status")),
    )
    claims = L.exemption_findings(t("supplier").select(F.col("s_suppkey").alias("claim_id"), F.col("s_name").alias("claim_type"), F.when(F.col("s_suppkey") % 2 == 1, True).alias("evidence_provided")))
    n = F.col("l_linenumber") % 4
    lines = t("lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line_id"), F.col("l_orderkey").alias("event_id"), F.when(n > 1, "l").alias("lot"), F.when(n == 1, "s").otherwise("").alias("source_lot"), F.when(n == 1, "o").alias("output_lot"))
    events = t("orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "transformation").otherwise("shipping").alias("event_type"))
    lineage = t("orders").select(F.col("o_orderkey").alias("lineage_id"), F.when(F.col("o_orderstatus") == "P", "conflicting").when(F.col("o_orderstatus") == "O", "gap").otherwise("complete").alias("status"), F.col("o_orderpriority").alias("source_lot"))
    return scope.unionByName(claims).unionByName(L.lot_findings(lines, events, lineage)).drop("title")


@register(
    "K8_package_metrics",
    """WITH f AS (SELECT o_custkey AS a, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT c_custkey AS audit_id, unnest(['audit_id', 'file_name', 'readiness_gate', 'findings']) AS metric, unnest([c_custkey::VARCHAR, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'passed' ELSE 'blocked' END, coalesce((SELECT sum(n) FROM f WHERE a = c_custkey), 0)::BIGINT::VARCHAR]) AS value FROM customer
       UNION ALL SELECT a, 'findings_' || s, n::VARCHAR FROM f""",
)
def package_metrics(spark, d):
    audits = table(spark, d, "customer").select(F.col("c_custkey").alias("audit_id"), F.col("c_name").alias("file_name"), (F.col("c_custkey") % 2 == 0).alias("passed"))
    return L.summary_rows(audits, table(spark, d, "orders").select(F.col("o_custkey").alias("audit_id"), F.col("o_orderstatus").alias("status")))


@register(
    "K8_export_check",
    """SELECT o_orderkey AS event_id, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'shipping' END, '') AS event_type, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') THEN 'yes' ELSE 'no' END AS has_source_document FROM orders""",
)
def export_check(spark, d):
    none = F.lit(None).cast("string")
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "shipping").alias("event_type"), none.alias("event_datetime"), none.alias("reference_record_no"))
    documents = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") == "A", "available").otherwise("pending").alias("evidence_status"))
    return L.export_check_rows(events, documents).select("event_id", "event_type", "has_source_document")
