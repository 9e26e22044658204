"""Draft gates, grounding, scenario regression and canonical hashes over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import canonical as K
from tracemill.operators import drafts as D
from tracemill.operators import regression as R
from tracemill.plans.registry import register, table

_FLAT = r"trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in D.STOP_WORDS) + "]"
_TOKENS = "list_filter(regexp_extract_all({0}, '[a-z0-9]{{3,}}'), lambda w: NOT list_contains(" + _STOP + ", w))"


def draft_parts(spark, d):
    """A draft for each document, about its own lines: obligations and lot rules in turn, with faults by its id."""
    key, none = F.col("doc_id"), F.lit(None).cast("string")
    docs = table(spark, d, "documents").filter("text is not null").withColumn("lines", F.split("text", "\n", -1)).withColumn("first", F.get("lines", F.lit(0)))
    other = F.get("lines", (key % F.size("lines")).cast("int"))
    pairs = lambda *kv: F.map_from_arrays(F.array(*(F.lit(k) for k, _ in kv)), F.array(*(v for _, v in kv)))
    action = F.when(key % 5 == 0, "launch a blockchain satellite").otherwise(other)
    subject = F.when(key % 10 == 1, "").otherwise(F.lit("You"))
    duty = pairs(("subject", subject), ("condition", F.substring("first", 1, 60)), ("action", action), ("object", other), ("deadline", none), ("applies_to_ctes", F.lit("shipping")))
    rule = pairs(("rule_kind", F.lit("assignment")), ("applies_to_food_scope", F.col("lang")), ("applies_to_ctes", F.lit("cooling, harvesting")), ("assignment_rule", F.col("source")), ("lineage_rule", other))
    strange = F.when(key % 9 == 2, pairs(("extra", F.lit("x")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kind = F.when(key % 2 == 0, "obligations").otherwise("tlc_rules")
    drafts = docs.select(
        key.alias("record_id"), kind.alias("collection"), F.map_concat(F.when(key % 2 == 0, duty).otherwise(rule), strange).alias("fields"),
        F.when(key % 7 == 0, "deterministic").otherwise("ai_assisted").alias("extraction_method"), F.when(key % 8 == 0, "approved").otherwise("draft").alias("review_status"), F.lit("medium").alias("confidence"),
    )
    support = F.when(key % 6 == 1, none).when(key % 6 == 2, "nowhere at all in it").otherwise(F.col("first"))
    cited = docs.filter("doc_id % 11 > 0").select(key.alias("record_id"), F.lit(1).alias("citation_no"), F.lit("rules").alias("source_id"), key.alias("chunk_id"), none.alias("citation_anchor"), support.alias("support_text"))
    chunks = docs.select(key.alias("chunk_id"), F.lit("rules").alias("source_id"), none.alias("citation_anchor"), "text")
    fields = {"obligations": [*D.CLAIMS["obligations"], "applies_to_ctes"], "tlc_rules": [*D.CLAIMS["tlc_rules"], "rule_kind", "applies_to_food_scope", "applies_to_ctes"]}
    schemas = spark.createDataFrame([(c, f, f in ("subject", "rule_kind")) for c, fs in fields.items() for f in fs], "collection string, field string, required boolean")
    return drafts, cited, chunks, schemas


def _held(value):
    """SQL: whether corpus and its words support a value that is already flat."""
    words = _TOKENS.format(value)
    shared = f"len(list_filter({words}, lambda w: list_contains(words, w)))"
    return f"({value} = '' OR contains(corpus, {value}) OR len({words}) = 0 OR {shared} >= greatest(2, floor(len(list_distinct({words})) * 0.35::DOUBLE)))"


_OTHER = "lines[doc_id % len(lines) + 1]"
_ACTION = f"CASE WHEN doc_id % 5 = 0 THEN 'launch a blockchain satellite' ELSE {_OTHER} END"
_SUPPORT = "CASE doc_id % 6 WHEN 1 THEN NULL WHEN 2 THEN 'nowhere at all in it' ELSE lines[1] END"
_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_COLLAPSED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
C17_SQL = rf"""
WITH docs AS (SELECT doc_id, lang, source, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
spans AS (SELECT *, {_SUPPORT} AS support, doc_id % 11 > 0 AS cited FROM docs),
judged AS (SELECT *, cited AND coalesce({_STRIPPED.format("support")}, '') <> '' AND (contains(text, {_STRIPPED.format("support")}) OR contains({_COLLAPSED.format("text")}, {_COLLAPSED.format("support")})) AS valid FROM spans),
corpora AS (SELECT *, {_FLAT.format("CASE WHEN valid THEN support || ' ' ELSE ' ' END || CASE WHEN cited THEN text ELSE '' END")} AS corpus,
  {_FLAT.format("'You'")} AS subject, {_FLAT.format("lines[1][1:60]")} AS condition, {_FLAT.format(_ACTION)} AS action, {_FLAT.format(_OTHER)} AS object, {_FLAT.format("source")} AS assignment, doc_id % 2 = 0 AS duty FROM judged),
worded AS (SELECT *, list_distinct({_TOKENS.format("corpus")}) AS words FROM corpora),
claims AS (SELECT *, list_filter(CASE WHEN duty THEN [CASE WHEN NOT {_held("subject")} THEN 'subject' END, CASE WHEN NOT {_held("condition")} THEN 'condition' END, CASE WHEN NOT {_held("action")} THEN 'action' END, CASE WHEN NOT {_held("object")} THEN 'object' END]
  ELSE [CASE WHEN NOT {_held("assignment")} THEN 'assignment_rule' END, CASE WHEN NOT {_held("object")} THEN 'lineage_rule' END] END, lambda f: f IS NOT NULL) AS unsupported,
  list_filter([CASE WHEN doc_id % 9 = 2 THEN 'extra' END, CASE WHEN duty AND doc_id % 10 = 1 THEN 'subject' END], lambda f: f IS NOT NULL) AS broken FROM worded),
issued AS (SELECT *, CASE WHEN len(broken) > 0 THEN 'schema_validation_failed(' || array_to_string(broken, '+') || ')' ELSE array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'not_ai_assisted()' END, CASE WHEN doc_id % 8 = 0 THEN 'ai_attempted_approval()' END,
  CASE WHEN NOT valid THEN 'citation_coverage_failed()' END, CASE WHEN len(unsupported) > 0 THEN 'unsupported_claim(' || array_to_string(unsupported, '+') || ')' END], lambda f: f IS NOT NULL), ' ') END AS issues,
  CASE WHEN duty THEN 'd|' || subject || '|' || condition || '|' || object ELSE 'r|' || lang END AS key, CASE WHEN duty THEN action ELSE assignment || '|' || object END AS said FROM claims),
torn AS (SELECT key FROM issued WHERE issues = '' GROUP BY key HAVING min(said) <> max(said)),
final AS (SELECT i.*, issues = '' AND t.key IS NOT NULL AS conflict FROM issued i LEFT JOIN torn t USING (key))
SELECT doc_id AS record_id, CASE WHEN conflict THEN 'conflict' WHEN issues = '' THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN conflict THEN 'conflict_detected()' ELSE issues END AS issues,
  CASE WHEN conflict THEN 'conflict_detected' WHEN issues <> '' AND len(broken) = 0 THEN 'rejected' WHEN doc_id % 8 = 0 THEN 'approved' ELSE 'draft' END AS review_status FROM final"""


@register("C17_draft_gates", C17_SQL)
def draft_gates(spark, d):
    said = F.transform("issues", lambda i: F.concat(i["code"], F.lit("("), F.array_join(i["fields"], "+"), F.lit(")")))
    return D.gate_drafts(*draft_parts(spark, d)).select("record_id", "outcome", F.array_join(said, " ").alias("issues"), "review_status")


_SECTIONS = r"list_distinct(regexp_extract_all({0}, '1\.1\d{{3}}'))"
_LONG_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}')"


@register(
    "F24_grounding",
    rf"""SELECT item_id, array_to_string(stray, ',') AS stray, CASE WHEN len(stray) > 0 THEN 'uncited_section' WHEN len({_LONG_WORDS.format("support")}) > 0 AND NOT list_has_any({_LONG_WORDS.format("support")}, {_LONG_WORDS.format("plain")}) THEN 'not_grounded' END AS problem FROM (
          SELECT *, list_sort(list_filter({_SECTIONS.format("plain || ' ' || why")}, lambda s: NOT list_contains({_SECTIONS.format("section")}, s))) AS stray FROM (
            SELECT item_id, b.text AS plain, 'see 1.1' || (300 + item_id % 7) || ' and 1.1302' AS why, '21 CFR 1.1' || (300 + item_id % 5) || ', 1.1302' AS section, d.text AS support FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id * 30))""",
)
def grounding(spark, d):
    key = F.col("item_id")
    docs = table(spark, d, "documents").select((F.col("doc_id") / 30).alias("item_id"), F.col("text").alias("support_text"))
    rows = table(spark, d, "benchmark").withColumnRenamed("text", "plain").join(docs, "item_id", "left")
    why = F.concat(F.lit("see 1.1"), (300 + key % 7).cast("string"), F.lit(" and 1.1302"))
    section = F.concat(F.lit("21 CFR 1.1"), (300 + key % 5).cast("string"), F.lit(", 1.1302"))
    return D.grounding(rows.withColumns({"why": why, "section_ref": section})).select("item_id", F.array_join("stray", ",").alias("stray"), "problem")


TYPES = [*R.KDE_BY_CTE, R.PLAN_EVENT, "flying"]
_T = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_C = "[" + ", ".join(f"'{t}'" for t in R.KDE_BY_CTE) + "]"
_K = "[" + ", ".join(f"'{t}'" for t in R.KDE_BY_CTE.values()) + "]"
_KDE = f"({_K})[list_position({_C}, {{0}})]"
_ASSIGNING = "({0} IN ('" + "', '".join(R.ASSIGNING) + "'))"
UNAPPROVED = R.KDE_BY_CTE["transformation"]
_EVENTS = f"""SELECT o_orderkey, t[o_orderkey % 9 + 1] AS c1, CASE WHEN o_orderkey % 2 = 0 THEN t[(o_orderkey * 5 + 2) % 9 + 1] END AS c2, CASE WHEN o_orderkey % 3 = 0 THEN t[(o_orderkey // 3) % 9 + 1] END AS c3
  FROM (SELECT o_orderkey, {_T} AS t FROM orders)"""
_BUILT = f"""SELECT *, list_filter([k1, CASE WHEN k2 IS DISTINCT FROM k1 THEN k2 END, CASE WHEN k3 IS DISTINCT FROM k1 AND k3 IS DISTINCT FROM k2 THEN k3 END], lambda k: k IS NOT NULL) AS kde,
    coalesce({_ASSIGNING.format("c1")}, false) OR coalesce({_ASSIGNING.format("c2")}, false) OR coalesce({_ASSIGNING.format("c3")}, false) AS assigns
  FROM (SELECT *, {_KDE.format("c1")} AS k1, {_KDE.format("c2")} AS k2, {_KDE.format("c3")} AS k3 FROM ({_EVENTS}))"""


def marks(spark, d):
    """A scenario of one to three events for each order; cooling has no fields, and flying is no event type."""
    key = F.col("o_orderkey")
    pick = lambda n: F.get(F.array(*map(F.lit, TYPES)), (n % 9).cast("int"))
    types = F.array_compact(F.array(pick(key), F.when(key % 2 == 0, pick(key * 5 + 2)), F.when(key % 3 == 0, pick(F.floor(key / 3)))))
    events = F.transform(types, lambda c, i: F.struct(F.concat(F.lit("e"), (i + 1).cast("string")).alias("event_id"), c.alias("cte_type")))
    fields = spark.createDataFrame([(c, [f"{c}_date"]) for c in R.KDE_BY_CTE if c != "cooling"], "cte string, field_keys array<string>")
    return R.benchmarks(table(spark, d, "orders").select(key.alias("benchmark_id"), events.alias("events")), fields)


@register(
    "X37_regression_benchmarks",
    f"""SELECT o_orderkey AS benchmark_id, array_to_string(list_concat(list_concat(['{R.SCOPE}', '{R.PLAN}'], kde), list_concat(CASE WHEN assigns THEN ['{R.ASSIGNMENT}'] ELSE [] END, ['{R.RECORDS[0]}', '{R.RECORDS[1]}', '{R.EXPORT}'])), ',') AS expected,
          (CASE WHEN c1 IN ({_C[1:-1]}) AND c1 <> 'cooling' THEN 1 ELSE 0 END + CASE WHEN c2 IN ({_C[1:-1]}) AND c2 <> 'cooling' THEN 1 ELSE 0 END + CASE WHEN c3 IN ({_C[1:-1]}) AND c3 <> 'cooling' THEN 1 ELSE 0 END)::INTEGER AS field_keys FROM ({_BUILT})""",
)
def regression_benchmarks(spark, d):
    keys = F.size(F.flatten(F.transform("events", lambda e: e["expected_kde_field_keys"])))
    return marks(spark, d).select("benchmark_id", F.array_join("expected_obligation_ids", ",").alias("expected"), keys.alias("field_keys"))


_BAD = "({0} IN ('flying', 'cooling', 'transformation'))"


@register(
    "C20_scenario_regression",
    f"""SELECT o_orderkey AS benchmark_id, CASE WHEN failed = '' THEN 'pass' ELSE 'fail' END AS status, failed FROM (SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 < 2 THEN 'citations_complete' END,
          CASE WHEN coalesce({_BAD.format("c1")}, false) OR coalesce({_BAD.format("c2")}, false) OR coalesce({_BAD.format("c3")}, false) THEN 'event_contract' END, CASE WHEN list_contains(kde, '{UNAPPROVED}') THEN 'expected_obligations_approved' END], lambda f: f IS NOT NULL), ',') AS failed FROM ({_BUILT}))""",
)
def scenario_regression(spark, d):
    """Citations of every fifth scenario are partial, of another fifth unknown; one obligation isn't approved."""
    key = F.col("o_orderkey")
    coverage = table(spark, d, "orders").filter("o_orderkey % 5 > 0").select(key.alias("benchmark_id"), F.when(key % 5 == 1, "partial").otherwise("complete").alias("coverage_status"))
    every = [R.SCOPE, R.PLAN, R.ASSIGNMENT, *R.RECORDS, R.EXPORT, *R.KDE_BY_CTE.values()]
    approved = spark.createDataFrame([(a,) for a in every if a != UNAPPROVED], "obligation_id string")
    return R.run_regression(marks(spark, d), coverage, approved).select("benchmark_id", "status", F.array_join("failed_checks", ",").alias("failed"))


@register(
    "F17_canonical_hash",
    """SELECT c_custkey, sha256('{"balance":' || c_acctbal || ',"name":"' || c_name || '\\n\\u00e9","orders":[' || coalesce(orders, '') || '],"tags":{"a":null,"z":' || c_nationkey || '}}') AS digest FROM customer
       LEFT JOIN (SELECT o_custkey, string_agg('{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","urgent":' || (o_orderpriority = '1-URGENT') || '}', ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def canonical_hash(spark, d):
    """A hash of each customer as a nested value: its orders (some dozens at every scale), a map and a text that needs escapes."""
    one = F.struct((F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key"))
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("o")))).alias("orders"))
    orders = orders.withColumn("orders", F.transform("orders", lambda x: x["o"]))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left")
    rows = rows.select(
        "c_custkey", F.coalesce("orders", F.array().cast(orders.schema["orders"].dataType)).alias("orders"), F.concat("c_name", F.lit("\né")).alias("name"),
        F.col("c_acctbal").alias("balance"), F.create_map(F.lit("z"), F.col("c_nationkey"), F.lit("a"), F.lit(None)).alias("tags"),
    )
    return rows.select("c_custkey", K.digest(K.canonical_row(rows, ["tags", "orders", "name", "balance"])).alias("digest"))
