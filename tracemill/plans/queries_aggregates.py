"""Aggregations, window-like operators, orders and set operations on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import ratio
from tracemill.operators import relational as R
from tracemill.plans.registry import register, table

_LINE_CELLS = """SELECT l_orderkey AS k, l_linenumber AS n, 1 AS pos, 'flag' AS field, l_returnflag AS v FROM lineitem
                 UNION ALL SELECT l_orderkey, l_linenumber, 2, 'status', l_linestatus FROM lineitem"""


def line_cells(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    cells = R.unpivot_cells(lines, ["k", "n"], ["flag", "status"])
    return cells.select("k", "n", F.col("column_index").alias("at"), F.col("column_name").alias("field"), F.col("raw_value").alias("v"))


@register("A1_multimap", f"WITH c AS ({_LINE_CELLS}) SELECT k, string_agg(v, ',' ORDER BY n, pos, v) FILTER (WHERE field = 'flag') AS flags, string_agg(v, ',' ORDER BY n, pos, v) FILTER (WHERE field = 'status') AS statuses FROM c GROUP BY k")
def multimap(spark, d):
    facts = R.multimap(line_cells(spark, d), "k", ["n", "at"], "field", "v")
    return facts.select("k", F.concat_ws(",", F.col("facts")["flag"]).alias("flags"), F.concat_ws(",", F.col("facts")["status"]).alias("statuses"))


@register(
    "A2_field_mapping_summary",
    """SELECT p_brand, p_type, max(p_size) AS confidence, array_to_string(list_sort(list(p_partkey))[1:25], ',') AS examples FROM part GROUP BY ALL""",
)
def mapping_summary(spark, d):
    keys = ["p_brand", "p_type"]
    part = table(spark, d, "part")
    first = R.first_rows_of(part.select(*keys, "p_partkey"), keys, [F.col("p_partkey")], 25)  # at most 25 examples is the feature
    ids = first.groupBy(*keys).agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    grouped = part.groupBy(*keys).agg(F.max("p_size").alias("confidence")).join(ids, keys)
    return grouped.select("p_brand", "p_type", "confidence", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("examples"))


@register(
    "A3_conflict_detection",
    f"WITH c AS ({_LINE_CELLS}) SELECT k, field, string_agg(DISTINCT v, ',' ORDER BY v) AS vals FROM c GROUP BY k, field HAVING count(DISTINCT v) > 1",
)
def conflict_detection(spark, d):
    return R.conflicts(line_cells(spark, d), ["k", "field"], "v").select("k", "field", F.concat_ws(",", "values").alias("vals"))


@register(
    "A4_document_profile",
    """SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles, count(*) AS turns FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) <= 100) GROUP BY conv_id""",
)
def document_profile(spark, d):
    first = R.first_rows_of(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn"), F.col("role")], 100)  # the first hundred make a profile
    grouped = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return grouped.select("conv_id", F.concat_ws(" ", F.transform("x", lambda r: r["role"])).alias("roles"), F.size("x").cast("long").alias("turns"))


_TYPES = [("function", ["the", "and", "with"]), ("romance", ["les", "que", "para"]), ("german", ["der", "und", "ein"])]


@register(
    "A5_keyword_argmax",
    """WITH k(n, kind, word) AS (VALUES (1, 'function', 'the'), (1, 'function', 'and'), (1, 'function', 'with'), (2, 'romance', 'les'), (2, 'romance', 'que'), (2, 'romance', 'para'),
         (3, 'german', 'der'), (3, 'german', 'und'), (3, 'german', 'ein')),
       c AS (SELECT doc_id, n, kind, count(*) AS hits FROM documents JOIN k ON contains(lower(text), word) GROUP BY ALL)
       SELECT d.doc_id, coalesce(m.kind, 'unknown') AS kind, coalesce(m.hits, 0) AS hits FROM documents d
       LEFT JOIN (SELECT doc_id, min(struct_pack(h := -hits, n := n, kind := kind, hits := hits)) AS m FROM c GROUP BY doc_id) b ON b.doc_id = d.doc_id""",
)
def keyword_argmax(spark, d):
    text = F.lower("text")
    hits = [sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int")) for _, words in _TYPES]
    best = F.greatest(*hits)
    kind = F.lit("unknown")
    for (name, _), h in reversed(list(zip(_TYPES, hits, strict=True))):
        kind = F.when((best > 0) & (h == best), name).otherwise(kind)
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), best.cast("long").alias("hits"))


@register(
    "A6_quality_report",
    """SELECT count(*) AS records, count(*) FILTER (WHERE p_size >= 10) AS mapped, count(*) FILTER (WHERE p_size < 15) AS low,
              (SELECT count(*) FROM (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING count(*) > 1)) AS repeated,
              CASE WHEN count(*) FILTER (WHERE p_size < 10) = 0 THEN 'pass' ELSE 'needs_review' END AS gate FROM part""",
)
def quality_report(spark, d):
    part = table(spark, d, "part")
    base = part.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("p_size") >= 10).alias("mapped"), F.count_if(F.col("p_size") < 15).alias("low"))
    again = part.groupBy("p_brand", "p_type").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    out = base.crossJoin(again)  # one row each
    return out.withColumn("gate", F.when(F.col("records") == F.col("mapped"), "pass").otherwise("needs_review"))


@register("A7_status_counters", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counters(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "A8_element_status",
    """WITH v AS (SELECT l_orderkey, l_returnflag AS flag, list_distinct(list(l_linestatus)) AS s FROM lineitem GROUP BY ALL),
            need(flag, requirement) AS (VALUES ('R', 'required'), ('A', 'conditional'), ('N', 'required'))
       SELECT o_orderkey, need.flag, CASE WHEN len(s) > 1 THEN 'conflicting' WHEN len(s) = 1 THEN 'present' WHEN requirement = 'conditional' THEN 'not_applicable' ELSE 'missing' END AS status
       FROM orders CROSS JOIN need LEFT JOIN v ON l_orderkey = o_orderkey AND v.flag = need.flag""",
)
def element_status(spark, d):
    need = spark.createDataFrame([("R", "required"), ("A", "conditional"), ("N", "required")], "flag string, requirement string")
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag")).agg(F.size(F.collect_set("l_linestatus")).alias("k"))
    rows = table(spark, d, "orders").select("o_orderkey").crossJoin(F.broadcast(need)).join(seen, ["o_orderkey", "flag"], "left")  # three fixed rows
    status = F.when(F.col("k") > 1, "conflicting").when(F.col("k") == 1, "present").when(F.col("requirement") == "conditional", "not_applicable").otherwise("missing")
    return rows.select("o_orderkey", "flag", status.alias("status"))


@register(
    "A9_export_readiness",
    """SELECT l_orderkey, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R'), '') AS missing,
              coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag <> 'R'), '') AS populated,
              CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 'ready' ELSE 'blocked' END AS status FROM lineitem GROUP BY l_orderkey""",
)
def export_readiness(spark, d):
    names = lambda keep: F.concat_ws(",", F.array_sort(F.collect_list(F.when(keep, F.col("l_linenumber")))).cast("array<string>"))
    gap = F.col("l_returnflag") == "R"
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(names(gap).alias("missing"), names(~gap).alias("populated"))
    return out.withColumn("status", F.when(F.col("missing") == "", "ready").otherwise("blocked"))


@register(
    "A10_root_cause_grouping",
    """SELECT l_orderkey, count(*) AS gaps, bool_or(kind = 'lot') AS root, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM
       (SELECT l_orderkey, 'field' AS kind FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT l_orderkey, 'lot' FROM lineitem WHERE l_tax > 0.07) GROUP BY l_orderkey""",
)
def root_cause(spark, d):
    lines = table(spark, d, "lineitem")
    fields = lines.filter("l_discount > 0.08D").select("l_orderkey", F.lit("field").alias("kind"))
    gaps = fields.unionByName(lines.filter("l_tax > 0.07D").select("l_orderkey", F.lit("lot").alias("kind")))
    kinds = F.concat_ws(",", F.array_sort(F.collect_set("kind")))
    return gaps.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("gaps"), F.bool_or(F.col("kind") == "lot").alias("root"), kinds.alias("kinds"))


@register("A11_plan_rollup", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS missing, count(*) AS n FROM nation WHERE n_regionkey = 2 HAVING count(*) > 0")
def plan_rollup(spark, d):
    missing = table(spark, d, "nation").filter("n_regionkey = 2").agg(F.array_sort(F.collect_list("n_name")).alias("x"))  # one plan's parts
    return missing.filter(F.size("x") > 0).select(F.concat_ws(",", "x").alias("missing"), F.size("x").cast("long").alias("n"))


@register(
    "A12_scope_rollup",
    """SELECT coalesce(CASE WHEN user_id % 5 <> 0 THEN user_id::VARCHAR END, '__global__') AS scope, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2""",
)
def scope_rollup(spark, d):
    scope = F.coalesce(F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")), F.lit("__global__"))
    return table(spark, d, "events").groupBy(scope.alias("scope"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@register(
    "A13_entity_first_wins",
    "SELECT o_custkey AS entity, o_orderkey AS defined_by, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
)
def entity_first(spark, d):
    first = R.first_of(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("defined_by"), F.col("o_orderstatus").alias("status"))


_GOLD = """WITH gold AS (SELECT l.doc_id, list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 1 THEN 'good' END], lambda x: x IS NOT NULL) AS e,
       list_filter([CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'trash') THEN 'toxic' END, CASE WHEN n_chars > 300 THEN 'good' END], lambda x: x IS NOT NULL) AS a
       FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def gold(spark, d):
    """Labelled documents with gold labels e and a keyword predictor's labels a; the predictor sees the text only."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    text = F.lower("text")
    pick = lambda *pairs: F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)))
    guess = F.contains(text, F.lit("idiot")) | F.contains(text, F.lit("trash"))
    return rows.select(
        "doc_id", pick((F.col("toxic") == 1, "toxic"), (F.col("quality") == 1, "good")).alias("e"), pick((guess, "toxic"), (F.col("n_chars") > 300, "good")).alias("a")
    )


@register(
    "A14_micro_precision_recall",
    _GOLD
    + """, m AS (SELECT label, count(*) FILTER (WHERE list_contains(e, label) AND list_contains(a, label)) AS tp, count(*) FILTER (WHERE NOT list_contains(e, label)) AS fp,
           count(*) FILTER (WHERE NOT list_contains(a, label)) AS fn FROM (SELECT *, unnest(list_distinct(list_concat(e, a))) AS label FROM gold) GROUP BY label)
       SELECT label, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE floor((20000 * tp + (tp + fp)) // (2 * (tp + fp))) / 10000 END AS precision,
              CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE floor((20000 * tp + (tp + fn)) // (2 * (tp + fn))) / 10000 END AS recall FROM m""",
)
def micro(spark, d):
    return R.micro_scores(gold(spark, d), "e", "a")


@register(
    "A15_set_equality",
    _GOLD + "SELECT count(*) AS n, count(*) FILTER (WHERE list_sort(e) = list_sort(a)) AS equal, count(*) FILTER (WHERE len(e) > 0) AS labelled, count(*) FILTER (WHERE len(e) > 0 AND list_sort(e) = list_sort(a)) AS equal_labelled FROM gold",
)
def set_equality(spark, d):
    same, some = F.array_sort("e") == F.array_sort("a"), F.size("e") > 0
    return gold(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("equal"), F.count_if(some).alias("labelled"), F.count_if(some & same).alias("equal_labelled")
    )


@register(
    "A16_error_report",
    _GOLD
    + """SELECT kind, count(*) AS n, min(doc_id) AS first FROM (
         SELECT doc_id, 'missed_' || unnest(list_filter(e, lambda x: NOT list_contains(a, x))) AS kind FROM gold UNION ALL
         SELECT doc_id, 'extra_' || unnest(list_filter(a, lambda x: NOT list_contains(e, x))) FROM gold) GROUP BY kind""",
)
def error_report(spark, d):
    kinds = F.concat(
        F.transform(F.array_except("e", "a"), lambda x: F.concat(F.lit("missed_"), x)), F.transform(F.array_except("a", "e"), lambda x: F.concat(F.lit("extra_"), x))
    )
    rows = gold(spark, d).select("doc_id", F.explode(kinds).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@register(
    "A17_family_metrics",
    """SELECT coalesce(lang, 'all') AS family, coalesce(source, 'all') AS source, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS passed FROM documents
       GROUP BY GROUPING SETS ((lang), (source), ())""",
)
def family_metrics(spark, d):
    docs = table(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source")
    out = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 500).alias("passed"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("family"), F.coalesce("source", F.lit("all")).alias("source"), "n", "passed")


@register(
    "A18_citation_coverage",
    """SELECT coalesce(o_orderstatus, 'total') AS collection, coalesce(status, 'all') AS status, count(*) AS n FROM
       (SELECT o_orderstatus, CASE WHEN lines IS NULL THEN 'missing' WHEN lines < 3 THEN 'partial' ELSE 'complete' END AS status FROM orders
        LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY ROLLUP (o_orderstatus, status)""",
)
def citation_coverage(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    status = F.when(F.col("lines").isNull(), "missing").when(F.col("lines") < 3, "partial").otherwise("complete")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").withColumn("status", status)
    out = rows.rollup("o_orderstatus", "status").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("o_orderstatus", F.lit("total")).alias("collection"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@register(
    "A19_registry_health",
    """SELECT severity, count(*) AS issues, count(*) FILTER (WHERE p_size % 2 = 0) AS accepted FROM
       (SELECT *, CASE WHEN p_size > 40 THEN 'high' WHEN p_size > 20 THEN 'medium' ELSE 'low' END AS severity FROM part) GROUP BY severity""",
)
def registry_health(spark, d):
    severity = F.when(F.col("p_size") > 40, "high").when(F.col("p_size") > 20, "medium").otherwise("low")
    return table(spark, d, "part").groupBy(severity.alias("severity")).agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("p_size") % 2 == 0).alias("accepted"))


@register(
    "A20_sheet_rollup",
    f"WITH c AS ({_LINE_CELLS}) SELECT n, count(DISTINCT k) AS row_count, count(DISTINCT field) AS columns, count(*) AS cells FROM c GROUP BY n",
)
def sheet_rollup(spark, d):
    return line_cells(spark, d).groupBy("n").agg(F.count_distinct("k").alias("row_count"), F.count_distinct("field").alias("columns"), F.count(F.lit(1)).alias("cells"))


@register(
    "A21_dataset_snapshot",
    "SELECT count(DISTINCT p_brand) AS brands, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, count(*) AS n FROM part",
)
def snapshot(spark, d):
    types = F.concat_ws(",", F.array_sort(F.collect_set("p_type")))
    return table(spark, d, "part").agg(F.count_distinct("p_brand").alias("brands"), types.alias("types"), F.count(F.lit(1)).alias("n"))


@register(
    "A22_dashboard",
    "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS urgent FROM orders",
)
def dashboard(spark, d):
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("total"), is_("o_orderstatus", "O").alias("open"), is_("o_orderstatus", "F").alias("done"), is_("o_orderpriority", "1-URGENT").alias("urgent")
    )


@register(
    "A23_severity_pivot",
    """SELECT o_orderpriority AS severity, count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS "Other" FROM orders GROUP BY 1""",
)
def severity_pivot(spark, d):
    bucket = F.when(F.col("o_orderstatus").isin("O", "F"), F.col("o_orderstatus")).otherwise("Other")
    rows = table(spark, d, "orders").withColumn("bucket", bucket)
    return rows.groupBy(F.col("o_orderpriority").alias("severity")).pivot("bucket", ["O", "F", "Other"]).agg(F.count(F.lit(1))).na.fill(0)


@register("A24_duplicate_references", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_references(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register(
    "A25_confidence_score",
    """SELECT o_orderkey, least(100, p) AS points, CASE WHEN p >= 90 THEN 'high' WHEN p >= 70 THEN 'medium' ELSE 'low' END AS band FROM
       (SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 35 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 25 WHEN o_totalprice > 100000 THEN 15 ELSE 0 END +
        CASE WHEN o_orderpriority < '3' THEN 25 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE 0 END) AS p FROM orders)""",
)
def confidence_score(spark, d):
    price = F.when(F.col("o_totalprice") > 200000, 25).when(F.col("o_totalprice") > 100000, 15).otherwise(0)
    points = F.when(F.col("o_orderstatus") == "F", 35).otherwise(0) + price + F.when(F.col("o_orderpriority") < "3", 25).otherwise(0)
    points = points + F.when(F.col("o_custkey") % 2 == 0, 10).otherwise(0) + F.when(F.col("o_custkey") % 3 == 0, 5).otherwise(0)
    band = F.when(points >= 90, "high").when(points >= 70, "medium").otherwise("low")
    return table(spark, d, "orders").select("o_orderkey", F.least(points, F.lit(100)).alias("points"), band.alias("band"))


@register("A26_package_composition", "SELECT r_name AS collection, string_agg(n_name, ',' ORDER BY n_name) AS payload FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def package_composition(spark, d):
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("collection"))
    rows = table(spark, d, "nation").join(region, "n_regionkey")
    return rows.groupBy("collection").agg(F.concat_ws(",", F.array_sort(F.collect_list("n_name"))).alias("payload"))


@register(
    "A27_two_stage_summary",
    _GOLD
    + """SELECT count(*) AS n, count(*) FILTER (WHERE len(a) >= 2) AS approved, count(*) FILTER (WHERE len(a) = 1) AS routed, count(*) FILTER (WHERE len(a) = 0) AS abstained,
         count(*) FILTER (WHERE len(a) >= 2 AND list_sort(e) = list_sort(a)) AS approved_right FROM gold""",
)
def two_stage(spark, d):
    k = F.size("a")
    right = (k >= 2) & (F.array_sort("e") == F.array_sort("a"))
    return gold(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(k >= 2).alias("approved"), F.count_if(k == 1).alias("routed"), F.count_if(k == 0).alias("abstained"), F.count_if(right).alias("approved_right")
    )


@register(
    "W1_sequential_ids",
    "SELECT l_orderkey, l_linenumber, l_partkey, 'check-' || lpad(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::VARCHAR, 4, '0') AS check_id FROM lineitem",
)
def sequential_ids(spark, d):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return R.numbered(table(spark, d, "lineitem"), ["l_orderkey"], order, "check-", "check_id").select("l_orderkey", "l_linenumber", "l_partkey", "check_id")


@register("W2_last_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark, d):
    return R.first_of(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@register("W3_first_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins(spark, d):
    return R.first_of(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@register("W4_longest_wins", "SELECT conv_id, role, turn, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) = 1")
def longest_wins(spark, d):
    rows = table(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    best = rows.groupBy("conv_id", "role").agg(F.max_by(F.struct("turn", "n"), F.struct("n", -F.col("turn"))).alias("b"))
    return best.select("conv_id", "role", "b.turn", "b.n")


@register("W5_next_start", "SELECT o_custkey, o_orderkey, lead(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stops_at FROM orders")
def next_start(spark, d):
    window = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey", 1, -1).over(window).alias("stops_at"))


@register(
    "W6_segmentation",
    """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations)
       SELECT conv_id, segment::BIGINT AS segment, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM s GROUP BY conv_id, segment""",
)
def segmentation(spark, d):
    cut = R.segments(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.col("role") == "user")
    return cut.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


@register("W9_latest_per_group", "SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def latest_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"))


@register(
    "W10_best_with_ties",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 3 QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) = 1",
)
def best_with_ties(spark, d):
    return R.best_with_ties(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity"), 3).select("l_orderkey", "l_linenumber", "l_quantity")


@register(
    "W11_next_version",
    "SELECT o_custkey, count(*) + 1 AS version, max(o_orderkey) AS supersedes FROM orders GROUP BY o_custkey",
)
def next_version(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) + 1).alias("version"), F.max("o_orderkey").alias("supersedes"))


@register("O1_multi_key_sort", "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name DESC, s_suppkey) AS place FROM supplier")
def multi_key(spark, d):
    window = Window.partitionBy("s_nationkey").orderBy(F.desc("s_name"), "s_suppkey")
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(window).cast("long").alias("place"))


_RANKED = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"


@register("O2_custom_rank", f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANKED}, o_orderkey) AS place FROM orders")
def custom_rank(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(4)
    window = Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(window).cast("long").alias("place"))


@register(
    "O3_severity_order",
    "SELECT event_id, list_position(['error', 'purchase', 'click', 'view'], event_type) AS by_rank, event_type AS by_name FROM events",
)
def severity_order(spark, d):
    order = F.array(*map(F.lit, ["error", "purchase", "click", "view"]))
    place = F.array_position(order, F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.when(place > 0, place.cast("int")).alias("by_rank"), F.col("event_type").alias("by_name"))


@register(
    "O4_nulls_last",
    "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END ASC NULLS LAST, c_custkey) AS place FROM customer",
)
def nulls_last(spark, d):
    window = Window.partitionBy("c_nationkey").orderBy(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).asc_nulls_last(), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(window).cast("long").alias("place"))


@register("O5_top_caps", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_caps(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)  # a top-50 report


@register("O6_precedence_order", "SELECT o_orderkey, coalesce(list_position(['F', 'O'], o_orderstatus), 999)::INTEGER AS place FROM orders")
def precedence(spark, d):
    place = F.array_position(F.array(F.lit("F"), F.lit("O")), F.col("o_orderstatus")).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.when(place > 0, place).otherwise(999).alias("place"))


@register(
    "O7_authority_order",
    "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 9 END, doc_id) = 1",
)
def authority(spark, d):
    rank = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(9)
    return R.first_of(table(spark, d, "documents").select("source", "doc_id", "lang"), ["source"], [rank, F.col("doc_id")]).select("source", "doc_id")


@register(
    "U1_union_all",
    "SELECT kind, count(*) AS n FROM (SELECT 'late' AS kind FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-01' UNION ALL SELECT 'returned' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'open' FROM orders WHERE o_orderstatus = 'O') GROUP BY kind",
)
def union_all(spark, d):
    lines = table(spark, d, "lineitem")
    parts = [lines.filter("l_shipdate > timestamp'1998-06-01'"), lines.filter("l_returnflag = 'R'"), table(spark, d, "orders").filter("o_orderstatus = 'O'")]
    rows = [p.select(F.lit(k).alias("kind")) for k, p in zip(("late", "returned", "open"), parts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("U2_set_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    of = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("O").subtract(of("F"))


@register("U3_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersection(spark, d):
    of = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("O").intersect(of("P"))


@register(
    "U4_ordered_distinct",
    """SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY n) AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey HAVING count(DISTINCT n) = count(*)""",
)
def ordered_distinct(spark, d):
    flags = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: s["l_returnflag"])
    seen = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("n"))
    clear = seen.groupBy("l_orderkey").agg(F.count_distinct("n").alias("a"), F.count(F.lit(1)).alias("b")).filter("a = b").select("l_orderkey")  # ties have no order
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(flags), "").alias("flags"))
    return lists.join(clear, "l_orderkey", "left_semi")


@register(
    "U5_union_of_sets",
    "SELECT n_regionkey, count(*) AS members FROM (SELECT n_regionkey, s_suppkey AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT n_regionkey, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1",
)
def union_of_sets(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    side = lambda t, n, k: table(spark, d, t).select(F.col(n).alias("n_nationkey"), F.col(k).alias("k")).join(nation, "n_nationkey").select("n_regionkey", "k")
    return side("supplier", "s_nationkey", "s_suppkey").union(side("customer", "c_nationkey", "c_custkey")).distinct().groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("members"))


@register(
    "F27_ratio",
    "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS p, count(*) AS q, floor((20000 * count(*) FILTER (WHERE o_orderstatus = 'O') + count(*)) // (2 * count(*))) / 10000 AS share FROM orders GROUP BY o_custkey",
)
def share(spark, d):
    out = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("p"), F.count(F.lit(1)).alias("q"))
    return out.withColumn("share", ratio("p", "q"))
