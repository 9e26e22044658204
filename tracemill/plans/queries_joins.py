"""Join operators on the shared tables; each query names the operator that it applies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.scalars import distinct_words
from tracemill.operators import relational as R
from tracemill.plans.registry import register, table


def cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


@register(
    "J1_header_line_join",
    "SELECT l_orderkey, l_linenumber, o_orderstatus, coalesce(o_orderpriority, '') AS priority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
)
def header_line(spark, d):
    headers = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    joined = R.header_line_join(headers, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    return joined.select("l_orderkey", "l_linenumber", "o_orderstatus", F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@register(
    "J2_headers_without_lines",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
)
def headers_without_lines(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.without_match(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), lines, ["o_orderkey"])


@register(
    "J3_evidence_of_events",
    """SELECT o_orderkey AS event_id, l_linenumber AS evidence_no, l_shipdate AS shipped FROM orders
       JOIN (SELECT l_orderkey, unnest(list(l_linenumber)) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) e ON e.l_orderkey = o_orderkey
       JOIN lineitem l ON l.l_orderkey = o_orderkey AND l.l_linenumber = e.n""",
)
def evidence_of_events(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    named = lines.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ids"))
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(named, "l_orderkey")
    rows = ids.select("l_orderkey", F.explode("ids").alias("l_linenumber")).join(lines, ["l_orderkey", "l_linenumber"])
    return rows.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("evidence_no"), F.col("l_shipdate").alias("shipped"))


_PRIORITY_RULES = [("R1", ["1-URGENT", "2-HIGH"], "O"), ("R2", ["1-URGENT", "5-LOW"], "F"), ("R3", ["3-MEDIUM", "other"], "P"), ("R4", ["other"], "O")]


@register(
    "J4_obligation_mapping",
    """WITH rules(rule, priority, prefix) AS (VALUES ('R1', '1-URGENT', 'O'), ('R1', '2-HIGH', 'O'), ('R2', '1-URGENT', 'F'), ('R2', '5-LOW', 'F'), ('R3', '3-MEDIUM', 'P'))
       SELECT o_orderkey, rule FROM orders JOIN rules ON priority = o_orderpriority AND starts_with(o_orderstatus, prefix)""",
)
def obligation_mapping(spark, d):
    rules = spark.createDataFrame(_PRIORITY_RULES, "rule string, applies_to array<string>, prefix string")
    wanted = rules.select("rule", "prefix", F.explode("applies_to").alias("o_orderpriority")).filter("o_orderpriority <> 'other'")
    joined = table(spark, d, "orders").join(F.broadcast(wanted), "o_orderpriority")  # four fixed rules
    return joined.filter(F.col("o_orderstatus").startswith(F.col("prefix"))).select("o_orderkey", "rule")


@register(
    "J5_conditional_cross",
    """SELECT o_orderkey, area FROM orders, (VALUES ('records_maintenance'), ('export_readiness')) a(area) WHERE o_orderstatus = 'P'""",
)
def conditional_cross(spark, d):
    areas = spark.createDataFrame([("records_maintenance",), ("export_readiness",)], "area string")
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey").crossJoin(F.broadcast(areas))  # two constants


@register(
    "J6_prefix_join",
    """WITH scoped AS (SELECT l_orderkey || ':' || l_linenumber AS event_id, l_orderkey AS raw FROM lineitem)
       SELECT event_id, o_orderpriority AS kde_value FROM scoped JOIN orders ON o_orderkey = raw""",
)
def prefix_join(spark, d):
    scoped = table(spark, d, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"))
    scoped = scoped.withColumn("raw_id", F.substring_index("event_id", ":", 1))
    raw = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("raw_id"), F.col("o_orderpriority").alias("kde_value"))
    joined = scoped.join(raw, "raw_id")
    residual = (F.col("event_id") == F.col("raw_id")) | F.col("event_id").startswith(F.concat(F.col("raw_id"), F.lit(":")))
    return joined.filter(residual).select("event_id", "kde_value")


@register(
    "J7_upstream_membership",
    """WITH lots AS (SELECT DISTINCT lower(p_brand) AS lot FROM part WHERE p_size > 25)
       SELECT p_partkey, CASE WHEN lot IS NULL THEN 'gap' ELSE 'linked' END AS status FROM part LEFT JOIN lots ON lot = lower(trim(p_brand))""",
)
def upstream_membership(spark, d):
    part = table(spark, d, "part")
    lots = part.filter("p_size > 25").select(F.lower("p_brand").alias("lot")).distinct()
    joined = part.select("p_partkey", F.lower(F.trim("p_brand")).alias("lot")).join(lots.withColumn("known", F.lit(True)), "lot", "left")
    return joined.select("p_partkey", F.when(F.col("known").isNull(), "gap").otherwise("linked").alias("status"))


_FOODS = ["BRASS", "steel standard", "ECONOMY", "small"]


@register(
    "J8_first_food_match",
    """WITH foods(n, food) AS (VALUES (1, 'brass'), (2, 'steel standard'), (3, 'economy'), (4, 'small')),
       words AS (SELECT n, food, food AS word FROM foods UNION SELECT n, food, w FROM (SELECT n, food, unnest(string_split(food, ' ')) AS w FROM foods) WHERE length(w) > 4)
       SELECT p_partkey, arg_min(food, n) AS food FROM part JOIN words ON contains(lower(p_type), word) GROUP BY p_partkey""",
)
def first_food_match(spark, d):
    foods = spark.createDataFrame([(k, f.lower()) for k, f in enumerate(_FOODS, 1)], "n int, food string")
    long = F.filter(F.split("food", " "), lambda w: F.length(w) > 4)
    words = foods.select("n", "food", F.explode(F.array_distinct(F.concat(F.array("food"), long))).alias("word"))
    pairs = table(spark, d, "part").join(F.broadcast(words), F.contains(F.lower("p_type"), F.col("word")))  # a handful of fixed words
    return pairs.groupBy("p_partkey").agg(F.min_by("food", "n").alias("food"))


@register(
    "J9_two_pass_match",
    """WITH rules(n, name) AS (VALUES (1, 'AUTOMOBILE'), (2, 'MACHINE'), (3, 'BUILDING'), (4, 'HOUSE')),
       hit AS (SELECT c_custkey, min(struct_pack(p := CASE WHEN c_mktsegment = name THEN 0 ELSE 1 END, n := n, name := name)) AS m FROM customer JOIN rules
               ON c_mktsegment = name OR contains(c_mktsegment, name) OR contains(name, c_mktsegment) GROUP BY c_custkey)
       SELECT c_custkey, m.name AS rule, CASE m.p WHEN 0 THEN 'exact' ELSE 'contained' END AS how FROM hit""",
)
def two_pass_match(spark, d):
    rules = spark.createDataFrame([(1, "AUTOMOBILE"), (2, "MACHINE"), (3, "BUILDING"), (4, "HOUSE")], "n int, name string")
    segment = F.col("c_mktsegment")
    exact = segment == F.col("name")
    near = F.contains(segment, F.col("name")) | F.contains(F.col("name"), segment)
    pairs = table(spark, d, "customer").crossJoin(F.broadcast(rules)).filter(exact | near)  # four fixed rules
    best = pairs.groupBy("c_custkey").agg(F.min(F.struct(F.when(exact, 0).otherwise(1).alias("p"), "n", "name")).alias("m"))
    return best.select("c_custkey", F.col("m.name").alias("rule"), F.when(F.col("m.p") == 0, "exact").otherwise("contained").alias("how"))


@register(
    "J10_package_diff",
    """WITH a AS (SELECT o_orderkey AS k, md5(o_orderstatus || o_orderpriority) AS h FROM orders WHERE o_orderkey % 7 <> 0),
            b AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END || o_orderpriority) AS h FROM orders WHERE o_orderkey % 5 <> 0)
       SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change
       FROM a FULL JOIN b ON a.k = b.k""",
)
def package_diff(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    mark = lambda status: F.sha2(F.concat(status, F.col("o_orderpriority")), 256).alias("h")
    old = orders.filter("k % 7 <> 0").select("k", mark(F.col("o_orderstatus")))
    new = orders.filter("k % 5 <> 0").select("k", mark(F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return R.record_diff(old, new, ["k"], "h")


@register(
    "J11_mapping_drift",
    """WITH a AS (SELECT p_brand AS field, p_type AS kind, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY ALL),
            b AS (SELECT p_brand AS field, p_type AS kind, count(*) AS n FROM part WHERE p_size > 20 GROUP BY ALL)
       SELECT coalesce(a.field, b.field) AS field, coalesce(a.kind, b.kind) AS kind,
              CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'missing' WHEN 2 * b.n < a.n THEN 'below_floor' ELSE 'stable' END AS drift
       FROM a FULL JOIN b ON a.field = b.field AND a.kind = b.kind""",
)
def mapping_drift(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("field"), F.col("p_type").alias("kind"), "p_size")
    count = lambda rows, name: rows.groupBy("field", "kind").agg(F.count(F.lit(1)).alias(name))
    both = count(part.filter("p_size <= 25"), "a").join(count(part.filter("p_size > 20"), "b"), ["field", "kind"], "full_outer")
    drift = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(2 * F.col("b") < F.col("a"), "below_floor").otherwise("stable")
    return both.select("field", "kind", drift.alias("drift"))


@register(
    "J12_approved_but_absent",
    """SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_size <= 10 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size > 40 AND q.p_brand = part.p_brand AND q.p_type = part.p_type)""",
)
def approved_but_absent(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    return R.without_match(part.filter("p_size <= 10").distinct(), part.filter("p_size > 40"), ["p_brand", "p_type"])


@register(
    "J13_citation_status",
    """SELECT item_id, CASE WHEN d.doc_id IS NULL THEN 'missing_chunk' WHEN contains(d.text, b.text) THEN 'exact'
         WHEN contains(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g'), trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g'))) THEN 'normalized' ELSE 'unsupported' END AS status
       FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 30""",
)
def citation_status(spark, d):
    cited = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), (F.col("item_id") * 30).alias("doc_id"))
    chunks = table(spark, d, "documents").select("doc_id", "text")
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    status = (
        F.when(F.col("text").isNull(), "missing_chunk")
        .when(F.contains("text", "quote"), "exact")
        .when(F.contains(flat("text"), F.trim(flat("quote"))), "normalized")
        .otherwise("unsupported")
    )
    return cited.join(chunks, "doc_id", "left").select("item_id", status.alias("status"))


@register(
    "J14_linked_records",
    """WITH keys AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS k FROM supplier UNION SELECT s_suppkey, 'm' || (s_suppkey % 10) FROM supplier),
            recs AS (SELECT c_custkey AS r, 'n' || c_nationkey AS k FROM customer UNION SELECT c_custkey, 'm' || (c_custkey % 100) FROM customer)
       SELECT id, count(DISTINCT r) AS linked, min(r) AS first FROM keys JOIN recs USING (k) GROUP BY id""",
)
def linked_records(spark, d):
    supplier, customer = table(spark, d, "supplier"), table(spark, d, "customer")
    fan = lambda df, key, nation, n, name: df.select(
        F.col(key).alias(name), F.explode(F.array_distinct(F.array(F.concat(F.lit("n"), F.col(nation).cast("string")), F.concat(F.lit("m"), (F.col(key) % n).cast("string"))))).alias("k")
    )
    return R.linked_counts(fan(supplier, "s_suppkey", "s_nationkey", 10, "id"), fan(customer, "c_custkey", "c_nationkey", 100, "r"))


@register(
    "J15_existing_references",
    """SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def existing_references(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.with_match(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, ["o_custkey"]).dropDuplicates(["o_orderkey", "o_custkey"])


@register(
    "J16_shadow_match",
    """WITH w AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) WHERE length(word) >= 7)
       SELECT a.item_id AS draft, b.item_id AS challenge, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.item_id < b.item_id GROUP BY 1, 2""",
)
def shadow_match(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.explode(distinct_words("text", 7)).alias("word"))
    a, b = words.withColumnRenamed("item_id", "draft"), words.withColumnRenamed("item_id", "challenge")
    return a.join(b, "word").filter("draft < challenge").groupBy("draft", "challenge").agg(F.count(F.lit(1)).alias("shared"))


@register(
    "J17_latest_run_per_project",
    """WITH latest AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
            found AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS open FROM lineitem GROUP BY l_orderkey)
       SELECT c_custkey, o_orderkey AS run, o_orderstatus AS status, coalesce(open, 0) AS open FROM customer LEFT JOIN latest ON o_custkey = c_custkey AND n = 1
       LEFT JOIN found ON l_orderkey = o_orderkey""",
)
def latest_run_per_project(spark, d):
    latest = R.first_of(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    latest = latest.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count_if(F.col("l_returnflag") == "R").alias("open"))
    joined = table(spark, d, "customer").select("c_custkey").join(latest, "c_custkey", "left").join(found, "run", "left")
    return joined.select("c_custkey", "run", "status", F.coalesce("open", F.lit(0)).alias("open"))


@register(
    "J18_orphan_lines",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)",
)
def orphan_lines(spark, d):
    events = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.without_match(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), events, ["l_orderkey"])


@register(
    "J19_records_not_available",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
def records_not_available(spark, d):
    available = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.without_match(table(spark, d, "customer").select("c_custkey"), available, ["c_custkey"])


@register(
    "J20_missing_required",
    """WITH need(status, flag) AS (VALUES ('O', 'N'), ('F', 'R'), ('F', 'A'), ('P', 'N'))
       SELECT o_orderkey, flag FROM orders JOIN need ON status = o_orderstatus WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = flag)""",
)
def missing_required(spark, d):
    need = spark.createDataFrame([("O", "N"), ("F", "R"), ("F", "A"), ("P", "N")], "o_orderstatus string, flag string")
    wanted = table(spark, d, "orders").join(F.broadcast(need), "o_orderstatus").select("o_orderkey", "flag")  # four fixed rows
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag"))
    return R.without_match(wanted, seen, ["o_orderkey", "flag"])


@register(
    "J21_integrity_reconciliation",
    """WITH stored AS (SELECT nation, count(*) AS n, sum(key) AS total FROM (SELECT c_nationkey AS nation, c_custkey AS key FROM customer WHERE c_custkey % 50 <> 1) GROUP BY nation),
            packed AS (SELECT c_nationkey AS nation, count(*) AS n, sum(c_custkey) AS total FROM customer GROUP BY c_nationkey)
       SELECT n_nationkey AS nation, CASE WHEN packed.n IS NULL AND stored.n IS NULL THEN 'empty' WHEN stored.n IS NULL THEN 'missing' WHEN packed.n IS NULL THEN 'orphan'
         WHEN stored.n <> packed.n THEN 'count_mismatch' WHEN stored.total <> packed.total THEN 'hash_mismatch' ELSE 'ok' END AS issue
       FROM nation LEFT JOIN stored ON stored.nation = n_nationkey LEFT JOIN packed ON packed.nation = n_nationkey""",
)
def integrity(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    totals = lambda df, x: df.groupBy("nation").agg(F.count(F.lit(1)).alias(f"{x}_n"), F.sum("c_custkey").alias(f"{x}_t"))
    out = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    out = out.join(totals(customer.filter("c_custkey % 50 <> 1"), "stored"), "nation", "left").join(totals(customer, "packed"), "nation", "left")
    issue = (
        F.when(F.col("packed_n").isNull() & F.col("stored_n").isNull(), "empty")
        .when(F.col("stored_n").isNull(), "missing")
        .when(F.col("packed_n").isNull(), "orphan")
        .when(F.col("stored_n") != F.col("packed_n"), "count_mismatch")  # ends the comparison: rows aren't looked at
        .when(F.col("stored_t") != F.col("packed_t"), "hash_mismatch")
        .otherwise("ok")
    )
    return out.select("nation", issue.alias("issue"))


@register(
    "J22_best_score_match",
    """WITH words AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS w FROM part),
            catalog(c, w) AS (VALUES ('rings', 'ring'), ('rings', 'small'), ('rings', 'economy'), ('bolts', 'blue'), ('bolts', 'bolt'), ('bolts', 'promo')),
            hits AS (SELECT p_partkey, c, count(*) AS overlap FROM words JOIN catalog USING (w) GROUP BY ALL)
       SELECT p_partkey, m.c AS catalog, m.o AS overlap FROM (SELECT p_partkey, max(struct_pack(o := overlap, c := c)) AS m FROM hits GROUP BY p_partkey) WHERE m.o >= 2""",
)
def best_score(spark, d):
    catalog = spark.createDataFrame([("rings", ["ring", "small", "economy"]), ("bolts", ["blue", "bolt", "promo"])], "catalog string, words array<string>")
    words = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))).alias("w"))
    hits = words.join(F.broadcast(catalog.select("catalog", F.explode("words").alias("w"))), "w").groupBy("p_partkey", "catalog").agg(F.count(F.lit(1)).alias("overlap"))
    best = hits.groupBy("p_partkey").agg(F.max(F.struct("overlap", "catalog")).alias("m")).filter("m.overlap >= 2")
    return best.select("p_partkey", "m.catalog", "m.overlap")


@register(
    "J23_coverage_gaps",
    """SELECT c_custkey, 'no_orders' AS gap FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT c_custkey, 'no_open_order' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
       UNION ALL SELECT c_custkey, 'no_urgent_order' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def coverage_gaps(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    joined = customers.join(seen, "c_custkey", "left")  # one pass for the three anti-joins
    gaps = F.array_compact(
        F.array(
            F.when(F.col("open").isNull(), F.lit("no_orders")),
            F.when(F.coalesce("open", F.lit(0)) == 0, F.lit("no_open_order")),
            F.when(F.coalesce("urgent", F.lit(0)) == 0, F.lit("no_urgent_order")),
        )
    )
    return joined.select("c_custkey", F.explode(gaps).alias("gap"))
