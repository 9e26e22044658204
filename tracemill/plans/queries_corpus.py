"""Corpus building and evaluation operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.scalars import sha256
from tracemill.operators import relational as R
from tracemill.plans.registry import register, table

_PARTS = "SELECT conv_id, turn, role, length(text) AS size FROM conversations"


@register(
    "X38_exact_duplicates",
    "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'kept' ELSE 'duplicate_skipped' END AS status FROM documents",
)
def exact_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sha256("text").alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))  # combined before the shuffle: one row a digest and task
    status = F.when(F.col("doc_id") == F.col("first"), "kept").otherwise("duplicate_skipped")
    return docs.join(first, "digest").select("doc_id", status.alias("status"))


@register(
    "W7_marker_paths",
    """SELECT o_custkey, string_agg(k || ',' || k || '/' || p || ',' || k || '/' || p || '/ii', ',' ORDER BY o_orderkey) AS paths
       FROM (SELECT o_custkey, o_orderkey, lower(o_orderstatus) AS k, left(o_orderpriority, 1) AS p FROM orders) GROUP BY o_custkey""",
)
def marker_paths(spark, d):
    """Paths of each customer's orders (some dozens at every scale) as nested markers: a letter, a number and a roman numeral each."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))
    marks = F.flatten(F.transform("orders", lambda o: F.array(F.lower(o["o_orderstatus"]), F.substring(o["o_orderpriority"], 1, 1), F.lit("ii"))))
    return rows.select("o_custkey", F.array_join(R.marker_paths(marks), ",").alias("paths"))


@register(
    "W8_greedy_packing",
    f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM ({_PARTS})),
        walk AS (SELECT conv_id, turn, n, 1 AS part, size AS held FROM p WHERE n = 1 UNION ALL
          SELECT p.conv_id, p.turn, p.n, CASE WHEN w.held + 2 + p.size <= 1800 THEN w.part ELSE w.part + 1 END, CASE WHEN w.held + 2 + p.size <= 1800 THEN w.held + 2 + p.size ELSE p.size END
          FROM walk w JOIN p ON p.conv_id = w.conv_id AND p.n = w.n + 1)
        SELECT conv_id, turn, part::BIGINT AS part FROM walk""",
)
def greedy_packing(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return R.pack_parts(pieces, "conv_id", ["turn", "role"], "size", 1800, 2).select("conv_id", "turn", "part")


@register(
    "X17_source_version_diff",
    """WITH a AS (SELECT source, count(*) AS h FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), b AS (SELECT source, count(*) AS h FROM documents WHERE source <> 'src3' GROUP BY 1)
       SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change
       FROM a FULL JOIN b ON a.source = b.source""",
)
def version_diff(spark, d):
    docs = table(spark, d, "documents")
    count = lambda rows: rows.groupBy("source").agg(F.count(F.lit(1)).alias("h"))
    return R.record_diff(count(docs.filter("doc_id % 3 <> 0")), count(docs.filter("source <> 'src3'")), ["source"], "h")


@register(
    "X34_tenant_projects",
    """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_custkey = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
)
def tenant_projects(spark, d):
    members = table(spark, d, "customer").filter("c_nationkey = 3 or c_custkey = 1").select(F.col("c_custkey").alias("o_custkey"))
    mine = R.with_match(table(spark, d, "orders"), members, ["o_custkey"])
    return mine.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey")  # a page of twenty
