"""Chunking, anchors and paragraph citations over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import citations as C
from tracemill.plans.registry import register, table

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_FRAGMENT = rf"(length({{0}}) <= 120 AND regexp_matches(lower({{0}}), '{C.CONDITION}') AND NOT regexp_matches(lower({{0}}), '{C.OBLIGATION}'))"


def _said(line, pos):
    """Every fifth line gets a condition, another fifth a condition and an obligation."""
    return F.when(pos % 5 == 1, F.concat(F.lit("When "), line)).when(pos % 5 == 3, F.concat(F.lit("If "), line, F.lit(" you must "))).otherwise(line)


_SAID = "CASE pos % 5 WHEN 1 THEN 'When ' || line WHEN 3 THEN 'If ' || line || ' you must ' ELSE line END"


def lines_of(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


@register(
    "F13_chunk_guard",
    f"SELECT doc_id, pos::INTEGER AS pos, {_FRAGMENT.format(_SAID)} AS fragment FROM ({_LINES})",
)
def legal_chunk_guard(spark, d):
    return lines_of(spark, d).select("doc_id", "pos", C.is_fragment(_said(F.col("line"), F.col("pos"))).alias("fragment"))


_PARTS = "[CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '21 CFR 1.' || (1300 + o_orderkey % 90) END, CASE o_orderkey % 3 WHEN 0 THEN '(a)' END, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority ELSE '' END]"


@register("X9_citation_anchor", f"SELECT o_orderkey, array_to_string(list_filter({_PARTS}, lambda p: p <> ''), ' ') AS anchor FROM orders")
def citation_anchor(spark, d):
    key = F.col("o_orderkey")
    section = F.when(key % 4 == 1, "").when(key % 4 > 1, F.concat(F.lit("21 CFR 1."), (1300 + key % 90).cast("string")))
    parts = section, F.when(key % 3 == 0, "(a)"), F.when(key % 5 == 0, F.col("o_orderpriority")).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", C.citation_anchor(*parts).alias("anchor"))


@register(
    "X8_chunking_with_rejects",
    rf"""WITH rows AS (SELECT doc_id, pos, {_STRIPPED.format(_SAID)} AS text, CASE pos % 4 WHEN 0 THEN '21 CFR 1.' || (1300 + pos) WHEN 1 THEN '' END AS named, CASE pos % 3 WHEN 0 THEN 'Label ' || pos END AS label FROM ({_LINES})),
         sided AS (SELECT *, coalesce(nullif(named, ''), label, 'document') AS section,
           CASE WHEN text = '' THEN 'blank' WHEN {_FRAGMENT.format("text")} THEN 'rejected' ELSE 'chunk' END AS side FROM rows)
       SELECT 'doc-' || doc_id AS source_id, (pos + 1)::INTEGER AS ordinal, side, section, coalesce(label, section) AS section_label,
         CASE side WHEN 'chunk' THEN 'doc-' || doc_id || '-' || regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || (pos + 1) END AS chunk_id,
         CASE side WHEN 'chunk' THEN section || CASE WHEN pos % 2 = 0 THEN ' (a)' ELSE '' END END AS citation,
         CASE side WHEN 'chunk' THEN 'sha256:' || sha256('h' || doc_id || text) END AS text_hash, CASE side WHEN 'rejected' THEN '{C.REJECTED}' END AS reason FROM sided""",
)
def legal_chunks(spark, d):
    """Every line of a document as a section of it; each comes out as a chunk, a rejected section or a blank one."""
    key, pos = F.col("doc_id").cast("string"), F.col("pos")
    sections = lines_of(spark, d).select(
        F.concat(F.lit("doc-"), key).alias("source_id"), F.concat(F.lit("h"), key).alias("source_hash"), (pos + 1).alias("ordinal"),
        F.when(pos % 3 == 0, F.concat(F.lit("Label "), pos.cast("string"))).alias("section_label"),
        F.when(pos % 4 == 0, F.concat(F.lit("21 CFR 1."), (1300 + pos).cast("string"))).when(pos % 4 == 1, "").alias("section"),
        F.when(pos % 2 == 0, "(a)").alias("paragraph"), F.lit(None).cast("string").alias("table_label"), _said(F.col("line"), pos).alias("text"),
    )
    return C.legal_chunks(sections).select("source_id", "ordinal", "side", "section", "section_label", "chunk_id", "citation", "text_hash", "reason")


MARKS = ["(a)", "(1)", "(i)", "(ii)", "(2)", "(A)", "(b)", "(1)", "(h)", "(i)", "(u)", "(v)"]
_MARKS = "[" + ", ".join(f"'{m}'" for m in MARKS) + "]"
_KIND = (
    "CASE WHEN token IS NULL THEN NULL WHEN regexp_matches(token, '^[0-9]+$') THEN 2 WHEN regexp_matches(token, '[A-Z]') AND NOT regexp_matches(token, '[a-z]') THEN 4"
    f" WHEN list_contains({C.ROMAN}, lower(token)) THEN 3 ELSE 1 END"
)
_BEFORE = "(PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) >= 3))"
_NEAREST = "last_value(CASE WHEN level <= {0} THEN struct_pack(l := level, t := token) END IGNORE NULLS) OVER " + _BEFORE
_HERE = "CASE WHEN level > {0} AND (n{0}).l = {0} THEN '(' || (n{0}).t || ')' ELSE '' END"
PARAGRAPHS = rf"""
docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
chunk AS (SELECT doc_id, lines, array_to_string(list_transform(lines, lambda x, i: ({_MARKS})[(i - 1) % 12 + 1] || ' ' || x), ' ') AS text FROM docs),
cut AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS ordinal FROM (SELECT doc_id, string_split(regexp_replace(text, '(\([A-Za-z0-9]+\))', chr(1) || '\1', 'g'), chr(1)) AS p FROM chunk)),
tokens AS (SELECT *, nullif(regexp_extract(piece, '^\(([A-Za-z0-9]+)\)', 1), '') AS token FROM cut),
kinds AS (SELECT *, {_KIND} AS kind FROM tokens),
lasts AS (SELECT *, last_value(CASE WHEN kind <= 2 THEN token END IGNORE NULLS) OVER {_BEFORE} AS last FROM kinds),
levels AS (SELECT *, CASE WHEN (token = 'i' AND last = 'h') OR (token = 'v' AND last = 'u') OR (token = 'x' AND last = 'w') THEN 1 ELSE kind END AS level FROM lasts),
near AS (SELECT *, {_NEAREST.format(1)} AS n1, {_NEAREST.format(2)} AS n2, {_NEAREST.format(3)} AS n3 FROM levels),
paragraphs AS (SELECT doc_id, ordinal, {_HERE.format(1)} || {_HERE.format(2)} || {_HERE.format(3)} || '(' || token || ')' AS path, piece FROM near WHERE token IS NOT NULL)"""
_SUPPORT = "CASE doc_id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'nowhere at all in it' WHEN 3 THEN replace(lines[1], ' ', '  ') ELSE lines[1] END"
_FLAT = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
C22_SQL = rf"""
WITH {PARAGRAPHS},
cited AS (SELECT doc_id, text, '21 CFR 1.' || doc_id AS section, {_SUPPORT} AS support, {_WORDS.format("coalesce(lines[doc_id % len(lines) + 1], '')")} AS words FROM chunk),
scored AS (SELECT c.doc_id, p.ordinal, c.section || p.path AS anchor, len(list_intersect(c.words, {_WORDS.format("p.piece")})) AS shared FROM cited c JOIN paragraphs p USING (doc_id)),
best AS (SELECT doc_id, count(*) AS candidates, list(anchor) AS there, max(shared) AS most FROM scored GROUP BY doc_id),
guessed AS (SELECT s.doc_id, list(s.anchor ORDER BY s.ordinal) AS anchors FROM scored s JOIN best b ON b.doc_id = s.doc_id AND s.shared = b.most WHERE s.shared >= 3 GROUP BY s.doc_id),
wanted AS (SELECT c.*, coalesce(b.candidates, 0) AS candidates, list_append(coalesce(b.there, []), c.section) AS there,
  CASE WHEN c.doc_id % 14 = 0 THEN [c.section || '(b)(1)', c.section || '(z)'] WHEN c.doc_id % 7 = 0 THEN [c.section || '(b)(1)'] ELSE coalesce(g.anchors, []) END AS anchors
  FROM cited c LEFT JOIN best b USING (doc_id) LEFT JOIN guessed g USING (doc_id)),
found AS (SELECT *, list_filter(anchors, lambda a: list_contains(there, a)) AS hit, list_filter(anchors, lambda a: NOT list_contains(there, a)) AS miss FROM wanted),
status AS (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 'invalid' WHEN coalesce({_STRIPPED.format("support")}, '') = '' THEN 'partial' WHEN contains(text, {_STRIPPED.format("support")}) THEN 'valid'
  WHEN contains({_FLAT.format("text")}, {_FLAT.format("support")}) THEN 'valid_normalized' ELSE 'invalid' END AS section_level_status FROM found)
SELECT doc_id AS obligation_id, section_level_status, CASE WHEN len(miss) > 0 THEN 'unresolved' WHEN len(hit) > 0 THEN 'resolved' ELSE 'section_only' END AS resolution_status,
  array_to_string(hit, ',') AS resolved, array_to_string(miss, ',') AS unresolved, candidates::INTEGER AS candidates,
  CASE WHEN doc_id % 7 = 0 THEN 'approved_target_artifact:targets-v1' ELSE 'semantic_overlap' END AS method FROM status"""


def resolutions(spark, d):
    """Every document as a section with a marker before each line, and an obligation in the words of one of its lines."""
    key = F.col("doc_id")
    section = F.concat(F.lit("21 CFR 1."), key.cast("string"))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", section.alias("section"), F.split("text", "\n", -1).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.concat(F.get(F.array(*map(F.lit, MARKS)), i % len(MARKS)), F.lit(" "), x))
    chunks = docs.select(key.alias("chunk_id"), F.lit("rules").alias("source_id"), F.col("section").alias("citation_anchor"), F.array_join(marked, " ").alias("text"))
    first = F.get("lines", F.lit(0))
    support = F.when(key % 5 == 2, "nowhere at all in it").when(key % 5 == 3, F.replace(first, F.lit(" "), F.lit("  "))).when(key % 5 != 1, first)
    source = F.when(key % 5 == 4, "elsewhere").otherwise("rules")
    cited = docs.select(
        key.alias("obligation_id"), F.lit(1).alias("citation_no"), source.alias("source_id"), key.alias("chunk_id"), F.col("section").alias("citation_anchor"),
        F.col("section").alias("section_ref"), support.alias("support_text"),
    )
    none = F.lit(None).cast("string")
    action = F.get("lines", (key % F.size("lines")).cast("int"))
    obligations = docs.select(key.alias("obligation_id"), action.alias("action"), *(none.alias(c) for c in C.QUERY_FIELDS[1:]))
    anchor = lambda path: F.concat("section", F.lit(path))
    anchors = F.when(key % 14 == 0, F.array(anchor("(b)(1)"), anchor("(z)"))).otherwise(F.array(anchor("(b)(1)")))
    targets = docs.filter("doc_id % 7 < 2").select(key.alias("obligation_id"), anchors.alias("target_anchors"), F.when(key % 7 == 0, "approved").otherwise("draft").alias("review_status"))
    return C.resolve_subparagraphs(cited, obligations, chunks, targets, "targets-v1")


@register("C22_subparagraphs", C22_SQL)
def subparagraphs(spark, d):
    joined = lambda c: F.array_join(c, ",")
    return resolutions(spark, d).select(
        "obligation_id", "section_level_status", "resolution_status", joined("resolved_subparagraph_anchors").alias("resolved"), joined("unresolved_targets").alias("unresolved"),
        F.col("candidate_count").alias("candidates"), "method",
    )


@register(
    "C22_subparagraph_summary",
    f"""SELECT *, CASE WHEN unresolved = 0 AND invalid_sections = 0 THEN 'pass' ELSE 'review_required' END AS status FROM (
         SELECT count(*) AS citations, count(*) FILTER (WHERE resolution_status = 'resolved') AS resolved, count(*) FILTER (WHERE resolution_status = 'section_only') AS section_only,
           count(*) FILTER (WHERE resolution_status = 'unresolved') AS unresolved, count(*) FILTER (WHERE section_level_status = 'invalid') AS invalid_sections FROM ({C22_SQL}))""",
)
def subparagraph_summary(spark, d):
    return C.resolution_summary(resolutions(spark, d))


@register("W7_section_paragraphs", f"WITH {PARAGRAPHS} SELECT doc_id AS chunk_id, path, count(*) AS n FROM paragraphs GROUP BY doc_id, path")
def section_paragraphs(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("chunk_id"), F.split("text", "\n", -1).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.concat(F.get(F.array(*map(F.lit, MARKS)), i % len(MARKS)), F.lit(" "), x))
    return C.paragraphs(docs.select("chunk_id", F.array_join(marked, " ").alias("text"))).groupBy("chunk_id", "path").agg(F.count(F.lit(1)).alias("n"))
