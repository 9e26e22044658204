"""Gates for drafted records and explanations: what they claim is held against the chunks that they cite.

A draft meets its citations once, gathered by record, and each citation meets its chunk through the chunk's id; every gate is then an
expression over the row, and names its reason. Conflicts compare the least and the greatest content of a key, so no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import collapse
from tracemill.operators.citations import span_status

# --- Fixed values: fields whose text has to be supported, by collection.
CLAIMS = {
    "obligations": ["subject", "condition", "action", "object", "required_output", "deadline"],
    "exemption_rules": ["exemption_type", "eligibility_condition", "effect", "reviewer_warning"],
    "tlc_rules": ["assignment_rule", "preservation_rule", "source_reference_rule", "transformation_handling", "uniqueness_rule", "lineage_rule"],
}
# --- Fixed values: fields that two drafts of one matter share, and fields in which they must not differ then. Those in LISTS are comma-separated.
KEYS = {
    "obligations": ["subject", "condition", "object", "applies_to_ctes"],
    "exemption_rules": ["exemption_type", "eligibility_condition"],
    "tlc_rules": ["rule_kind", "applies_to_food_scope", "applies_to_ctes"],
}
CONTENTS = {
    "obligations": ["action", "required_output", "deadline"],
    "exemption_rules": ["effect", "affected_requirements"],
    "tlc_rules": ["assignment_rule", "preservation_rule", "source_reference_rule", "transformation_handling", "uniqueness_rule", "lineage_rule"],
}
LISTS = ["applies_to_ctes", "affected_requirements"]
# --- Fixed values: words that support nothing, the least words shared, and the share of a claim's words that has to be found.
STOP_WORDS = ["a", "an", "and", "are", "as", "be", "by", "for", "from", "if", "in", "is", "must", "of", "or", "the", "to", "under", "with", "you", "your"]
LEAST_WORDS, SHARE = 2, 0.35

_TEXTS = "array<string>"
_ISSUES = "array<struct<code:string,fields:array<string>>>"


def plain(text: Column) -> Column:
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def content_words(text: Column) -> Column:
    """Words of three letters or digits or more, repeated ones too."""
    return F.filter(F.regexp_extract_all(text, F.lit("([a-z0-9]{3,})"), 1), lambda w: ~w.isin(STOP_WORDS))


def supported(value: Column, corpus: Column, corpus_words: Column) -> Column:
    """Whether a corpus has the value as it stands, or enough of its words: two, or 0.35 of the different ones if that is more."""
    text = plain(value)
    words = content_words(text)
    shared = F.size(F.filter(words, lambda w: F.array_contains(corpus_words, w)))
    enough = shared >= F.greatest(F.lit(LEAST_WORDS), F.floor(F.size(F.array_distinct(words)) * F.lit(SHARE)).cast("int"))
    return (text == "") | F.contains(corpus, text) | (F.size(words) == 0) | enough


def _by_collection(table: dict[str, list[str]]) -> Column:
    pairs = [x for name, fields in table.items() for x in (F.lit(name), F.array(*map(F.lit, fields)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), "collection"), F.array().cast(_TEXTS))


def _joined(fields: Column) -> Column:
    """The values of these fields, plain, joined by bars; lists in order."""

    def value(name):
        text = plain(F.try_element_at("fields", name))
        return F.when(name.isin(LISTS), F.array_join(F.array_sort(F.split(text, r"\s*,\s*")), ",")).otherwise(text)

    return F.array_join(F.transform(fields, value), "|")


def conflict_key() -> Column:
    """What two drafts of one matter share, from their fields."""
    return _joined(_by_collection(KEYS))


def conflict_content() -> Column:
    """What two drafts of one matter must not differ in."""
    return _joined(_by_collection(CONTENTS))


def gate_drafts(drafts: DataFrame, citations: DataFrame, chunks: DataFrame, schemas: DataFrame) -> DataFrame:
    """drafts with issues (code, fields), outcome, confidence and review_status.

    drafts: record_id, collection, fields (map of texts), extraction_method, review_status, confidence. citations: record_id, citation_no, source_id, chunk_id, citation_anchor, support_text. chunks: as in
    span_status. schemas: collection, field, required. The gates, each an issue with its code: schema_validation_failed (a required field is missing or empty, a field or
    collection unknown; nothing else is asked then), not_ai_assisted, ai_attempted_approval, citation_coverage_failed (no citation, or one that isn't valid),
    unsupported_claim (with the fields). What passes them conflicts (conflict_detected) if another accepted draft of the same matter says
    something else. outcome: accepted, rejected or conflict. A null method or status is none; a record without an id has no citations.
    """
    wanted = schemas.groupBy("collection").agg(F.collect_set("field").alias("_known"), F.collect_set(F.when(F.col("required"), F.col("field"))).alias("_required"))  # a schema's own size
    part = F.struct("citation_no", "span_status", "support_text", F.col("chunk_text"))
    cited = span_status(citations, chunks).groupBy("record_id").agg(F.array_sort(F.collect_list(part)).alias("_cited"))  # as many as the record has
    rows = drafts.join(F.broadcast(wanted), "collection", "left").join(cited, "record_id", "left")

    none = F.array().cast(_TEXTS)
    empty = F.filter("_required", lambda f: F.trim(F.coalesce(F.try_element_at("fields", f), F.lit(""))) == "")
    strange = F.array_except(F.map_keys(F.coalesce("fields", F.create_map().cast("map<string,string>"))), "_known")
    broken = F.when(F.col("_known").isNull(), F.array("collection")).otherwise(F.array_sort(F.array_union(empty, strange)))
    rows = rows.withColumns({"_broken": broken, "_cited": F.coalesce("_cited", F.array().cast("array<struct<citation_no:int,span_status:string,support_text:string,chunk_text:string>>"))})

    valid = lambda c: c["span_status"].isin("valid", "valid_normalized")
    texts = lambda a, name: F.array_join(F.transform(a, lambda c: F.coalesce(c[name], F.lit(""))), " ")
    corpus = plain(F.concat_ws(" ", texts(F.filter("_cited", valid), "support_text"), texts(F.col("_cited"), "chunk_text")))
    rows = rows.withColumn("_corpus", corpus)
    rows = rows.withColumn("_words", F.array_distinct(content_words(F.col("_corpus"))))
    held = lambda f: supported(F.coalesce(F.try_element_at("fields", f), F.lit("")), F.col("_corpus"), F.col("_words"))
    rows = rows.withColumn("_unsupported", F.filter(_by_collection(CLAIMS), lambda f: ~held(f)))

    issue = lambda when, code, fields=none: F.when(when, F.struct(F.lit(code).alias("code"), fields.alias("fields")))
    uncovered = (F.size("_cited") == 0) | F.exists("_cited", lambda c: ~valid(c))
    gates = F.array_compact(
        F.array(
            issue(~F.col("extraction_method").eqNullSafe("ai_assisted"), "not_ai_assisted"),
            issue(F.col("review_status").eqNullSafe("approved"), "ai_attempted_approval"),
            issue(uncovered, "citation_coverage_failed"),
            issue(F.size("_unsupported") > 0, "unsupported_claim", F.col("_unsupported")),
        )
    )
    schema = F.array(F.struct(F.lit("schema_validation_failed").alias("code"), F.col("_broken").alias("fields")))
    rows = rows.withColumn("issues", F.when(F.size("_broken") > 0, schema).otherwise(gates).cast(_ISSUES))

    passed = F.size("issues") == 0
    rows = rows.withColumns({"_key": F.when(passed, conflict_key()), "_content": F.when(passed, conflict_content())})
    said = rows.filter(passed).groupBy("collection", "_key").agg(F.min("_content").alias("_least"), F.max("_content").alias("_most"))
    torn = said.filter("_least <> _most").select("collection", "_key", F.lit(True).alias("_torn"))
    rows = rows.join(torn, ["collection", "_key"], "left").withColumn("_torn", F.coalesce("_torn", F.lit(False)))
    conflict = F.array(F.struct(F.lit("conflict_detected").alias("code"), none.alias("fields"))).cast(_ISSUES)
    outcome = F.when(F.col("_torn"), "conflict").when(passed, "accepted").otherwise("rejected")
    judged = (F.size("_broken") == 0) & (outcome != "accepted")  # a broken record isn't marked
    return rows.select(
        "record_id", "collection", outcome.alias("outcome"), F.when(F.col("_torn"), conflict).otherwise(F.col("issues")).alias("issues"),
        F.when(judged, F.when(F.col("_torn"), "conflict").otherwise("unsupported")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(judged, F.when(F.col("_torn"), "conflict_detected").otherwise("rejected")).otherwise(F.col("review_status")).alias("review_status"),
    )


def grounding(explanations: DataFrame) -> DataFrame:
    """explanations (plain, why, section_ref, support_text, ...) with stray (sections of the rule that they name but don't cite) and problem.

    problem: uncited_section, not_grounded (the plain text shares no word of four letters with the rule's), or null. Without a rule's text only sections are asked about.
    """
    sections = lambda *c: F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *c), F.lit(r"(1\.1\d{3})"), 1))
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{4,})"), 1)
    rows = explanations.withColumn("stray", F.array_sort(F.array_except(sections("plain", "why"), sections("section_ref"))))
    support = words("support_text")
    bare = (F.size(support) > 0) & ~F.arrays_overlap(support, words("plain"))
    return rows.withColumn("problem", F.when(F.size("stray") > 0, "uncited_section").when(bare, "not_grounded"))
