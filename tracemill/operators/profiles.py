"""Mapping profiles and rule packages: drafts from suggestions, approved profiles with a hash, packages with the versions of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.canonical import canonical_json, digest
from tracemill.functions.scalars import sha256

# --- Fixed values: confidence under which a mapping is asked about, and how many examples and evidence ids a draft carries.
SURE, MOST_EXAMPLES, MOST_IDS = 0.8, 10, 25
CONFIRM = "Confirm this source column before using it in deterministic audit execution."
# --- Fixed values: areas of an audit that need a rule.
AREAS = [
    "entity_scope", "product_scope", "exemptions", "traceability_plan", "harvest", "cooling", "initial_packing", "first_land_based_receiving", "shipping", "receiving",
    "transformation", "tlc_lineage", "records_availability",
]


def mapping_drafts(suggestions: DataFrame, records: DataFrame) -> DataFrame:
    """A draft for each suggested column: its first ten examples in the order of the records, and a question unless it is sure.

    suggestions: source_sheet, source_column, field_key, confidence, method. records: source_sheet, source_column, ordinal, normalized_value. Examples are the first ten different
    values by their first place: each value is first combined to its place, and ten of a column are kept by rank, so no column is gathered.
    """
    keys = ["source_sheet", "source_column"]
    real = records.filter(F.coalesce("normalized_value", F.lit("")) != "")
    first = real.groupBy(*keys, "normalized_value").agg(F.min("ordinal").alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "normalized_value"))).filter(F.col("n") <= MOST_EXAMPLES)
    kept = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "normalized_value"))), lambda x: x["normalized_value"]).alias("examples"))
    none = F.array().cast("array<string>")
    rows = suggestions.join(kept, keys, "left").withColumn("examples", F.coalesce("examples", none))
    asked = F.when(F.coalesce("confidence", F.lit(0.0)) < SURE, F.array(F.lit(CONFIRM))).otherwise(none)
    kind = F.when(F.col("method") == "spreadsheet_header", "deterministic_header_mapping_draft").otherwise("ai_assisted_mapping_draft")
    return rows.select(*keys, F.col("field_key").alias("proposed_canonical_field"), "confidence", "examples", asked.alias("reviewer_questions"), kind.alias("extraction_method"))


def approved_profiles(drafts: DataFrame, owner: list[str], prefix: str = "approved", version: int = 1) -> DataFrame:
    """(owner, approved, pending, rejected, profile_hash): a profile for each owner, its approved mappings in the order of their drafts, and a hash of what it says.

    drafts: owner, draft_id, sheet_pattern, source_column, canonical_field, confidence, evidence_ids, review_status. The hash is that of the canonical JSON, so it depends on neither the order of rows nor
    that of fields; a profile's columns are those of one customer's workbooks. An owner without an approved draft has an empty profile with a hash, too.
    """
    mapping = F.struct("draft_id", F.col("sheet_pattern").alias("source_sheet_pattern"), F.col("source_column").alias("source_column_pattern"), "canonical_field", F.col("confidence").alias("confidence_floor"), F.slice("evidence_ids", 1, MOST_IDS).alias("evidence_ids"))
    of = lambda status: F.col("review_status") == status
    ids = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("draft_id"))))
    sure = F.coalesce(of("approved") | of("rejected"), F.lit(False))
    rows = drafts.groupBy(*owner).agg(F.array_sort(F.collect_list(F.when(of("approved"), mapping))).alias("m"), ids(~sure).alias("pending"), ids(of("rejected")).alias("rejected"))
    number = lambda i: F.when(i < 9999, F.lpad((i + 1).cast("string"), 4, "0")).otherwise((i + 1).cast("string"))
    rows = rows.withColumn("approved", F.transform("m", lambda m, i: m.withField("mapping_id", F.concat_ws("-", F.lit(prefix), number(i)))))
    payload = F.struct(*owner, F.lit(version).alias("version"), F.col("approved").alias("approved_mappings"))
    kind = rows.select(payload.alias("p")).schema["p"].dataType
    return rows.select(*owner, "approved", "pending", "rejected", digest(canonical_json(payload, kind, ", ", ": ")).alias("profile_hash"))


def review_log(records: DataFrame) -> DataFrame:
    """(draft_id, step, action, reason): every record is ingested; rejected and conflicting ones get a second entry. records: draft_id, review_status."""
    entry = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    second = (
        F.when(F.col("review_status") == "rejected", entry("validation_rejected", "Draft cannot enter reviewer approval queue until validation blockers are resolved."))
        .when(F.col("review_status") == "conflict_detected", entry("conflict_detected", "Draft has a material conflict and requires reviewer resolution before approval."))
    )
    first = entry("draft_ingested", "Draft loaded into Phase 6 reviewer workflow after schema and citation validation.")
    return records.select("draft_id", F.posexplode(F.array_compact(F.array(first, second))).alias("n", "e")).select("draft_id", (F.col("n") + 1).alias("step"), "e.action", "e.reason")


def review_package(deterministic: DataFrame, assisted: DataFrame, issues: DataFrame) -> DataFrame:
    """Both kinds of drafts (draft_id, collection, confidence, citation_status) with blockers and review_status.

    issues: draft_id, code. Conflicts come before blockers; a draft without any is ready for review, and nothing is approved here.
    """
    known = issues.groupBy("draft_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))  # a draft's own gates
    rows = deterministic.withColumn("source_phase", F.lit("deterministic")).unionByName(assisted.withColumn("source_phase", F.lit("assisted")))
    rows = rows.join(known, "draft_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    uncited = F.when(~F.coalesce(F.col("citation_status") == "complete", F.lit(False)), "citation_coverage_failed")
    rows = rows.withColumn("blockers", F.array_sort(F.array_union(F.filter("codes", lambda c: c != "conflict_detected"), F.array_compact(F.array(uncited)))))
    status = F.when(F.array_contains("codes", "conflict_detected"), "conflict_detected").when(F.size("blockers") > 0, "rejected").otherwise("needs_review")
    return rows.select("draft_id", "collection", "source_phase", "confidence", "blockers", status.alias("review_status"))


def source_versions(citations: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, title, cited_chunks, chunk_id, chunk_hash): each source that a package cites, with a row and a hash for each chunk cited.

    citations: source_id, chunk_id. sources: source_id, title. chunks: chunk_id, text_hash, text. A chunk without a hash gets that of its text. A cited source or chunk that isn't there is an error.
    """
    pairs = citations.select("source_id", "chunk_id").distinct()
    told = lambda what, c: F.raise_error(F.concat(F.lit(f"missing {what}: "), F.col(c).cast("string"))).cast("string")
    names = sources.select("source_id", F.coalesce(F.nullif("title", F.lit("")), F.col("source_id").cast("string")).alias("title"))
    prints = chunks.select("chunk_id", F.coalesce(F.nullif("text_hash", F.lit("")), sha256(F.coalesce("text", F.lit("")))).alias("chunk_hash"))
    count = pairs.groupBy("source_id").agg(F.count(F.lit(1)).alias("cited_chunks"))
    rows = pairs.join(count, "source_id").join(names, "source_id", "left").join(prints, "chunk_id", "left")
    return rows.select("source_id", F.coalesce("title", told("source", "source_id")).alias("title"), "cited_chunks", "chunk_id", F.coalesce("chunk_hash", told("chunk", "chunk_id")).alias("chunk_hash"))


def seed_import(sources: DataFrame, chunks: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of chunks to upsert, a row for each source with its fate and number of chunks).

    sources: source_id, raw_path, normalized_path, source_status. chunks: source_id, chunk_id, section_label, section_ref, citation_anchor, text, text_hash. artifacts: path. A source without an id, or without both of its artifacts, is skipped with its chunks.
    """
    there = artifacts.select("path").distinct()
    has = lambda name: there.select(F.col("path").alias(name), F.lit(True).alias(f"has_{name}"))
    rows = sources.join(has("raw_path"), "raw_path", "left").join(has("normalized_path"), "normalized_path", "left")
    usable = (F.coalesce(F.col("source_id").cast("string"), F.lit("")) != "") & F.col("has_raw_path").isNotNull() & F.col("has_normalized_path").isNotNull()
    rows = rows.withColumn("usable", usable)
    kept = chunks.join(rows.filter("usable").select("source_id").distinct(), "source_id", "left_semi")
    or_ = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c[:-1]), F.lit(c[-1]))
    upserts = kept.select(
        F.col("chunk_id").alias("id"), F.col("source_id").alias("regulatory_source_id"), or_("section_label", "Document").alias("section_label"),
        or_("section_ref", "citation_anchor", "document").alias("source_location"), or_("citation_anchor", "section_ref", "document").alias("citation"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.nullif("text_hash", F.lit("")), sha256(F.coalesce("text", F.lit("")))).alias("text_hash"), F.lit("approved_for_extraction").alias("status"),
    )
    count = upserts.groupBy(F.col("regulatory_source_id").alias("source_id")).agg(F.count(F.lit(1)).alias("chunks"))
    fate = F.when(F.col("usable"), "imported").otherwise("skipped")
    report = rows.join(count, "source_id", "left").select(
        F.coalesce(F.col("source_id").cast("string"), F.lit("<missing-source-id>")).alias("source_id"), fate.alias("fate"), F.when(F.col("usable"), F.coalesce("chunks", F.lit(0))).otherwise(0).cast("long").alias("chunks"),
        (F.col("usable") & ~F.coalesce(F.col("source_status") == "failed", F.lit(False))).alias("is_finalized"),
    )
    return upserts, report


def area_coverage(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """(area, status, reason) of the thirteen areas: ready if a rule (rule_area, cte_type) is about it, with a note on whether a finding's type names it; else blocked."""
    areas = rules.sparkSession.createDataFrame([(n, a) for n, a in enumerate(AREAS, 1)], "ordinal int, area string")
    of_rules = rules.select(F.explode(F.array("rule_area", "cte_type")).alias("area")).filter(F.col("area").isin(AREAS)).distinct().withColumn("_rule", F.lit(True))
    types = findings.select("finding_type").distinct()
    named = F.filter(F.array(*map(F.lit, AREAS)), lambda a: F.contains(F.col("finding_type"), a))
    of_findings = types.select(F.explode(named).alias("area")).distinct().withColumn("_found", F.lit(True))
    rows = areas.join(of_rules, "area", "left").join(of_findings, "area", "left")
    reason = F.when(F.col("_rule").isNull(), "Missing rule card.").when(F.col("_found").isNull(), "Evaluated or not applicable.").otherwise("Evaluated with findings.")
    return rows.select("ordinal", "area", F.when(F.col("_rule").isNull(), "blocked").otherwise("ready").alias("status"), reason.alias("reason"))
