"""The source registry: records from documents of either spelling, authority and type of a source, its parser, and triage of weak chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import collapse, sha256
from tracemill.operators.review import ladder

# --- Fixed values: authority of certain sources, and by tier.
AUTHORITY_BY_SOURCE = {
    "ecfr-21-cfr-1-subpart-s": "codified_rule",
    "ecfr-21-cfr-1-subpart-s-pdf": "codified_rule",
    "fr-2022-24417-final-rule": "final_rule",
    "fr-2022-24417-final-rule-pdf": "final_rule",
    "fr-2023-technical-amendment": "federal_register_notice",
    "fr-2025-compliance-date-extension": "change_monitor",
    "fr-2025-compliance-date-extension-pdf": "change_monitor",
    "fr-2026-cottage-cheese-exemption": "change_monitor",
}
AUTHORITY_BY_TIER = {
    "binding_rule": "codified_rule",
    "binding_rule_history": "final_rule",
    "core_hub": "support",
    "product_scope": "support",
    "product_scope_support": "support",
    "cte_kde_schema": "support",
    "tlc_support": "support",
    "export_schema": "template",
    "export_schema_sample": "template",
    "guidance": "guidance",
    "guidance_summary": "guidance",
    "scenario": "scenario",
    "traceability_plan_example": "scenario",
    "operator_support": "support",
    "exemption_support": "support",
    "market_impact": "market_impact",
    "product_research": "research",
    "change_monitor": "change_monitor",
    "exemption_change_monitor": "change_monitor",
    "training_support": "training",
    "cross_reference": "cross_reference",
}
# --- Fixed values: texts of pages that are no content.
BOILERPLATE = [
    "food & beverages", "guidance document", "small entity compliance guide", "may 2023", "visit the webpage to learn more.", "| | |",
    "modal header some text in the modal.",
]
# --- Fixed values: sources whose chunks each kind of draft is taken from: collection, source, sections (none: all), and how many at most (none: all).
DRAFT_SOURCES = [
    ("obligations", "ecfr-21-cfr-1-subpart-s", ["21 CFR 1.1300", "21 CFR 1.1325", "21 CFR 1.1330", "21 CFR 1.1335", "21 CFR 1.1340", "21 CFR 1.1345", "21 CFR 1.1350", "21 CFR 1.1455"]),
    ("exemption_rules", "ecfr-21-cfr-1-subpart-s", ["21 CFR 1.1305"]),
    ("tlc_rules", "ecfr-21-cfr-1-subpart-s", ["21 CFR 1.1320", "21 CFR 1.1330", "21 CFR 1.1335", "21 CFR 1.1340", "21 CFR 1.1345", "21 CFR 1.1350"]),
    ("tlc_rules", "fda-traceability-lot-code", []),
]
MOST_CHUNKS = {"exemption_rules": 4, "tlc_rules": 10}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), key)


def authority(source_id: Column, tier: Column) -> Column:
    """The rank of a source: its own, else codified for the code's sources, else that of its tier, else support."""
    codified = F.when(source_id.startswith("cfr-") | source_id.startswith("ecfr-"), "codified_rule")
    return F.coalesce(_lookup(AUTHORITY_BY_SOURCE, source_id), codified, _lookup(AUTHORITY_BY_TIER, tier), F.lit("support"))


def source_type(source_id: Column, url: Column, content_type: Column) -> Column:
    """What kind of source it is; the first rule that holds. Nulls are empty."""
    link, kind = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    return ladder(
        [
            (source_id.startswith("ecfr-"), "ecfr"),
            (source_id.startswith("cfr-"), "cfr"),
            (link.contains("federalregister.gov") | source_id.startswith("fr-"), "federal_register"),
            (kind.contains("spreadsheet") | link.rlike(r"\.xls[xm]$"), "fda_xlsx"),
            (kind.contains("pdf") | link.endswith(".pdf") | link.contains("/media/"), "fda_pdf"),
            (link.contains("hfpappexternal.fda.gov"), "fda_web_app"),
            (link.contains("fda.gov"), "fda_html"),
            (link.startswith("local://"), "local_document"),
        ],
        "unknown",
    )


def parser_for(url: Column, content_type: Column, content: Column) -> Column:
    """Which parser reads a fetched document (binary content): by its type, its name without a query, its first two bytes, then by what stands in its text."""
    kind, name = F.lower(F.coalesce(content_type, F.lit(""))), F.split_part(F.lower(F.coalesce(url, F.lit(""))), F.lit("?"), F.lit(1))
    text = F.coalesce(content.cast("string"), F.lit(""))
    low = F.lower(F.replace(text, F.lit("&amp;"), F.lit("&")))
    listing = low.contains("fsma rules & guidance for industry") & low.contains("guidance for industry & others") & low.contains("customtable")
    return ladder(
        [
            (kind.contains("pdf") | name.endswith(".pdf"), "pdf"),
            (kind.contains("spreadsheet") | kind.contains("excel") | name.rlike(r"\.xls[xm]$") | (F.substring(content, 1, 2) == F.lit(b"PK")), "xlsx"),
            (text.contains("<DIV8") & text.contains('TYPE="SECTION"'), "ecfr_xml"),
            (listing, "rules_listing"),
        ],
        "html",
    )


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Registry records of chunks (source_id, body): JSON objects whose keys are spelled in either way; what is missing falls back in a fixed order.

    body keys: chunk_id or chunkId, section_label or sectionLabel, section, citation, text, text_hash or textHash, anchors (a list with citation, page_number or pageNumber). Broken JSON gives a record without any.
    """
    get = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object("body", f"$.{p}"), F.lit("")) for p in paths))
    text = F.coalesce(F.get_json_object("body", "$.text"), F.lit(""))
    page = get("anchors[0].page_number", "anchors[0].pageNumber")
    own = F.concat_ws("-", "source_id", F.substring(sha256(F.coalesce("body", F.lit(""))), 1, 12))
    return chunks.select(
        F.coalesce(get("chunk_id", "chunkId"), own).alias("chunk_id"), "source_id", F.coalesce(get("section_label", "sectionLabel", "section"), F.lit("Document")).alias("section_label"),
        F.coalesce(get("section", "citation"), F.lit("document")).alias("section_ref"), F.when(page.rlike("^[0-9]+$"), page.cast("int")).alias("page_number"), text.alias("text"),
        F.coalesce(get("text_hash", "textHash"), F.concat(F.lit("sha256:"), sha256(text))).alias("text_hash"),
        F.coalesce(get("citation", "anchors[0].citation", "section"), F.lit("document")).alias("citation_anchor"),
    )


def triage(issues: DataFrame) -> DataFrame:
    """issues (source_id, issue_type, authority_rank, text, ...) with triage_status and triage_reason; the first rule that holds."""
    kind, source = F.col("issue_type"), F.col("source_id")
    short, large = kind == "short_chunk", kind == "large_chunk"
    known = F.lower(collapse(F.coalesce("text", F.lit("")))).isin(BOILERPLATE)
    steps = [
        (kind == "raw_pdf_bytes", "blocking", "Raw PDF bytes cannot support extraction, citation, or rule drafting."),
        (kind.isin("empty_chunk", "missing_citation_anchor", "duplicate_chunk_id"), "blocking", "Chunk cannot safely support cited structured extraction."),
        (F.col("authority_rank") == "codified_rule", "blocking", "Primary executable legal source must not have unresolved chunk quality warnings."),
        (short & known, "accepted_nonblocking", "Known FDA page boilerplate or metadata chunk; exclude from extraction."),
        (source.startswith("scenario-") & short, "needs_remediation", "Scenario slide text is too thin for benchmark extraction; likely needs transcript pairing or visual/OCR extraction."),
        ((source == "fr-2022-24417-final-rule-pdf") & large, "needs_remediation", "Final-rule history chunk is readable but too large for precise final-rule rationale extraction."),
        ((source == "fda-faq-food-traceability-rule") & large, "needs_remediation", "FAQ table was captured as one large chunk; useful for search but weak for precise Q&A extraction."),
        ((source == "fda-fish-guidance-chapter-3") & large, "accepted_nonblocking", "Fish guidance is cross-reference support, not an FSMA 204 executable source."),
        (large, "needs_remediation", "Large chunk may reduce citation precision."),
    ]
    last = "Warning needs explicit source-specific review before extraction."
    return issues.withColumns({"triage_status": ladder([(c, s) for c, s, _ in steps], "needs_remediation"), "triage_reason": ladder([(c, r) for c, _, r in steps], last)})


def draft_chunks(chunks: DataFrame) -> DataFrame:
    """(collection, n, chunk_id): the chunks (chunk_id, source_id, section_ref, ordinal) from which each collection is drafted; of some only the first so many, numbered by n."""
    rows = [(c, s, sections or None) for c, s, sections in DRAFT_SOURCES]
    wanted = F.broadcast(chunks.sparkSession.createDataFrame(rows, "collection string, source_id string, sections array<string>"))
    found = chunks.join(wanted, "source_id").filter(F.col("sections").isNull() | F.array_contains("sections", F.col("section_ref")))
    most = _lookup({k: str(v) for k, v in MOST_CHUNKS.items()}, F.col("collection")).cast("int")
    n = F.row_number().over(Window.partitionBy("collection").orderBy("ordinal", "chunk_id"))
    first = found.filter(most.isNotNull()).withColumn("n", n).filter(F.col("n") <= max(MOST_CHUNKS.values()))  # each task keeps so many before the shuffle
    every = found.filter(most.isNull()).withColumn("n", F.lit(None).cast("int"))
    return first.filter(F.col("n") <= most).unionByName(every).select("collection", "n", "chunk_id")


def event_labels(event_type: Column, biz_step: Column, declared_wrong: Column) -> tuple[Column, Column]:
    """(event types, abstentions) that a visibility event stands for; one that is declared an error only means that shipping is to be abstained from."""
    texts = "array<string>"
    labels = F.array_compact(
        F.array(
            F.when(biz_step == "packing", "initial_packing"), F.when(biz_step.isin("receiving", "arriving", "accepting"), "receiving"),
            F.when(biz_step.isin("shipping", "departing"), "shipping"), F.when(event_type == "TransformationEvent", "transformation"),
        )
    ).cast(texts)
    wrong, none = F.coalesce(declared_wrong, F.lit(False)), F.array().cast(texts)
    return F.when(wrong, none).otherwise(labels), F.when(wrong, F.array(F.lit("shipping"))).otherwise(none)


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Active chunks (status, citation, text_hash) that an audit may cite."""
    return chunks.filter((F.col("status") == "active") & (F.length("citation") > 0) & F.col("text_hash").startswith("sha256:"))


def approved_records(records: DataFrame, body: str = "body") -> DataFrame:
    """Records whose metadata (in a JSON column) says that they are approved."""
    return records.filter(F.get_json_object(body, "$.metadata.review_status") == "approved")
