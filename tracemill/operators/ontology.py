"""Legacy workbook sheets as typed record tables, and facts inferred from names of files and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import document_type, slug, strip, tri_state

# Sheets of the legacy template, and the states and event kinds that its cells may name.
BUSINESS, PRODUCTS, PLAN = "00_Business_Profile", "01_Product_Master", "04_Traceability_Plan"
EVENTS, LINES, VALUES = "05_CTE_Events", "06_Event_Line_Items", "07_KDE_Values"
LINEAGE, DOCUMENTS, CLAIMS = "08_TLC_Lineage", "09_Source_Documents", "10_Exemptions_Claims"
COVERED_STATES = ["covered", "not_covered", "exempt", "partially_exempt"]
LINEAGE_STATES = ["linked", "gap", "conflicting", "unverified"]
DOCUMENT_STATES = ["available", "missing", "optional", "unverified"]
KINDS = ["harvest", "cooling", "initial_packing", "first_land_based_receiving", "shipping", "receiving", "transformation"]
SHORT_KINDS = {"ship": "shipping", "receive": "receiving", "pack": "initial_packing", "packing": "initial_packing", "cool": "cooling"}
EVENT_FIELDS = ["event_id", "source_system", "event_datetime", "actor_location_id", "from_partner_id", "to_partner_id", "reference_record_type", "reference_record_no", "event_status"]
LINE_FIELDS = ["event_line_id", "event_id", "product_id", "product_name", "ftl_category", "lot_or_tlc", "unit", "source_lot_or_tlc", "output_lot_or_tlc"]
LINEAGE_FIELDS = ["lineage_id", "relationship_type", "source_event_id", "source_event_line_id", "source_lot_or_tlc", "target_event_id", "target_event_line_id", "target_lot_or_tlc"]
DOCUMENT_FIELDS = ["evidence_id", "event_id", "event_line_id", "evidence_type", "file_or_url", "reference_no"]
PLAN_ITEMS = ["record_maintenance_procedure", "ftl_identification_procedure", "tlc_assignment_procedure", "point_of_contact", "farm_map_available"]
PRODUCT_TERMS = ["basil", "tuna", "cucumber", "cheese", "sprouts", "lettuce", "tomato", "melon", "pepper", "salad"]
LOT_IN_NAME = r"(?i)\b(?:tlc|lot|batch)\s*#?\s*([A-Z0-9][A-Z0-9.-]{2,})\b"
DATE_IN_NAME = r"\b(20\d{2}[-_/ ]\d{1,2}[-_/ ]\d{1,2}|\d{1,2}[-_/ ]\d{1,2}[-_/ ]20\d{2})\b"
PRODUCT_IN_NAME = rf"(?i)\b({'|'.join(PRODUCT_TERMS)})\b"
PLACE_IN_NAME = r"(?i)(\b(?:farm|warehouse|facility|plant|restaurant|store|vessel|dock)\s+[A-Z0-9][A-Za-z0-9 .-]{1,30})"


def field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def one_of(value: Column, names: list[str], other: str) -> Column:
    text = F.lower(F.coalesce(value, F.lit("")))
    return F.when(text.isin(names), text).otherwise(other)


def legacy_kind(value: Column) -> Column:
    """The event kind of a legacy cell; what it doesn't know counts as receiving, as the legacy template did."""
    text = slug(value)
    out = F.when(text.isin(KINDS), text)
    for short, kind in SHORT_KINDS.items():
        out = out.when(text == short, kind)
    return out.otherwise("receiving")


def _sheet(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("sheet") == name)


def _or_numbered(value: Column, prefix: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.concat(F.lit(prefix), F.col("position").cast("string")))


def business_profiles(rows: DataFrame) -> DataFrame:
    """rows: (workbook, sheet, position, fields) with position from 1 below the header; so for all projections here."""
    name = field("company_name")
    return _sheet(rows, BUSINESS).select(
        "workbook",
        _or_numbered(field("business_id"), "business-").alias("business_id"),
        F.when(F.coalesce(name, F.lit("")) != "", name).otherwise("Unknown company").alias("company_name"),
        field("business_type").alias("business_type"),
        tri_state(field("handles_ftl_foods")).alias("handles_listed_foods"),
        one_of(field("covered_entity_status"), COVERED_STATES, "not_determined").alias("covered_status"),
    )


def products(rows: DataFrame) -> DataFrame:
    listed = tri_state(field("is_ftl_maybe"))
    return _sheet(rows, PRODUCTS).select("workbook", field("product_id").alias("product_id"), field("product_name").alias("product_name"), field("ftl_food_category").alias("category"), listed.alias("listed"))


def product_scope(rows: DataFrame) -> DataFrame:
    """A decision for each product: covered, not_covered, or not_determined with a reason to review."""
    listed = F.col("listed")
    status = F.when(listed, "covered").when(~listed, "not_covered").otherwise("not_determined")
    reason = F.when(listed.isNull(), "needs_review").otherwise("product_master")
    return products(rows).select("workbook", "product_id", status.alias("status"), reason.alias("reason"))


def plans(rows: DataFrame) -> DataFrame:
    """One row a workbook, with a plan or without: whether the sheet has rows, and the first answer to each item."""
    on_plan = F.col("sheet") == PLAN
    # the position orders the answers; a null answer to the first mention stays null
    first = lambda item: F.min(F.when(on_plan & (field("plan_item") == item), F.struct("position", field("answer").alias("a"))))["a"]
    answers = {c: first(c) for c in PLAN_ITEMS}
    answers["farm_map_available"] = tri_state(answers["farm_map_available"])
    return rows.groupBy("workbook").agg((F.count_if(on_plan) > 0).alias("plan_exists"), *(c.alias(k) for k, c in answers.items()))


def events(rows: DataFrame) -> DataFrame:
    return _sheet(rows, EVENTS).select("workbook", *(field(c).alias(c) for c in EVENT_FIELDS), legacy_kind(field("event_type")).alias("event_type"))


def line_items(rows: DataFrame) -> DataFrame:
    return _sheet(rows, LINES).select("workbook", *(field(c).alias(c) for c in LINE_FIELDS), F.expr("try_cast(try_element_at(fields, 'quantity') AS double)").alias("quantity"))


def kde_values(rows: DataFrame) -> DataFrame:
    """A value that is null or empty is missing; the field is known by its key, else by its name."""
    value, key = field("kde_value"), field("field_key")
    return _sheet(rows, VALUES).select(
        "workbook",
        _or_numbered(field("kde_id"), "kde-").alias("kde_id"),
        field("event_id").alias("event_id"),
        field("event_line_id").alias("event_line_id"),
        legacy_kind(field("cte_type")).alias("cte"),
        F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(field("kde_name")).alias("field_key"),
        value.alias("value"),
        F.when(F.coalesce(value, F.lit("")) != "", "present").otherwise("missing").alias("status"),
    )


def lineage(rows: DataFrame) -> DataFrame:
    return _sheet(rows, LINEAGE).select("workbook", *(field(c).alias(c) for c in LINEAGE_FIELDS), one_of(field("lineage_status"), LINEAGE_STATES, "unverified").alias("lineage_status"))


def source_documents(rows: DataFrame) -> DataFrame:
    return _sheet(rows, DOCUMENTS).select("workbook", *(field(c).alias(c) for c in DOCUMENT_FIELDS), one_of(field("evidence_status"), DOCUMENT_STATES, "unverified").alias("evidence_status"))


def exemption_claims(rows: DataFrame) -> DataFrame:
    shown = F.coalesce(tri_state(field("evidence_provided")), F.lit(False))
    return _sheet(rows, CLAIMS).select(
        "workbook", field("claim_id").alias("claim_id"), field("claim_type").alias("claim_type"), field("claimed_by").alias("claimed_by"),
        shown.alias("evidence_provided"), F.when(shown, "partially_exempt").otherwise("not_determined").alias("decision"),
    )


def ontology(rows: DataFrame) -> dict[str, DataFrame]:
    """The ten record tables of legacy workbooks. Sheets that are missing make empty tables."""
    made = (business_profiles, products, product_scope, plans, events, line_items, kde_values, lineage, source_documents, exemption_claims)
    return {f.__name__: f(rows) for f in made}


def name_facts(name: Column) -> Column:
    """Facts that a file's or sheet's name states, in order: lots, dates, kind of document, products, place."""
    # a variable of one function: however the name is made, it is made once
    return F.element_at(F.transform(F.array(F.coalesce(name, F.lit(""))), _facts_of), 1)


def _facts_of(name: Column) -> Column:
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    plain = F.replace(spaced, F.lit("-"), F.lit(" "))
    fact = lambda key, value, sure: F.struct(F.lit(key).alias("field_key"), value.alias("raw_value"), F.lit(sure).alias("confidence"))
    each = lambda text, pattern, key, sure, change=lambda v: v: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: fact(key, change(v), sure))
    kind = F.filter(F.array(document_type(name)), lambda k: F.size(k["signals"]) > 0)
    products = F.transform(F.regexp_extract_all(plain, F.lit(PRODUCT_IN_NAME), 1), F.lower)
    place = F.regexp_extract(name, PLACE_IN_NAME, 1)
    return F.concat(
        each(spaced, LOT_IN_NAME, "traceability_lot_code", 0.82, F.upper),
        each(plain, DATE_IN_NAME, "event_datetime", 0.78),
        F.transform(kind, lambda k: fact("source_document_type", k["document_type"], 0.86)),
        F.transform(F.array_intersect(F.array(*map(F.lit, PRODUCT_TERMS)), products), lambda t: fact("product_name", F.initcap(t), 0.62)),
        F.transform(F.filter(F.array(place), lambda p: p != ""), lambda p: fact("location_name", strip(p), 0.66)),
    )


def inferred_facts(records: DataFrame) -> DataFrame:
    """(file, source_kind, source_name, position, field_key, raw_value, confidence) from the names of each file and its distinct sheets.

    records: any rows with file and sheet. The file's name is what follows its last slash. Facts are numbered within their name.
    """
    names = records.select("file", F.inline(F.array(
        F.struct(F.lit("filename").alias("source_kind"), F.element_at(F.split("file", "/"), -1).alias("source_name")),
        F.struct(F.lit("sheet_name").alias("source_kind"), F.col("sheet").alias("source_name")),
    ))).filter("source_name is not null").distinct()
    found = names.select("file", "source_kind", "source_name", F.posexplode(name_facts(F.col("source_name"))).alias("_at", "_f"))
    return found.select("file", "source_kind", "source_name", (F.col("_at") + 1).alias("position"), "_f.field_key", "_f.raw_value", "_f.confidence")
