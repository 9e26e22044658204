"""From messy tables to facts, events and entities.

A scan gives rows of cells (file, sheet, row_number, cells); the header band is
found by score, noise rows go, and every non-blank cell becomes one record with its
lineage. Records of a row make its facts; header rows and line rows meet on the event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import (
    actor_role,
    column_letter,
    field_type,
    first_present,
    food_form,
    header_key,
    is_answered,
    normalize_value,
    parse_date,
    slug,
    strip,
)
from tracemill.plans import cards

HEADER_ROWS = 30
_SHEET = ["file", "sheet"]


def _known(value: Column) -> Column:
    words = [w for ws in cards.FIELD_WORDS.values() for w in ws]
    return header_key(value).isin(words) | slug(value).isin(words)


def header_scores(rows: DataFrame) -> DataFrame:
    """Adds header_score: three points a known field word, one a short text, minus two a date or number, and a little for width."""
    texts = F.filter(F.transform("cells", strip), lambda v: v != "")
    data_like = lambda v: parse_date(v).isNotNull() | v.rlike(r"^-?\d+(\.\d+)?$")
    count = lambda f: F.size(F.filter("_texts", f))
    score = (
        3 * count(_known)
        + count(lambda v: (F.length(v) <= 45) & parse_date(v).isNull())
        - 2 * count(data_like)
        + F.least(F.size("_texts"), F.lit(8)) * 0.2
    )
    return rows.withColumn("_texts", texts).withColumn("header_score", score)


def detect_header(rows: DataFrame) -> DataFrame:
    """(file, sheet, header_row): the best of the first rows that hold more than one value; the first wins ties."""
    scored = header_scores(rows.filter(F.col("row_number") <= HEADER_ROWS)).filter(F.size("_texts") > 1)
    best = F.row_number().over(Window.partitionBy(*_SHEET).orderBy(F.desc("header_score"), "row_number"))
    return scored.withColumn("_n", best).filter("_n = 1").select(*_SHEET, F.col("row_number").alias("header_row"))


def build_headers(rows: DataFrame, header: DataFrame) -> DataFrame:
    """(file, sheet, header_row, headers): names from the header row, joined with the row above where that one only qualifies them."""
    near = rows.join(header, _SHEET)
    pick = lambda n: F.first(F.when(F.col("row_number") == F.col("header_row") - n, F.col("cells")), ignorenulls=True)
    both = near.groupBy(*_SHEET, "header_row").agg(pick(0).alias("now"), pick(1).alias("above"))
    empty = F.array().cast("array<string>")
    both = both.withColumns({"now": F.coalesce("now", empty), "above": F.coalesce("above", empty)})

    def name(pair: Column, at: Column) -> Column:
        now, above = strip(pair["now"]), strip(pair["above"])
        joined = (now != "") & (above != "") & ~_known(now) & (F.length(above) <= 30)
        text = F.when(joined, F.concat_ws(" ", above, now)).when(now != "", now).otherwise(above)
        return F.when(text == "", F.concat(F.lit("column_"), (at + 1).cast("string"))).otherwise(text)

    return both.select(*_SHEET, "header_row", F.transform(F.arrays_zip("now", "above"), name).alias("headers"))


def is_noise(cells: Column, headers: Column) -> Column:
    """Empty rows, single notes or totals, and repeated headers."""
    texts = F.filter(F.transform(cells, strip), lambda v: v != "")
    note = (F.size(texts) == 1) & F.try_element_at(texts, F.lit(1)).rlike(r"(?i)^(note|notes|summary|total|generated|report)\b")
    pairs = F.zip_with(headers, F.slice(cells, 1, F.greatest(F.size(headers), F.lit(1))), lambda h, c: (slug(h) != "") & (slug(h) == slug(strip(c))))
    same = F.size(F.filter(pairs, lambda p: p))
    return (F.size(texts) == 0) | note | (same >= F.greatest(F.lit(2), F.floor(F.size(headers) / 2)))


def map_field(column_name: Column) -> Column:
    """(field_key, confidence, method) of a header by the alias table; unknown ones keep their slug at low confidence."""
    by_word = {w: field for field, words in cards.FIELD_WORDS.items() for w in words}
    pairs = F.create_map(*(F.lit(x) for item in by_word.items() for x in item))
    own = slug(column_name)
    field = F.coalesce(F.try_element_at(pairs, header_key(column_name)), F.try_element_at(pairs, own))
    exact = own == field
    return F.struct(
        F.coalesce(field, F.when(own == "", "unknown_field").otherwise(own)).alias("field_key"),
        F.when(field.isNull(), 0.45).when(exact, 0.98).otherwise(0.9).alias("confidence"),
        F.when(field.isNull(), "spreadsheet_header_unmapped")
        .when(exact, "spreadsheet_header")
        .otherwise("ai_assisted_field_mapping_suggestion")
        .alias("method"),
    )


def evidence_records(rows: DataFrame) -> DataFrame:
    """One record per non-blank cell below the header band, with field, canonical value, type, confidence and address."""
    headed = rows.join(build_headers(rows, detect_header(rows)), _SHEET)  # one row a sheet
    body = headed.filter((F.col("row_number") > F.col("header_row")) & ~is_noise(F.col("cells"), F.col("headers")))
    cells = body.select(*_SHEET, "row_number", "headers", F.posexplode("cells").alias("_at", "raw_value"))
    cells = cells.filter(strip("raw_value") != "").withColumn("column_index", F.col("_at") + 1)
    name = F.coalesce(F.try_element_at("headers", F.col("column_index")), F.concat(F.lit("column_"), F.col("column_index").cast("string")))
    out = cells.withColumn("column_name", name).withColumn("_m", map_field(F.col("column_name")))
    out = out.withColumn("cell", F.concat(column_letter("column_index"), F.col("row_number").cast("string")))
    out = out.withColumn("normalized_value", normalize_value("raw_value", F.col("_m.field_key")))
    row_key = F.concat_ws(":", "file", "sheet", F.col("row_number").cast("string"))
    return out.select(
        F.concat_ws(":", row_key, "column_index").alias("evidence_id"),
        row_key.alias("row_key"),
        *_SHEET,
        "row_number",
        "column_name",
        "column_index",
        "cell",
        "raw_value",
        "normalized_value",
        F.col("_m.field_key").alias("field_key"),
        field_type(F.col("_m.field_key"), F.col("normalized_value")).alias("field_type"),
        F.col("_m.confidence").alias("confidence"),
        F.col("_m.method").alias("extraction_method"),
    )


def row_facts(records: DataFrame) -> DataFrame:
    """(row_key, file, sheet, row_number, facts, evidence_ids): field to its values in column order."""
    ordered = F.sort_array(F.collect_list(F.struct("column_index", "field_key", "normalized_value", "evidence_id")))
    grouped = records.groupBy("row_key", *_SHEET, "row_number").agg(ordered.alias("_r"))
    keys = F.array_distinct(F.transform("_r", lambda r: r["field_key"]))
    values = lambda k: F.transform(F.filter("_r", lambda r: r["field_key"] == k), lambda r: r["normalized_value"])
    facts = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), values(k).alias("value"))))
    return grouped.select("row_key", *_SHEET, "row_number", facts.alias("facts"), F.transform("_r", lambda r: r["evidence_id"]).alias("evidence_ids"))


EVENT_KEYS = ["event_id", "event_type", "event_datetime", "date_you_shipped_the_food", "received_date", "from_partner_id", "to_partner_id", "destination_type"]
ITEM_KEYS = ["product_name", "product_id", "traceability_lot_code", "source_lot_or_tlc", "output_lot_or_tlc"]


def has_any(facts: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.map_keys(facts), F.array(*map(F.lit, keys)))


def fact(name: str, facts: str = "facts") -> Column:
    return first_present(F.coalesce(F.try_element_at(F.col(facts), F.lit(name)), F.array().cast("array<string>")))


def event_rows(facts: DataFrame, header_sheet: str, line_sheet: str) -> DataFrame:
    """Facts of events: line rows with their header's values first, headers without lines, and any other row that reads as an event."""
    keyed = facts.withColumn("_event", fact("event_id"))
    heads = keyed.filter(F.col("sheet") == header_sheet)
    lines = keyed.filter(F.col("sheet") == line_sheet)
    head = heads.select(F.col("_event"), F.col("facts").alias("_head"), F.col("evidence_ids").alias("_head_ids"), F.col("row_key").alias("_head_key"))
    joined = lines.join(head, "_event", "left")
    empty = F.create_map().cast("map<string,array<string>>")
    merged = F.map_zip_with(F.coalesce("_head", empty), F.col("facts"), lambda _, a, b: F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    line_out = joined.select(
        F.concat_ws("+", "_head_key", "row_key").alias("row_key"),
        "row_number",
        merged.alias("facts"),
        F.concat(F.coalesce("_head_ids", F.array().cast("array<string>")), F.col("evidence_ids")).alias("evidence_ids"),
    )
    alone = heads.join(lines.select("_event").distinct(), "_event", "left_anti")
    loose = keyed.filter(~F.col("sheet").isin(header_sheet, line_sheet)).filter(has_any(F.col("facts"), EVENT_KEYS) & has_any(F.col("facts"), ITEM_KEYS))
    rest = alone.select("row_key", "row_number", "facts", "evidence_ids").unionByName(loose.select("row_key", "row_number", "facts", "evidence_ids"))
    return line_out.unionByName(rest)


def events(rows: DataFrame) -> DataFrame:
    """Event table for classification; of rows with one event id the last stands."""
    event = F.coalesce(fact("event_id"), F.col("row_key"))
    item = F.coalesce(fact("event_line_id"), fact("product_id"))
    out = rows.withColumn("event_id", F.when(item.isNull(), event).otherwise(F.concat_ws(":", event, item)))
    last = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("row_number"), F.desc("row_key")))
    out = out.withColumn("_n", last).filter("_n = 1")
    role = actor_role(F.coalesce(fact("location_name"), fact("actor_location_id")), F.coalesce(fact("location_type"), fact("business_type")), fact("event_type"))
    form = food_form(fact("product_name"), fact("ftl_category"), fact("food_form"))
    out = out.withColumn("_role", role).withColumn("_form", form)
    return out.select(
        "event_id",
        "row_key",
        "evidence_ids",
        "facts",
        fact("event_type").alias("event_type_claim"),
        F.coalesce(fact("event_datetime"), fact("date_you_shipped_the_food"), fact("received_date")).alias("event_datetime"),
        F.lit(None).cast("string").alias("document_type"),
        F.col("_role.role").alias("actor_role"),
        F.col("_role.confidence").alias("actor_confidence"),
        fact("product_id").alias("product_id"),
        fact("product_name").alias("product_name"),
        F.col("_form.remains_listed").alias("remains_listed"),
        F.col("_form.review_required").alias("review_required"),
        fact("traceability_lot_code").alias("lot_or_tlc"),
        fact("source_lot_or_tlc").alias("source_lot_or_tlc"),
        fact("output_lot_or_tlc").alias("output_lot_or_tlc"),
        fact("from_partner_id").alias("from_partner_id"),
        fact("to_partner_id").alias("to_partner_id"),
        fact("destination_type").alias("destination_type"),
        F.array_distinct(F.concat(F.map_keys("facts"), F.array_compact(F.array(fact("event_type"))))).alias("action_terms"),
        F.array().cast("array<string>").alias("conflict_fields"),
    )


def quality_report(records: DataFrame) -> DataFrame:
    """One row: counts, mapped rate, repeated cells, conflicting fields and the gate."""
    sure = records.filter(F.col("confidence") >= 0.6)
    clash = sure.filter(is_answered("normalized_value")).groupBy("row_key", "field_key").agg(F.count_distinct("normalized_value").alias("k")).filter("k > 1")
    repeated = records.groupBy("file", "sheet", "row_number", "field_key", "normalized_value").count().filter("count > 1")
    base = records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("confidence") >= 0.6).alias("mapped"), F.count_if(F.col("confidence") < 0.8).alias("low_confidence")
    )
    out = base.crossJoin(clash.agg(F.count(F.lit(1)).alias("conflicts"))).crossJoin(repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_cells")))
    gate = F.when((F.col("conflicts") == 0) & (F.col("mapped") == F.col("records")), "pass").otherwise("needs_review")
    return out.withColumn("mapped_rate", F.round(F.col("mapped") / F.greatest("records", F.lit(1)), 4)).withColumn("quality_gate", gate)
