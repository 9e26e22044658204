"""Rows that a run's evidence is stored as: objects, events, evidence links, values, lot links, and what a reviewer is asked.

Every row has an id made of its run and its keys, so a run that is repeated writes the same rows; of rows with one id the last stands. Events meet their
objects through joins on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import collapse, row_hash_id

# --- Fixed values: bounds of confidence, and confidence in links of lots.
MAPPED, LOW, ASKED, REVIEWED = 0.6, 0.8, 0.5, 0.75
BOTH_LOTS, ONE_LOT, OWN_LOT = 0.85, 0.65, 0.7
UNMAPPED_CONFIDENCE, MOST_EVIDENCE = 0.45, 50
UNMAPPED = "Review unmapped customer columns before relying on event classification."
FORM_QUESTION = "Confirm whether the product/form remains in scope for FSMA 204."
ROLE_QUESTION = "Confirm the actor role for this event."
# --- Fixed values: keys that make a row an event, of which one of each set is needed.
EVENT_KEYS = ["event_type", "event_datetime", "date_you_shipped_the_food", "received_date", "traceability_lot_code", "source_lot_or_tlc", "output_lot_or_tlc", "destination_type"]
FOOD_KEYS = ["product_name", "product_id", "traceability_lot_code"]


def confidence_band(confidence: Column) -> Column:
    """unmapped below 0.6, of which those below 0.5 are asked about; low below 0.8, else sure. Null is unmapped."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c < ASKED, "asked").when(c < MAPPED, "unmapped").when(c < LOW, "low").otherwise("sure")


def review_status(confidence: Column, doubtful: Column | None = None, least: float = REVIEWED) -> Column:
    """needs_review below the bound or in doubt; no confidence is none to doubt."""
    low = F.coalesce(confidence < least, F.lit(False))
    return F.when(low | F.coalesce(doubtful, F.lit(False)) if doubtful is not None else low, "needs_review").otherwise("unreviewed")


def is_event(facts: Column) -> Column:
    """Whether a row's facts (a map) have one of the keys of events and one of food."""
    keys = F.map_keys(facts)
    has = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    return F.coalesce(has(EVENT_KEYS) & has(FOOD_KEYS), F.lit(False))


def last_by_id(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with one id the one that comes last; combined before the shuffle."""
    held = [c for c in rows.columns if c not in ("id", order)]
    return rows.groupBy("id").agg(F.max_by(F.struct(*held), order).alias("r")).select("id", "r.*")


def business_objects(entities: DataFrame, run: str) -> DataFrame:
    """(id, object_type, object_key, name, normalized_name, confidence, review_status) of entities (object_type, entity_id, name, confidence, ordinal)."""
    rows = entities.select(
        row_hash_id("nbo_", F.lit(run), "object_type", "entity_id").alias("id"), "object_type", F.col("entity_id").alias("object_key"), "name",
        F.lower(collapse(F.coalesce("name", F.lit("")))).alias("normalized_name"), "confidence", F.lit("unreviewed").alias("review_status"), "ordinal",
    )
    return last_by_id(rows, "ordinal")


def event_rows(events: DataFrame, objects: DataFrame, run: str) -> DataFrame:
    """Events with ids and with the objects that they name.

    events: event_id, actor_id, product_id, lot_or_tlc, source_lot_or_tlc, output_lot_or_tlc, from_partner_id, to_partner_id, confidence, reviewer_questions (array), ... A key that no object has leaves a null; lots are objects of type lot
    under their own key.
    """
    known = objects.select("object_type", "object_key", "id")
    rows = events.withColumn("id", row_hash_id("nev_", F.lit(run), "event_id"))
    links = [("actor_id", "actor_object_id", ["actor"]), ("product_id", "product_object_id", ["product"]), ("lot_or_tlc", "lot_object_id", ["lot"]), ("source_lot_or_tlc", "source_lot_object_id", ["lot"])]
    links += [("output_lot_or_tlc", "output_lot_object_id", ["lot"]), ("from_partner_id", "from_object_id", ["counterparty", "location"]), ("to_partner_id", "to_object_id", ["counterparty", "location"])]
    for key, name, types in links:
        side = known.filter(F.col("object_type").isin(types)).groupBy(F.col("object_key").alias(key)).agg(F.min("id").alias(name))
        rows = rows.join(side, key, "left")
    asked = F.coalesce(F.size("reviewer_questions"), F.lit(0)) > 0
    return rows.withColumn("review_status", review_status(F.col("confidence"), asked))


def evidence_links(events: DataFrame) -> DataFrame:
    """(normalized_event_id, evidence_item_id, role): one row for each cell of each event (id, evidence_ids)."""
    return events.select(F.col("id").alias("normalized_event_id"), F.explode("evidence_ids").alias("evidence_item_id"), F.lit("source_cell").alias("role"))


def kde_values(records: DataFrame, events: DataFrame, run: str) -> DataFrame:
    """Values of evidence records (evidence_id, row_key, field_key, column_name, raw_value, normalized_value, confidence) with the event (id, source_row_key) of their row, if it has one."""
    owner = events.groupBy(F.col("source_row_key").alias("row_key")).agg(F.max("id").alias("normalized_event_id"))
    return records.join(owner, "row_key", "left").select(
        row_hash_id("kde_", F.lit(run), "evidence_id", "field_key").alias("id"), "normalized_event_id", F.col("evidence_id").alias("evidence_item_id"), F.col("field_key").alias("kde_key"),
        F.col("column_name").alias("kde_label"), "raw_value", "normalized_value", "confidence", review_status(F.col("confidence")).alias("review_status"),
    )


def lot_links(events: DataFrame, run: str) -> DataFrame:
    """How lots flow through events (event_id, id, lot_or_tlc, source_lot_or_tlc, output_lot_or_tlc): from source to output, or the event's own lot. Empty lots are none."""
    real = lambda c: F.nullif(F.col(c), F.lit(""))
    source, output, own = real("source_lot_or_tlc"), real("output_lot_or_tlc"), real("lot_or_tlc")
    flows, whole = source.isNotNull() | output.isNotNull(), source.isNotNull() & output.isNotNull()
    rows = events.filter(flows | own.isNotNull())
    kind = F.when(flows, "input_output").otherwise("event_lot")
    return rows.select(
        row_hash_id("tlc_", F.lit(run), "event_id", kind).alias("id"), F.col("id").alias("normalized_event_id"), F.when(flows, source).otherwise(own).alias("source_tlc"),
        F.coalesce(output, own).alias("output_tlc"), F.when(flows, "input_to_output").otherwise("event_lot").alias("link_type"),
        F.when(whole, BOTH_LOTS).when(flows, ONE_LOT).otherwise(OWN_LOT).alias("confidence"), F.when(flows & ~whole, "needs_review").otherwise("unreviewed").alias("review_status"),
    )


def reviewer_questions(events: DataFrame, records: DataFrame) -> DataFrame:
    """(ordinal, event_id, question, reason, confidence, evidence_ids): each event's questions in order, and one for all unmapped columns together, if there are any.

    events: event_id, confidence, evidence_ids, reviewer_questions. records: evidence_id, confidence. ordinal counts within an event, from 1; the last question has no event and names its first fifty records.
    """
    each = events.select("event_id", F.posexplode("reviewer_questions").alias("n", "question"), F.lit("abstention_or_low_confidence_fact").alias("reason"), "confidence", "evidence_ids")
    low = records.filter(confidence_band(F.col("confidence")) == "asked").select("evidence_id").orderBy("evidence_id").limit(MOST_EVIDENCE)  # the question's own bound
    one = low.agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids")).filter(F.size("evidence_ids") > 0)
    kind = events.schema["event_id"].dataType
    last = one.select(F.lit(1).alias("ordinal"), F.lit(None).cast(kind).alias("event_id"), F.lit(UNMAPPED).alias("question"), F.lit("low_confidence_field_mapping").alias("reason"), F.lit(UNMAPPED_CONFIDENCE).alias("confidence"), "evidence_ids")
    return each.select((F.col("n") + 1).alias("ordinal"), "event_id", "question", "reason", "confidence", "evidence_ids").unionByName(last)


def review_items(events: DataFrame, conflicts: DataFrame, run: str) -> DataFrame:
    """(id, normalized_event_id, review_type, question, severity): a row for each thing that a person has to look at.

    events: id, event_id, reviewer_questions, form_review (boolean), role_confidence. conflicts: conflict_id, field_key, severity.
    """
    none = F.array().cast("array<string>")
    item = lambda kind, question, key: F.struct(F.lit(kind).alias("review_type"), question.alias("question"), key.alias("key"))
    asked = F.transform(F.coalesce("reviewer_questions", none), lambda q: item("event_ambiguity", q, q))
    others = F.array_compact(
        F.array(
            F.when(F.col("form_review"), item("food_form_review", F.lit(FORM_QUESTION), F.lit("food_form"))),
            F.when(F.col("role_confidence") < REVIEWED, item("actor_role_review", F.lit(ROLE_QUESTION), F.lit("actor_role"))),
        )
    )
    rows = events.select("id", F.col("event_id").cast("string").alias("event_id"), F.inline(F.concat(asked, others)))
    rows = rows.select(row_hash_id("nri_", F.lit(run), "event_id", "key").alias("id"), F.col("id").alias("normalized_event_id"), "review_type", "question", F.lit("medium").alias("severity"))
    about = F.concat(F.lit("Resolve conflicting values for "), "field_key", F.lit("."))
    torn = conflicts.select(
        row_hash_id("nri_", F.lit(run), F.lit("conflict"), "conflict_id").alias("id"), F.lit(None).cast("string").alias("normalized_event_id"), F.lit("evidence_conflict").alias("review_type"),
        about.alias("question"), "severity",
    )
    return rows.unionByName(torn).dropDuplicates(["id"])


def scope_checks(events: DataFrame, conflicts: DataFrame, quality_gate: str | None) -> DataFrame:
    """(event_id, check_type, reason): events whose food form or questions leave their scope open, a row if evidence conflicts, a row if its quality didn't pass.

    events: event_id, form_review, reviewer_questions, form_reason. The reason is the form's, else the first question.
    """
    asked = F.coalesce(F.size("reviewer_questions"), F.lit(0)) > 0
    form = F.coalesce("form_review", F.lit(False))
    reason = F.when(form, F.coalesce("form_reason", F.lit("Food form requires review."))).otherwise(F.get("reviewer_questions", F.lit(0)))
    rows = events.filter(form | asked).select(F.col("event_id").cast("string").alias("event_id"), F.lit("scope_or_exemption_uncertainty").alias("check_type"), reason.alias("reason"))
    none = F.lit(None).cast("string").alias("event_id")
    torn = conflicts.limit(1).select(none, F.lit("evidence_conflicts").alias("check_type"), F.lit("Customer evidence conflicts must be resolved before final execution.").alias("reason"))
    rows = rows.unionByName(torn)
    if quality_gate not in (None, "pass"):
        gate = events.sparkSession.createDataFrame([(None, "customer_evidence_quality_gate", f"Customer evidence quality gate is {quality_gate}.")], rows.schema)
        rows = rows.unionByName(gate)
    return rows


def records_readiness(records: DataFrame, events: DataFrame, conflicts: DataFrame, quality_gate: str | None) -> DataFrame:
    """(check_type, status): linked records, response within a day, and data for the export; counts only."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(records, "r").crossJoin(n(events, "e")).crossJoin(n(conflicts, "c"))  # a row each
    row = lambda kind, status: F.struct(F.lit(kind).alias("check_type"), status.alias("status"))
    return one.select(
        F.inline(
            F.array(
                row("legible_linked_records", F.when((F.col("r") > 0) & (F.col("c") == 0), "present").otherwise("needs_review")),
                row("fda_24_hour_response_readiness", F.lit("present" if quality_gate == "pass" else "needs_review")),
                row("sortable_export_source_data", F.when(F.col("e") > 0, "present").otherwise("missing")),
            )
        )
    )


def export_rows(events: DataFrame, checks: DataFrame) -> DataFrame:
    """(cte, event_id, values, missing): a tab's row for each final event type of an event, with the first value that was seen for each field, and the fields without one.

    events: event_id, final_ctes, product_name, traceability_lot_code. checks: event_id, cte, field_key, observed_values (an event's own contract). A later check of a field overrides an event's column.
    """
    rows = events.select("event_id", F.explode("final_ctes").alias("cte"), F.create_map(F.lit("product_name"), "product_name", F.lit("traceability_lot_code"), "traceability_lot_code").alias("own"))
    first = F.get("observed_values", F.lit(0))
    seen = checks.groupBy("event_id", "cte", "field_key").agg(F.max(first).alias("value")).groupBy("event_id", "cte").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "value"))).alias("seen"))
    rows = rows.join(seen, ["event_id", "cte"], "left").withColumn("seen", F.coalesce("seen", F.create_map().cast("map<string,string>")))
    own = F.map_filter("own", lambda k, _: ~F.map_contains_key("seen", k))
    rows = rows.withColumn("values", F.map_concat(own, "seen"))
    missing = F.array_sort(F.map_keys(F.map_filter("seen", lambda _, v: F.coalesce(v, F.lit("")) == "")))
    return rows.select("cte", "event_id", "values", missing.alias("missing"))


def export_blockers(rows: DataFrame) -> DataFrame:
    """(event_id, cte, message) of the export's rows that miss fields."""
    text = F.concat(F.lit("Sortable export blocked by missing fields: "), F.array_join("missing", ", "), F.lit("."))
    return rows.filter(F.size("missing") > 0).select("event_id", "cte", text.alias("message"))


def gap_message(label: Column, missing: Column, lot_fields: list[str], lot_gap: Column) -> Column:
    """What a finding says about a record's missing fields (an array of labels), plural where it has to be."""
    others = F.size(F.filter(missing, lambda f: ~f.isin(lot_fields)))
    fields = lambda n: F.concat(F.lit(" required field"), F.when(n == 1, "").otherwise("s"))
    lot = F.concat(label, F.lit(" is missing its Traceability Lot Code (TLC)"), F.when(others > 0, F.concat(F.lit(" and "), others.cast("string"), F.lit(" other"), fields(others))).otherwise(""), F.lit("."))
    one = F.concat(label, F.lit(" is missing a required field: "), F.get(missing, F.lit(0)), F.lit("."))
    return F.when(lot_gap, lot).when(F.size(missing) == 1, one).otherwise(F.concat(label, F.lit(" is missing "), F.size(missing).cast("string"), F.lit(" required fields.")))


def sub_issues(missing: Column, reasons: Column) -> Column:
    """Missing fields as issues, then reasons that aren't among them, each once."""
    return F.array_distinct(F.concat(F.transform(missing, lambda f: F.concat(F.lit("Missing "), f)), F.coalesce(reasons, F.array().cast("array<string>"))))


def numbered_by_event(questions: DataFrame, prefix: str) -> DataFrame:
    """Questions with an id of their event and place, so that none depends on how many came before."""
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("ordinal"))
    return questions.withColumn("question_id", F.concat_ws("-", F.lit(prefix), F.coalesce(F.col("event_id").cast("string"), F.lit("columns")), n.cast("string")))
