"""Event classification: additive scores in hundredths, thresholds, then eight rules folded in a fixed order.

Everything is one projection over the event rows: no join, no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import classifier_cte, contains_any, lookup
from tracemill.plans import cards

#: Rules in order: (id, event types suppressed, event types preferred, abstains, question).
_MOVES = ["shipping", "receiving"]
RULES = [
    ("precedence-first-land-over-generic-receiving", ["receiving"], ["first_land_based_receiving"], False, None),
    ("suppress-direct-to-consumer-shipping", ["shipping"], [], False, None),
    ("abstain-transporter-only", _MOVES, [], True, "Confirm whether this row represents the covered shipper/receiver or only a transporter/carrier record."),
    ("suppress-internal-transfer", _MOVES, [], True, "Confirm whether this internal transfer is a reportable shipping/receiving event."),
    ("abstain-return-or-correction", [], [], True, "Review return/correction evidence before classifying the CTE."),
    ("suppress-non-ftl-output", ["shipping", "transformation"], [], False, "Confirm transformed output FTL scope before applying downstream FTL duties."),
    ("abstain-kill-step-or-exemption-uncertainty", [], [], True, "Resolve exemption, kill-step, or food-scope uncertainty before confident CTE classification."),
    (
        "traceability-plan-exclusive",
        ["harvesting", "cooling", "initial_packing", "first_land_based_receiving", "shipping", "receiving", "transformation"],
        ["traceability_plan"],
        False,
        None,
    ),
]


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def event_terms() -> Column:
    """The text that rules look into: event type, destination and action terms in lower case."""
    parts = [F.coalesce(c, F.lit("")) for c in ("event_type_claim", "destination_type")]
    return F.lower(F.concat_ws(" ", *parts, "action_terms"))


def scores() -> dict[str, Column]:
    """Hundredths for each event type."""
    terms, actions = F.col("_terms"), F.lower(F.concat_ws(" ", "action_terms"))
    points = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    claim, document, role = F.col("_claim"), lookup(F.col("document_type"), cards.DOCUMENT_CTE), lookup(F.col("actor_role"), cards.ROLE_CTE)
    weak = contains_any(terms, cards.WEAK_MOVEMENT)
    moved = _filled("from_partner_id") & _filled("to_partner_id") & (F.col("from_partner_id") != F.col("to_partner_id"))
    business = contains_any(F.lower(F.coalesce("destination_type", F.lit(""))), ["restaurant", "distributor", "business"])
    lot, source, output, dated = (_filled(c) for c in ("lot_or_tlc", "source_lot_or_tlc", "output_lot_or_tlc", "event_datetime"))
    out = {c: points(claim == c, 48) + points(document == c, 26) + points(role == c, 22) for c in cards.CTE_ORDER}
    out["shipping"] += F.when(moved, F.when(weak, 6).otherwise(16)).otherwise(0) + F.when(business, F.when(weak, 4).otherwise(12)).otherwise(0)
    out["shipping"] += points(lot, 3) + points(dated & contains_any(actions, ["date_you_shipped_the_food", "shipping"]), 14)
    out["receiving"] += points(moved, 8) + points(lot, 3) + points(dated & contains_any(actions, ["received_date", "receiving"]), 14)
    made = output & contains_any(terms, cards.TRANSFORMATION_WORDS)
    out["transformation"] += F.when(source & output, 34).when(made, 18).otherwise(0)
    plan = (F.col("document_type") == "traceability_plan") | contains_any(actions, ["traceability_plan", "record_maintenance_procedure"])
    out["traceability_plan"] += points(plan, 72)
    return out


def _conditions() -> list[Column]:
    """When each rule applies, given the columns that classify() prepares; the first also needs receiving to be final."""
    terms, role = F.col("_terms"), F.coalesce("actor_role", F.lit(""))
    carrier = (role.isin("transporter", "carrier") | contains_any(terms, cards.CARRIER_WORDS)) & ~role.isin("shipper", "receiver")
    same = _filled("from_partner_id") & _filled("to_partner_id") & (F.col("from_partner_id") == F.col("to_partner_id"))
    review = F.coalesce("review_required", F.lit(False))
    return [
        F.col("_scores")["first_land_based_receiving"] > 0,
        contains_any(terms, cards.CONSUMER_WORDS),
        carrier,
        contains_any(terms, ["internal transfer"]) | same,
        contains_any(terms, cards.RETURN_WORDS),
        F.coalesce(~F.col("remains_listed"), F.lit(False)),
        (review & contains_any(terms, cards.EXEMPT_WORDS)) | (F.size(F.coalesce("conflict_fields", F.array())) > 0),
        (F.col("document_type") == "traceability_plan") | (F.col("_claim") == "traceability_plan"),
    ]


def classify(events: DataFrame) -> DataFrame:
    """Adds candidate_scores, final_ctes, suppressed_ctes, abstained_ctes, confidence, reviewer_questions and applied_rules.

    events: event_id, event_type_claim, document_type, actor_role, actor_confidence, product_name, from_partner_id,
    to_partner_id, destination_type, lot_or_tlc, source_lot_or_tlc, output_lot_or_tlc, event_datetime, action_terms, remains_listed, review_required,
    conflict_fields. Nulls count as absent.
    """
    df = events.withColumn("_terms", event_terms()).withColumn("_claim", classifier_cte("event_type_claim"))
    pairs = [x for cte, score in scores().items() for x in (F.lit(cte), score)]
    df = df.withColumn("_scores", F.create_map(*pairs))
    needed = lambda c: cards.CTE_NEEDED.get(c, cards.CTE_NEEDED_OTHERS)
    found = F.array(*(F.when(F.col("_scores")[c] >= needed(c), F.lit(c)) for c in cards.CTE_ORDER))
    df = df.withColumn("_candidates", F.array_compact(found))
    empty = F.array().cast("array<string>")
    df = df.withColumns({"_final": F.col("_candidates"), "_suppressed": empty, "_abstained": empty, "_questions": empty, "_applied": empty})
    for k, ((rule, suppress, prefer, abstain, question), condition) in enumerate(zip(RULES, _conditions(), strict=True)):
        applies = F.coalesce(condition, F.lit(False))
        if k == 0:
            applies = applies & F.array_contains("_final", "receiving")
        df = df.withColumn("_on", applies)
        on = lambda then, name: F.when(F.col("_on"), then).otherwise(F.col(name))
        gone = _texts(suppress) if rule == "traceability-plan-exclusive" else F.array_intersect(_texts(suppress), F.col("_final"))
        df = df.withColumn("_suppressed", on(F.concat("_suppressed", gone), "_suppressed"))
        kept = F.array_except("_final", _texts(suppress))
        if prefer:
            new = F.array_except(F.array_intersect(_texts(prefer), F.col("_candidates")), kept)
            kept = F.concat(new, kept)
        df = df.withColumn("_final", on(kept, "_final"))
        if abstain:
            left = F.array_except("_candidates", "_final")
            df = df.withColumn("_abstained", on(F.concat("_abstained", left, *([] if suppress else ["_final"])), "_abstained"))
            if not suppress:
                df = df.withColumn("_final", on(empty, "_final"))
        if question:
            df = df.withColumn("_questions", on(F.concat("_questions", _texts([question])), "_questions"))
        df = df.withColumn("_applied", on(F.concat("_applied", _texts([rule])), "_applied"))
    fields = F.coalesce("conflict_fields", empty)
    asked = F.concat("_questions", F.transform(fields, lambda f: F.concat(F.lit("Resolve conflicting "), f, F.lit(" evidence before confident CTE classification."))))
    extra = [
        (F.col("actor_confidence") < 0.55, "Resolve actor role before confident CTE classification."),
        (F.col("review_required"), "Resolve food/form scope before confident CTE classification."),
    ]
    asked = reduce(lambda q, x: F.concat(q, F.when(F.coalesce(x[0], F.lit(False)), _texts([x[1]])).otherwise(empty)), extra, asked)
    df = df.withColumn("_questions", asked)
    unsure = (F.size("_final") == 0) & (F.size("_questions") == 0) & (F.size("_candidates") > 0)
    df = df.withColumn("_questions", F.when(unsure, _texts(["Review low-signal CTE classification before execution."])).otherwise(F.col("_questions")))
    best = F.least(F.array_max(F.map_values("_scores")), F.lit(96))
    confidence = F.when(F.size("_questions") > 0, F.least(best, F.lit(68))).otherwise(best)
    return df.select(
        *events.columns,
        F.map_filter(F.transform_values("_scores", lambda _, v: (v / 100).cast("decimal(4,2)")), lambda _, v: v > 0).alias("candidate_scores"),
        F.array_distinct("_final").alias("final_ctes"),
        F.array_distinct("_suppressed").alias("suppressed_ctes"),
        F.array_distinct("_abstained").alias("abstained_ctes"),
        (confidence / 100).alias("confidence"),
        F.array_distinct("_questions").alias("reviewer_questions"),
        F.array_distinct("_applied").alias("applied_rules"),
    )
