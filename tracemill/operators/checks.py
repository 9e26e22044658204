"""Rule checks over classified events: required elements, lot lineage, plan, exemptions, findings, queue, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import is_answered, lookup, match_token, real_value, strip
from tracemill.operators.relational import numbered_across
from tracemill.plans import cards

_TEXTS = "array<string>"


def map_obligations(events: DataFrame, obligations: DataFrame) -> DataFrame:
    """(event_id, cte, obligation_id): each final event type with the obligations that apply to it.

    obligations: obligation_id, applies_to array, section; "other" applies to no event type here. The card table is
    exploded to one row per event type, so the join is an equi-join.
    """
    wanted = obligations.select("obligation_id", "section", F.explode("applies_to").alias("cte")).filter(F.col("cte") != "other")
    needed = F.create_map(*(F.lit(x) for item in cards.CONTRACT_SECTIONS.items() for x in item))
    fits = F.coalesce(F.col("section").startswith(F.try_element_at(needed, F.col("cte"))), F.lit(False))
    rows = events.select("event_id", F.explode("final_ctes").alias("cte"))
    return rows.join(wanted.filter(fits), "cte").select("event_id", "cte", "obligation_id")


def kde_checks(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """(event_id, cte, ordinal, field_key, status, severity, observed_values) for every element of every final event type.

    events: event_id, final_ctes, facts (map of arrays). Placeholders count as absent; any listed field will do; two values of
    a single listed field conflict.
    """
    rows = events.select("event_id", "facts", F.explode("final_ctes").alias("cte"))
    joined = rows.join(F.broadcast(contracts), "cte")  # a fixed card table
    answered = lambda f: F.array_distinct(
        F.filter(F.coalesce(F.try_element_at(F.col("facts"), f), F.array().cast(_TEXTS)), lambda v: is_answered(v))
    )
    by_field = F.transform("satisfied_by", answered)
    out = joined.withColumn("observed_values", F.array_sort(F.array_distinct(F.flatten(by_field))))
    status = (
        F.when(F.size("satisfied_by") == 0, "not_captured")
        .when((F.size("satisfied_by") == 1) & (F.size("observed_values") > 1), "conflicting")
        .when(F.size("observed_values") > 0, "present")
        .when(F.col("requirement") == "conditional", "not_applicable")
        .otherwise("missing")
    )
    return out.select("event_id", "cte", "ordinal", F.col("kde").alias("field_key"), status.alias("status"), "severity", "observed_values")


def lot_checks(events: DataFrame) -> DataFrame:
    """(event_id, cte, status, reason): whether lots are recorded and a transformation's source lot is known upstream.

    Upstream lots are the lots and output lots of all events, this one's included, compared without case.
    """
    lots = events.select(F.explode(F.array(real_value("lot_or_tlc"), real_value("output_lot_or_tlc"))).alias("lot"))
    known = lots.filter("lot is not null").select(F.lower(strip("lot")).alias("_lot")).distinct().withColumn("_known", F.lit(True))
    rows = events.select("event_id", F.explode("final_ctes").alias("cte"), *(real_value(c).alias(c) for c in ("lot_or_tlc", "source_lot_or_tlc", "output_lot_or_tlc")))
    rows = rows.filter(F.col("cte").isin("initial_packing", "first_land_based_receiving", "transformation", "shipping", "receiving"))
    rows = rows.join(known, F.lower(strip("source_lot_or_tlc")) == F.col("_lot"), "left")
    lot, source, output = (F.col(c).isNotNull() for c in ("lot_or_tlc", "source_lot_or_tlc", "output_lot_or_tlc"))
    reason = (
        F.when((F.col("cte") == "transformation") & ~(source & output), "source_or_output_lot_missing")
        .when((F.col("cte") == "transformation") & F.col("_known").isNull(), "source_lot_not_upstream")
        .when(F.col("cte").isin("initial_packing", "first_land_based_receiving") & ~(lot | output), "lot_not_assigned")
        .when(F.col("cte").isin("shipping", "receiving") & ~lot, "lot_missing")
        .otherwise("linked")
    )
    return rows.select("event_id", "cte", F.when(reason == "linked", "linked").otherwise("gap").alias("status"), reason.alias("reason"))


def plan_checks(answers: DataFrame, parts: DataFrame, has_farm: Column | bool) -> DataFrame:
    """(ordinal, component, status) of a plan's parts, from (item, answer) rows; farm parts apply to farms only."""
    item = F.lower(F.coalesce("item", F.lit("")))
    found = answers.select(item.alias("_item"), is_answered("answer").alias("_ok")).crossJoin(F.broadcast(parts))  # six fixed parts
    hit = F.exists("match_terms", lambda t: F.contains(F.col("_item"), t)) & F.col("_ok")
    met = found.filter(hit).select("ordinal").distinct().withColumn("_met", F.lit(True))
    farm = F.lit(has_farm) if isinstance(has_farm, bool) else has_farm
    status = F.when(F.col("farm_only") & ~farm, "not_applicable").when(F.col("_met"), "present").otherwise("missing")
    return parts.join(met, "ordinal", "left").select("ordinal", "component", status.alias("status"))


def exemption_checks(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """(claim_id, exemption_type, status): claims matched by name, else by containment; the first rule wins. Never granted."""
    names = rules.select("ordinal", "exemption_type", F.explode(F.concat(F.array("exemption_type"), F.col("aliases"))).alias("_name"))
    names = names.select("ordinal", "exemption_type", match_token("_name").alias("_name")).distinct()
    asked = claims.withColumn("_claim", match_token("claim_type")).filter(F.col("_claim") != "")
    pairs = asked.crossJoin(F.broadcast(names))  # a few dozen fixed names
    exact = F.col("_claim") == F.col("_name")
    near = F.contains(F.col("_claim"), F.col("_name")) | F.contains(F.col("_name"), F.col("_claim"))
    best = pairs.filter(exact | near).groupBy("claim_id").agg(F.min(F.struct(F.when(exact, 0).otherwise(1).alias("pass"), "ordinal", "exemption_type")).alias("m"))
    evidenced = F.lower(strip("evidence")).isin(cards.EVIDENCED_ANSWERS)
    out = asked.join(best, "claim_id", "left")
    status = F.when(F.col("m").isNull() | evidenced, "needs_review").otherwise("not_determined")
    return out.select("claim_id", F.col("m.exemption_type").alias("exemption_type"), status.alias("status"))


def export_readiness(checks: DataFrame) -> DataFrame:
    """(event_id, cte, status, missing_fields, populated_fields) from element checks."""
    names = lambda keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("ordinal", "field_key")))), lambda s: s["field_key"])
    out = checks.groupBy("event_id", "cte").agg(
        names(F.col("status").isin("missing", "conflicting")).alias("missing_fields"), names(F.col("status") == "present").alias("populated_fields")
    )
    return out.select("event_id", "cte", F.when(F.size("missing_fields") == 0, "ready").otherwise("blocked").alias("status"), "missing_fields", "populated_fields")


def record_findings(kde: DataFrame, lots: DataFrame) -> DataFrame:
    """One finding per event with gaps: finding_type, severity, fields, reasons, confidence; a lot gap is the root cause."""
    gaps = kde.filter(~F.col("status").isin("present", "not_applicable", "not_captured")).select(
        "event_id", "cte", "ordinal", "field_key", F.lit(None).cast("string").alias("reason")
    )
    links = lots.filter(F.col("status") != "linked").select(
        "event_id", "cte", F.lit(999).alias("ordinal"), F.lit(None).cast("string").alias("field_key"), "reason"
    )
    fields = F.array_distinct(F.transform(F.filter("_all", lambda x: x["field_key"].isNotNull()), lambda x: x["field_key"]))
    reasons = F.array_distinct(F.transform(F.filter("_all", lambda x: x["reason"].isNotNull()), lambda x: x["reason"]))
    out = gaps.unionByName(links).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "cte", "field_key", "reason"))).alias("_all"))
    out = out.select("event_id", F.col("_all")[0]["cte"].alias("cte"), fields.alias("fields"), reasons.alias("reasons"))
    texts = lambda names: F.array(*map(F.lit, names))
    root = F.arrays_overlap("fields", texts(cards.LOT_FIELDS)) | (F.size("reasons") > 0)
    high = root | F.arrays_overlap("fields", texts(cards.HIGH_FIELDS))
    return out.select(
        "event_id",
        "cte",
        F.when(root, "tlc_lineage").otherwise("kde_completeness").alias("finding_type"),
        F.when(high, "high").otherwise("medium").alias("severity"),
        "fields",
        "reasons",
        F.when(root, 0.9).otherwise(0.88).alias("confidence"),
    )


def plan_findings(plan: DataFrame) -> DataFrame:
    """One finding listing all missing parts, or none."""
    missing = plan.filter(~F.col("status").isin("present", "not_applicable"))
    out = missing.agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "component"))), lambda s: s["component"]).alias("fields"))
    none = F.lit(None).cast("string")
    return out.filter(F.size("fields") > 0).select(
        none.alias("event_id"), F.lit("traceability_plan").alias("cte"), F.lit("traceability_plan").alias("finding_type"), F.lit("medium").alias("severity"),
        "fields", F.array().cast(_TEXTS).alias("reasons"), F.lit(0.86).alias("confidence"),
    )


def claim_findings(claims: DataFrame) -> DataFrame:
    """One review finding for all claims together, or none."""
    out = claims.agg(F.array_sort(F.collect_set(F.concat_ws(":", "claim_id", "status"))).alias("reasons")).filter(F.size("reasons") > 0)
    none = F.lit(None).cast("string")
    return out.select(
        none.alias("event_id"), none.alias("cte"), F.lit("exemption_claim").alias("finding_type"), F.lit("medium").alias("severity"),
        F.array().cast(_TEXTS).alias("fields"), "reasons", F.lit(0.68).alias("confidence"),
    )


def exception_queue(findings: DataFrame, run: str) -> DataFrame:
    """One item per finding of a run, numbered in order of events (those of no event last)."""
    queue = F.coalesce(lookup(F.col("finding_type"), cards.QUEUES), F.lit("review_item"))
    out = findings.select(F.lit(run).alias("run_id"), "event_id", "finding_type", queue.alias("queue_type"), F.when(F.col("severity") == "high", "high").otherwise("medium").alias("priority"))
    return numbered_across(out, [F.col("event_id").asc_nulls_last(), F.col("finding_type")], "exception-", "exception_id")


def readiness(findings: DataFrame) -> DataFrame:
    """One row: blocked if any gap is of high severity, needs_review if there is any finding, else ready."""
    out = findings.agg(F.count_if(F.col("severity") == "high").alias("high"), F.count(F.lit(1)).alias("all"))
    return out.select(F.when(F.col("high") > 0, "blocked").when(F.col("all") > 0, "needs_review").otherwise("ready").alias("status"), F.col("all").alias("findings"))

