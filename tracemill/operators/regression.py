"""Scenario regression: benchmarks built from drafts, expectations as rows, and one comparer for all of them.

A benchmark is turned into rows that each expect one thing of one subject. The comparer knows four kinds of expectation and
nothing of what they are about; what may be approved is joined, so neither benchmarks nor approvals have to fit anywhere. What a benchmark's row
can tell is told there, and only failures are brought together, by one shuffle of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: obligations that every benchmark expects, and those of event types.
SCOPE = "FSMA204-OBL-DET-1300-SCOPE"
PLAN = "FSMA204-OBL-DET-1315-TRACEABILITY-PLAN"
ASSIGNMENT = "FSMA204-OBL-DET-1320-TLC-ASSIGNMENT"
RECORDS = ["FSMA204-OBL-DET-1455-RECORDS-MAINTENANCE", "FSMA204-OBL-DET-1455-FDA-REQUEST"]
EXPORT = "FSMA204-OBL-DET-1455-SORTABLE-SPREADSHEET"
KDE_BY_CTE = {
    "harvesting": "FSMA204-OBL-DET-1325-HARVEST-COOLING-KDES",
    "cooling": "FSMA204-OBL-DET-1325-HARVEST-COOLING-KDES",
    "initial_packing": "FSMA204-OBL-DET-1330-INITIAL-PACKING-KDES",
    "first_land_based_receiving": "FSMA204-OBL-DET-1335-FIRST-LAND-BASED-RECEIVING-KDES",
    "shipping": "FSMA204-OBL-DET-1340-SHIPPING-KDES",
    "receiving": "FSMA204-OBL-DET-1345-RECEIVING-KDES",
    "transformation": "FSMA204-OBL-DET-1350-TRANSFORMATION-KDES",
}
ASSIGNING = ["initial_packing", "first_land_based_receiving", "transformation"]
PLAN_EVENT = "traceability_plan"
# --- Fixed values: what is expected of lot codes, by event types; the last holds for all others.
LOT_BEHAVIOR = [
    (["transformation"], "Transformation must assign a new traceability lot code for output food and preserve input lot lineage."),
    (["initial_packing", "first_land_based_receiving"], "This CTE must assign the traceability lot code and link KDEs to the assigned lot."),
    (["shipping", "receiving"], "This CTE must preserve the traceability lot code and link pass-forward records to the lot."),
    (["harvesting", "cooling"], "Harvesting or cooling KDEs must remain available for linkage to the initial packed traceability lot."),
    ([], "TLC behavior follows the approved Subpart S obligation set for this CTE."),
]

_TEXTS = "array<string>"


def _texts(*values) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(_TEXTS)


def _kde(cte: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for item in KDE_BY_CTE.items() for x in item)), cte)


def lot_behavior(cte: Column) -> Column:
    out = F.lit(LOT_BEHAVIOR[-1][1])
    for ctes, text in LOT_BEHAVIOR[-2::-1]:
        out = F.when(cte.isin(ctes), text).otherwise(out)
    return out


def event_obligations(cte: Column) -> Column:
    return F.array_compact(F.array(_kde(cte), F.when(cte.isin(ASSIGNING), ASSIGNMENT)))


def benchmarks(drafts: DataFrame, kde_fields: DataFrame) -> DataFrame:
    """Benchmarks of scenario drafts: expected event types and obligations, and for each event its obligations, KDE fields and lot behaviour.

    drafts: benchmark_id, events (array of event_id, cte_type, in order). kde_fields: cte, field_keys, a row for an event type (some ten in all). Event types and obligations are kept in the order of their first
    use, without repeats; an event of an unknown type has no obligation and no fields. Null events are none.
    """
    fields = kde_fields.agg(F.map_from_entries(F.collect_list(F.struct("cte", "field_keys"))).alias("_fields"))  # some ten event types
    rows = drafts.crossJoin(F.broadcast(fields))  # one row
    rows = rows.withColumn("events", F.coalesce("events", F.array().cast("array<struct<event_id:string,cte_type:string>>")))
    detail = F.transform(
        "events",
        lambda e: F.struct(
            e["event_id"].alias("event_id"), e["cte_type"].alias("cte_type"), event_obligations(e["cte_type"]).alias("expected_obligation_ids"),
            F.coalesce(F.try_element_at("_fields", e["cte_type"]), _texts()).alias("expected_kde_field_keys"), lot_behavior(e["cte_type"]).alias("expected_tlc_behavior"),
        ),
    )
    rows = rows.withColumns({"expected_ctes": F.array_distinct(F.transform("events", lambda e: e["cte_type"])), "events": detail})
    kde = F.array_distinct(F.array_compact(F.transform("expected_ctes", lambda c: _kde(c))))
    lots = F.when(F.exists("expected_ctes", lambda c: c.isin(ASSIGNING)), _texts(ASSIGNMENT)).otherwise(_texts())
    rows = rows.withColumns({"expected_kde_obligation_ids": kde, "expected_tlc_obligation_ids": lots})
    rows = rows.withColumns({"expected_plan_ids": _texts(PLAN), "expected_records_ids": _texts(*RECORDS), "expected_export_ids": _texts(EXPORT)})
    every = F.concat(_texts(SCOPE), "expected_plan_ids", "expected_kde_obligation_ids", "expected_tlc_obligation_ids", "expected_records_ids", "expected_export_ids")
    return rows.withColumn("expected_obligation_ids", F.array_distinct(every)).drop("_fields")


def what(check: str, kind: str, subject: Column, actual: Column, wanted: Column) -> Column:
    """An expectation. Kinds: equals (actual is wanted), in_set (each of actual is in the set that wanted names), present (actual isn't empty), has (wanted is among actual)."""
    return F.struct(F.lit(check).alias("check_id"), F.lit(kind).alias("kind"), subject.alias("subject"), actual.alias("actual"), wanted.cast("string").alias("wanted"))


def _one(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(_texts())


def covered(status: Column) -> Column:
    """What is expected of the status of a benchmark's citations; null stands for none."""
    return F.array(what("citations_complete", "equals", F.lit("citation coverage"), _one(status), F.lit("complete")))


def expectations() -> Column:
    """Everything that is expected of a benchmark itself, as an array of expectations over its columns."""
    none, name = F.lit(None), F.lit
    whole = F.array(
        what("expected_obligations_approved", "in_set", name("obligations"), F.col("expected_obligation_ids"), name("approved obligations")),
        what("traceability_plan_contract", "has", name("traceability plan obligation"), F.col("expected_plan_ids"), name(PLAN)),
        what("traceability_plan_contract", "present", name("records obligations"), F.col("expected_records_ids"), none),
        what("traceability_plan_contract", "present", name("sortable export obligations"), F.col("expected_export_ids"), none),
    )

    def of_event(e: Column) -> Column:
        about = lambda part: F.concat(e["event_id"], F.lit(f" {part}"))
        event = "event_contract"
        return F.array_compact(
            F.array(
                F.when(e["cte_type"] != PLAN_EVENT, what(event, "present", about("executable obligation"), e["expected_obligation_ids"], none)),
                what(event, "in_set", about("obligations"), e["expected_obligation_ids"], name("approved obligations")),
                F.when(e["cte_type"].isin(list(KDE_BY_CTE)), what(event, "present", about("KDE fields"), e["expected_kde_field_keys"], none)),
                what(event, "present", about("TLC behavior"), _one(e["expected_tlc_behavior"]), none),
            )
        )

    return F.concat(whole, F.flatten(F.transform("events", of_event)))


def plain_failures(expected: Column) -> Column:
    """(check_id, failure) of the expectations that need no set."""

    def message(x: Column) -> Column:
        first = F.coalesce(F.get(x["actual"], F.lit(0)), F.lit("missing"))
        kind, wanted = x["kind"], x["wanted"]
        told = (
            F.when((kind == "equals") & (first != wanted), F.concat(F.lit("is "), first, F.lit(", not "), wanted))
            .when((kind == "has") & ~F.array_contains(x["actual"], wanted), F.concat(F.lit("lacks "), wanted))
            .when((kind == "present") & (F.size(x["actual"]) == 0), F.lit("is empty"))
        )
        return F.when(told.isNotNull(), F.struct(x["check_id"].alias("check_id"), F.concat_ws(" ", x["subject"], told).alias("failure")))

    return F.array_compact(F.transform(expected, message))


def failures(marks: DataFrame, coverage: DataFrame, sets: DataFrame) -> DataFrame:
    """(benchmark_id, marked, covered, checks, failed): rows to be brought together, with the failures that each part tells. sets: set_name, value.

    A benchmark gives one row and another for each value that a set lacks; a coverage gives one.
    """
    value = lambda x: F.transform(
        x["actual"], lambda v: F.struct(F.lit(None).cast("array<struct<check_id:string,failure:string>>").alias("failed"), x["check_id"].alias("check_id"), x["subject"].alias("subject"), x["wanted"].alias("set_name"), v.alias("value"))
    )
    asked = F.flatten(F.transform(F.filter("expected", lambda x: x["kind"] == "in_set"), value))
    text = F.lit(None).cast("string")
    own = F.struct(plain_failures(F.col("expected")).alias("failed"), text.alias("check_id"), text.alias("subject"), text.alias("set_name"), text.alias("value"))
    rows = marks.select("benchmark_id", expectations().alias("expected")).select("benchmark_id", F.inline(F.concat(F.array(own), F.array_distinct(asked))))
    known = sets.select("set_name", "value").distinct().withColumn("_in", F.lit(True))
    rows = rows.join(known, ["set_name", "value"], "left").filter(F.col("failed").isNotNull() | (F.col("value").isNotNull() & F.col("_in").isNull()))
    absent = F.array(F.struct("check_id", F.concat_ws(" ", "subject", F.concat(F.lit("not among "), "set_name", F.lit(": "), "value")).alias("failure")))
    told = rows.select("benchmark_id", F.lit(True).alias("marked"), F.lit(False).alias("covered"), F.coalesce("failed", absent).alias("failed"))
    status = coverage.filter(F.col("benchmark_id").isNotNull())
    told = told.unionByName(status.select("benchmark_id", F.lit(False).alias("marked"), F.lit(True).alias("covered"), plain_failures(covered(F.col("coverage_status"))).alias("failed")))
    return told.withColumn("checks", F.array_distinct(F.transform("failed", lambda f: f["check_id"])))


def run_regression(marks: DataFrame, coverage: DataFrame, approved: DataFrame, override_reason: str | None = None) -> DataFrame:
    """(benchmark_id, status, failed_checks, failures): pass, fail, or reviewer_override where a reason was given; a blank reason is none.

    approved: obligation_id. Benchmarks are known by their ids, which have to be unique.
    """
    sets = approved.select(F.lit("approved obligations").alias("set_name"), F.col("obligation_id").alias("value"))
    told = failures(marks, coverage, sets)
    # rows are dealt before they are gathered, by a number that isn't lowered by their size: a task would else sort all rows that it reads
    dealt = told.repartition(int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")), "benchmark_id")
    rows = dealt.groupBy("benchmark_id").agg(
        F.max("marked").alias("marked"), F.max("covered").alias("covered"), F.array_distinct(F.flatten(F.collect_list("checks"))).alias("checks"), F.array_distinct(F.flatten(F.collect_list("failed"))).alias("failed")
    )
    none = plain_failures(covered(F.lit(None).cast("string")))
    rows = rows.filter("marked").select(
        "benchmark_id",
        F.array_sort(F.when(F.col("covered"), F.col("checks")).otherwise(F.array_union("checks", F.array(F.lit("citations_complete"))))).alias("failed_checks"),
        F.array_sort(F.transform(F.when(F.col("covered"), F.col("failed")).otherwise(F.concat("failed", none)), lambda f: f["failure"])).alias("failures"),
    )
    otherwise = "reviewer_override" if (override_reason or "").strip() else "fail"
    return rows.select("benchmark_id", F.when(F.size("failed_checks") == 0, "pass").otherwise(otherwise).alias("status"), "failed_checks", "failures")
