"""Scenario regression on fixtures: benchmarks, each check failing, and overrides."""

from tracemill.operators import regression as R

EVENTS = "benchmark_id string, events array<struct<event_id:string,cte_type:string>>"
KDE = [("harvesting", ["harvest_date"]), ("initial_packing", ["packing_date"]), ("shipping", ["ship_date"]), ("first_land_based_receiving", ["landed_date"]), ("transformation", ["lot"])]


def built(spark, *drafts, kde=KDE):
    return R.benchmarks(spark.createDataFrame(drafts, EVENTS), spark.createDataFrame(kde, "cte string, field_keys array<string>"))


def ran(spark, marks, approved, complete, reason=None):
    coverage = spark.createDataFrame([(k, "complete") for k in complete] + [("odd", "partial")], "benchmark_id string, coverage_status string")
    known = spark.createDataFrame([(a,) for a in approved], "obligation_id string")
    return {r.benchmark_id: r for r in R.run_regression(marks, coverage, known, reason).collect()}


def test_benchmarks(spark):
    marks = built(spark, ("cucumber", [("e1", "harvesting"), ("e2", "initial_packing"), ("e3", "shipping"), ("e4", "harvesting")]), ("plan", [("e0", "traceability_plan")]), ("none", None))
    by = {r.benchmark_id: r for r in marks.collect()}
    cucumber = by["cucumber"]
    assert cucumber.expected_ctes == ["harvesting", "initial_packing", "shipping"] and cucumber.expected_tlc_obligation_ids == [R.ASSIGNMENT]
    assert cucumber.expected_obligation_ids == [R.SCOPE, R.PLAN, *(R.KDE_BY_CTE[c] for c in cucumber.expected_ctes), R.ASSIGNMENT, *R.RECORDS, R.EXPORT]
    assert cucumber.events[1].expected_obligation_ids == [R.KDE_BY_CTE["initial_packing"], R.ASSIGNMENT] and cucumber.events[0].expected_kde_field_keys == ["harvest_date"]
    assert cucumber.events[2].expected_tlc_behavior == R.LOT_BEHAVIOR[2][1] and by["plan"].events[0].expected_tlc_behavior == R.LOT_BEHAVIOR[-1][1]
    assert by["none"].expected_ctes == [] and by["none"].expected_obligation_ids == [R.SCOPE, R.PLAN, *R.RECORDS, R.EXPORT]


def test_checks_and_overrides(spark):
    marks = built(spark, ("tuna", [("e1", "first_land_based_receiving"), ("e2", "shipping")]), ("odd", [("e1", "flying"), ("e2", "cooling")]), ("plan", [("e0", "traceability_plan")]))
    every = [R.SCOPE, R.PLAN, R.ASSIGNMENT, *R.RECORDS, R.EXPORT, *R.KDE_BY_CTE.values()]
    got = ran(spark, marks, every, ["tuna", "plan"])
    assert (got["tuna"].status, got["tuna"].failures, got["plan"].status) == ("pass", [], "pass")
    assert got["odd"].failed_checks == ["citations_complete", "event_contract"]
    assert got["odd"].failures == ["citation coverage is partial, not complete", "e1 executable obligation is empty", "e2 KDE fields is empty"]
    lacking = [a for a in every if "LAND-BASED" not in a]
    got = ran(spark, marks, lacking, ["tuna"], " ")
    assert got["tuna"].status == "fail" and got["tuna"].failed_checks == ["event_contract", "expected_obligations_approved"]
    assert got["plan"].failures == ["citation coverage is missing, not complete"]
    got = ran(spark, marks, lacking, ["tuna", "plan"], "accepted by the reviewer")
    assert (got["tuna"].status, got["plan"].status) == ("reviewer_override", "pass")
    from pyspark.sql import functions as F

    bare = marks.filter("benchmark_id = 'plan'").withColumns({"expected_plan_ids": F.array().cast("array<string>"), "expected_export_ids": F.array().cast("array<string>")})
    assert ran(spark, bare, every, ["plan"])["plan"].failures == ["sortable export obligations is empty", f"traceability plan obligation lacks {R.PLAN}"]


def test_only_failures_are_gathered(spark):
    """A benchmark gives one row and one for each value that isn't approved, whatever is expected of it, and its wide row isn't shuffled."""
    marks = built(spark, ("tuna", [("e1", "first_land_based_receiving"), ("e2", "shipping")]), ("odd", [("e1", "flying"), ("e1", "flying")]))
    every = [R.SCOPE, R.PLAN, R.ASSIGNMENT, *R.RECORDS, R.EXPORT, *R.KDE_BY_CTE.values()]
    sets = spark.createDataFrame([("approved obligations", a) for a in every if "SHIPPING" not in a], "set_name string, value string")
    coverage = spark.createDataFrame([("tuna", "complete"), ("tuna", "partial"), ("unknown", "partial"), (None, "partial")], "benchmark_id string, coverage_status string")
    rows = sorted((r.benchmark_id, r.marked, sorted(f.failure for f in r.failed)) for r in R.failures(marks, coverage, sets).collect())
    lacks = f"not among approved obligations: {R.KDE_BY_CTE['shipping']}"
    assert rows == [
        ("odd", True, ["e1 executable obligation is empty"] * 2), ("tuna", False, []), ("tuna", False, ["citation coverage is partial, not complete"]), ("tuna", True, []),
        ("tuna", True, [f"e2 obligations {lacks}"]), ("tuna", True, [f"obligations {lacks}"]), ("unknown", False, ["citation coverage is partial, not complete"]),
    ]
    got = {r.benchmark_id: r for r in R.run_regression(marks, coverage, sets.selectExpr("value obligation_id")).collect()}
    assert set(got) == {"tuna", "odd"} and got["odd"].failures == ["citation coverage is missing, not complete", "e1 executable obligation is empty"]
    assert got["tuna"].failed_checks == ["citations_complete", "event_contract", "expected_obligations_approved"] and len(got["tuna"].failures) == 3
