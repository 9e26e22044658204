"""Domain semantics on small inline tables."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.operators import checks, classify, evidence, relational
from tracemill.plans import cards


def values(spark, rows, *columns):
    names = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [tuple(r) for r in df.select(*(c(*names) if callable(c) else c for c in columns)).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-06-10", "2026-06-10"), ("06/10/2026", "2026-06-10"), ("20260611", "2026-06-11"), ("6/12/26", "2026-06-12"), ("1/1/70", "1970-01-01"),
        ("31/12/2025", "2025-12-31"), ("5-Jan-2026", "2026-01-05"), ("June 3 2026", "2026-06-03"), ("2026 6 1", "2026-06-01"), ("02/30/2026", None),
        ("2026.01.05", "2026-01-05"), ("TLC-1", None), ("", None), (None, None),
    ],
)
def test_dates(spark, text, want):
    assert values(spark, [(text,)], S.parse_date) == [(want,)]


def test_values(spark):
    rows = [
        ("tlc 777", "traceability_lot_code", "TLC777"), ("1,200 lbs", "quantity", "1200"), ("Pounds.", "unit", "lb"), ("Y", "is_ftl_maybe", "yes"), ("=2+3", "quantity", "=2+3"),
        ("06/10/2026", "event_datetime", "2026-06-10"), ("a  b", "product_name", "a b"), (None, "unit", ""),
    ]
    assert [v for (v,) in values(spark, [r[:2] for r in rows], S.normalize_value)] == [r[2] for r in rows]


def test_text_functions(spark):
    got = values(spark, [("baby-leaf_mix  Salad",)], S.title, S.slug, lambda c: S.stable_id("lot", c))
    assert got == [("Baby-Leaf Mix  Salad", "baby_leaf_mix_salad", "lot-baby_leaf_mix_salad")]
    letters = spark.range(1).select(*(S.column_letter(F.lit(k)).alias(str(k)) for k in (1, 26, 27, 52, 53, 702, 703, 728))).first()
    assert tuple(letters) == ("A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ")
    assert values(spark, [("UNKNOWN",), (" tbd ",), ("TLC-1",), (None,)], S.is_answered) == [(False,), (False,), (True,), (False,)]
    two = values(spark, [("first land-based receiving",)], S.evidence_cte, S.classifier_cte)
    assert two == [("first_land_based_receiving", None)]


def gold_events():
    """Ten templates, five times each: (event type, role, document, destination, stays listed, final, suppressed, abstained)."""
    others = [c for c in cards.CTE_ORDER if c != "traceability_plan"]
    templates = [
        ("shipping", "shipper", "shipping_log", "Regional distributor", True, ["shipping"], [], []),
        ("receiving", "receiver", "receiving_log", None, True, ["receiving"], [], []),
        ("receiving", "first_land_based_receiver", "seafood_landing_record", None, True, ["first_land_based_receiving"], ["receiving"], []),
        ("shipping", "shipper", "shipping_log", "direct to consumer", True, [], ["shipping"], []),
        ("transformation", "processor", "transformation_batch_record", None, True, ["transformation"], [], []),
        ("transformation", "processor", "transformation_batch_record", None, False, [], ["transformation"], []),
        ("shipping", "transporter", "bill_of_lading", None, True, [], ["shipping"], ["shipping"]),
        ("shipping", "shipper", "shipping_log", "internal transfer", True, [], ["shipping"], ["shipping"]),
        ("shipping", "shipper", "shipping_log", "customer return correction", True, [], [], ["shipping"]),
        ("traceability_plan", "unknown", "traceability_plan", None, True, ["traceability_plan"], others, []),
    ]
    rows = []
    for k in range(50):
        kind, role, document, destination, stays, *want = templates[k % 10]
        made = kind == "transformation"
        move = kind == "shipping" and role != "transporter"
        rows.append(
            (
                f"e{k:03d}", kind, document, role, 0.9, "Fresh Basil", "supplier-a" if move else None,
                "buyer-b" if move and destination not in ("internal transfer", "direct to consumer") else None, destination, "TLC-BENCH",
                "SRC-001" if made else None, f"OUT-{k}" if made else None, "2026-06-10", [kind, document, destination or ""], stays, not stays, [], *want,
            )
        )
    return rows


EVENT_SCHEMA = (
    "event_id string, event_type_claim string, document_type string, actor_role string, actor_confidence double, product_name string, from_partner_id string, "
    "to_partner_id string, destination_type string, lot_or_tlc string, source_lot_or_tlc string, output_lot_or_tlc string, event_datetime string, "
    "action_terms array<string>, remains_listed boolean, review_required boolean, conflict_fields array<string>, want array<string>, want_suppressed array<string>, "
    "want_abstained array<string>"
)


def test_gold_classification(spark):
    got = classify.classify(spark.createDataFrame(gold_events(), EVENT_SCHEMA)).collect()
    assert len(got) == 50
    for row in got:
        assert row.final_ctes == row.want, row.event_id
        assert set(row.suppressed_ctes) == set(row.want_suppressed), row.event_id
        assert set(row.abstained_ctes) >= set(row.want_abstained), row.event_id
        assert 0 <= row.confidence <= 0.96


def test_classification_of_nulls(spark):
    empty = spark.createDataFrame([("e",) + (None,) * 19], EVENT_SCHEMA)
    row = classify.classify(empty).first()
    assert row.final_ctes == [] and row.confidence == 0
    assert classify.classify(empty.limit(0)).count() == 0


def sheet(spark, rows, name="csv"):
    return spark.createDataFrame([("f.csv", name, k, r) for k, r in enumerate(rows, 1)], "file string, sheet string, row_number int, cells array<string>")


def test_messy_header_band(spark):
    rows = sheet(
        spark,
        [
            ["Weekly report", None, None],
            [None, None, None],
            ["Product", "Lot #", "Event Date"],
            ["Fresh Basil", "tlc-900", "06/10/2026"],
            ["notes: checked", None, None],
            ["Product", "Lot #", "Event Date"],
            ["Tuna", "TLC-901", "20260611"],
        ],
    )
    got = evidence.evidence_records(rows)
    cells = {(r.row_number, r.field_key): r.normalized_value for r in got.collect()}
    assert cells == {
        (4, "product_name"): "Fresh Basil", (4, "traceability_lot_code"): "TLC-900", (4, "event_datetime"): "2026-06-10",
        (7, "product_name"): "Tuna", (7, "traceability_lot_code"): "TLC-901", (7, "event_datetime"): "2026-06-11",
    }
    assert {r.cell for r in got.filter("row_number = 4").collect()} == {"A4", "B4", "C4"}
    assert evidence.quality_report(got).first().quality_gate == "pass"


def test_conflict_in_a_row(spark):
    got = evidence.evidence_records(sheet(spark, [["Lot #", "TLC", "Odd column"], ["TLC-1", "TLC-2", "x"]]))
    report = evidence.quality_report(got).first()
    assert (report.conflicts, report.quality_gate, report.mapped, report.records) == (1, "needs_review", 2, 3)


def workbook(spark):
    head = ["event_id", "event_type", "event_datetime", "actor_location_id", "from_partner_id", "to_partner_id", "reference_record_type", "reference_record_no"]
    heads = sheet(
        spark,
        [
            head,
            ["SHIP-1", "shipping", "2026-06-10", "LOC-1", "P-1", "P-2", "BOL", "77"],
            ["REC-1", "receiving", "2026-06-11", "LOC-1", "P-2", "P-1", "invoice", "78"],
            ["TRANS-1", "transformation", "2026-06-12", "LOC-1", None, None, "batch", "79"],
        ],
        "05_CTE_Events",
    )
    line = ["event_line_id", "event_id", "product_id", "product_name", "lot_or_tlc", "quantity", "ftl_category", "output_lot_or_tlc"]
    lines = sheet(
        spark,
        [
            line,
            ["L1", "SHIP-1", "PROD-1", "Fresh Basil", "TLC-1", "10", "herbs", None],
            ["L2", "REC-1", "PROD-1", "Fresh Basil", "UNKNOWN", "12", "herbs", None],
            ["L3", "TRANS-1", "PROD-1", "Fresh Basil", None, "9", "herbs", "TLC-9"],
        ],
        "06_Event_Line_Items",
    )
    return heads.unionByName(lines)


def test_evidence_to_findings(spark):
    # each stage is read several times: keep it
    facts = evidence.row_facts(evidence.evidence_records(workbook(spark).persist()).persist()).persist()
    found = evidence.events(evidence.event_rows(facts, "05_CTE_Events", "06_Event_Line_Items").persist()).persist()
    events = classify.classify(found).persist()
    kinds = {r.event_id: r.final_ctes for r in events.collect()}
    assert kinds == {"SHIP-1:L1": ["shipping"], "REC-1:L2": ["receiving"], "TRANS-1:L3": ["transformation"]}
    kde = checks.kde_checks(events, cards.contracts(spark))
    status = {(r.event_id, r.field_key): r.status for r in kde.collect()}
    assert status["SHIP-1:L1", "traceability_lot_code"] == "present"
    assert status["REC-1:L2", "traceability_lot_code"] == "missing"
    assert status["TRANS-1:L3", "source_lot_or_tlc"] == "missing"
    findings = checks.record_findings(kde, checks.lot_checks(events))
    assert sorted((r.event_id, r.finding_type, r.severity) for r in findings.collect()) == [
        ("REC-1:L2", "tlc_lineage", "high"),
        ("TRANS-1:L3", "tlc_lineage", "high"),
    ]
    answers = spark.createDataFrame([("record_maintenance_procedure", "binder 4"), ("point_of_contact", "TBD")], "item string, answer string")
    plan = checks.plan_findings(checks.plan_checks(answers, cards.plan_parts(spark), False))
    assert plan.first().fields == ["ftl_food_identification", "tlc_assignment_procedure", "point_of_contact", "plan_update_and_retention"]
    claims = spark.createDataFrame([("c1", "Small Producer", "yes"), ("c2", "our carrier only", ""), ("c3", "moon dust", "yes")], "claim_id string, claim_type string, evidence string")
    got = {r.claim_id: (r.exemption_type, r.status) for r in checks.exemption_checks(claims, cards.exemptions(spark)).collect()}
    assert got == {"c1": ("small_producer", "needs_review"), "c2": ("transporter", "not_determined"), "c3": (None, "needs_review")}
    everything = findings.unionByName(plan).unionByName(checks.claim_findings(checks.exemption_checks(claims, cards.exemptions(spark))))
    queue = checks.exception_queue(everything, "run-1").orderBy("exception_id").collect()
    assert [q.exception_id for q in queue] == [f"exception-{k:04d}" for k in range(1, 5)]
    assert checks.readiness(everything).first().status == "blocked"
    ready = {r.event_id: r.status for r in checks.export_readiness(kde).collect()}
    assert ready["SHIP-1:L1"] == "ready" and ready["REC-1:L2"] == "blocked"


def test_packing_and_paths(spark):
    pieces = spark.createDataFrame([("d", 1, 9), ("d", 2, 3), ("d", 3, 20), ("d", 4, 1)], "doc string, pos int, size int")
    got = relational.pack_parts(pieces, "doc", ["pos"], "size", 15, 2).orderBy("pos").collect()
    assert [r.part for r in got] == [1, 1, 2, 3]
    marks = F.array(*map(F.lit, ["a", "1", "i", "2", "b", "1"]))
    assert spark.range(1).select(relational.marker_paths(marks)).first()[0] == ["a", "a/1", "a/1/i", "a/2", "b", "b/1"]


def test_record_diff_and_scores(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "k string, h string")
    got = {r.k: r.change for r in relational.record_diff(old, new, ["k"], "h").collect()}
    assert got == {"a": "removed", "b": "changed", "c": "unchanged", "d": "added"}
    rows = spark.createDataFrame([(["x"], ["x", "y"]), ([], []), (["y"], [])], "e array<string>, a array<string>")
    scores = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in relational.micro_scores(rows, "e", "a").collect()}
    assert scores == {"x": (1, 0, 0, 1.0, 1.0), "y": (0, 1, 1, 0.0, 0.0)}


def test_numbers_across_ranges(spark):
    from tracemill.operators.relational import numbered_across

    rows = spark.range(12000).select((11999 - F.col("id")).alias("x"), F.lit(1).alias("y"))
    got = {r.x: r.id for r in numbered_across(rows, [F.col("x")], "e-", "id").collect()}
    assert got == {x: f"e-{x + 1:04d}" for x in range(12000)}
    assert numbered_across(rows.limit(0), [F.col("x")], "e-", "id").count() == 0


def test_review_operators(spark):
    from tracemill.operators import review

    columns = "finding_id string, status string, card_id string, chunk_id string, evidence array<string>, review_state string, requirement_id string"
    findings = spark.createDataFrame([("a", "pass", None, None, None, None, None), ("b", None, None, "c", ["e"], "approved", None), ("c", "needs_expert_review", "k", "c", None, None, "")], columns)
    cards_ = spark.createDataFrame([("k", None), ("k", None)], "card_id string, finalized boolean")
    scenarios = spark.createDataFrame([("approved", ["k", "k"])], "status string, card_ids array<string>")
    none = spark.createDataFrame([], "requirement_id string, status string")
    found = {(r.finding_id, r.blocker) for r in review.finding_blockers(findings, cards_, scenarios, none).collect()}
    assert found == {("b", "no approved card"), ("c", "no evidence"), ("c", "no review state"), ("c", "review not approved")}
    drafts = spark.createDataFrame([("a", 0.9, [], "draft"), ("b", 0.9, ["?"], "draft"), ("c", None, None, None)], "draft_id string, confidence double, questions array<string>, review_status string")
    assert {(r.draft_id, r.after_status) for r in review.auto_review(drafts).collect()} == {("a", "approved"), ("b", "needs_review"), ("c", "needs_review")}
    columns = "draft_id string, collection string, record_id string, source_phase string, confidence string, review_status string, citation_count int"
    records = spark.createDataFrame([("a", "x", "1", None, "HIGH", None, None), ("b", "x", "2", "p", "", "needs_review", 2)], columns)
    assert [r.draft_id for r in review.import_drafts(records, only_ready=True).collect()] == ["b"]
    assert {(r.source_phase, r.review_status, r.citation_count) for r in review.import_drafts(records).collect()} == {("unknown", "draft", 0), ("p", "needs_review", 2)}
    with pytest.raises(Exception, match="draft without record_id"):
        review.import_drafts(spark.createDataFrame([("a", "x", " ", None, None, None, None)], columns)).collect()
