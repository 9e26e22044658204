"""Stored rows, profiles, packages, the registry, text functions and single rules on fixtures, with nulls, repeats and empty tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import texts as T
from tracemill.operators import legacy as L
from tracemill.operators import normalized as N
from tracemill.operators import profiles as P
from tracemill.operators import registry_rules as R


def one(spark, *columns, **values):
    kinds = {str: "string", int: "int", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return tuple(df.select(*columns).first())


def test_texts(spark):
    said = "  One. Two  e.g. this.\nThree without an end "
    assert one(spark, T.sentences("t"), t=said)[0] == ["One.", "Two e.g.", "this.", "Three without an end"]
    assert one(spark, T.sentences("t"), T.bullets("t"), T.listed_examples("t", "x"), T.bracketed_examples("t"), T.data_type("t"), T.condition("t"), t=None) == ([], [], [], [], "text", None)
    assert one(spark, T.bullets("t"), t="• a\n b • c • a  b www.fda.gov end")[0] == ["a b", "c"] and one(spark, T.bullets("t"), t="no bullets")[0] == []
    assert one(spark, T.listed_examples("t", "Leafy greens"), t="First. Leafy greens include, but are not limited to, chard, kale [2] and cress. Not others.")[0] == ["chard", "kale", "cress"]
    assert one(spark, T.bracketed_examples("t"), t="Unit (e.g., case or pallet, mm/dd/yyyy) (example: box)")[0] == ["case", "pallet", "box"]
    cell = lambda ref: one(spark, T.evidence_cell("t", {"06_event_lines": "Lines"}), t=ref)[0]
    assert [cell("a-06_Event_Lines-r12-c3"), cell("a-07_x-r1-c2"), cell("a-6_x-r1-c2"), cell(None)] == ["Lines · row 12", "07_x · row 1", None, None]
    put = lambda body, path=("b", "c"): json.loads(one(spark, T.json_set("t", list(path), F.lit('{"x":1}')), t=body)[0])
    assert put('{"a": [1], "b": {"d": null, "c": 2}}') == {"a": [1], "b": {"c": {"x": 1}, "d": None}}
    assert put(None) == put("{broken") == put("[1]") == {"b": {"c": {"x": 1}}} and put('{"b": 7}') == {"b": {"c": {"x": 1}}}


def test_normalized_rows(spark):
    kind = "event_id string, actor_id string, product_id string, lot_or_tlc string, source_lot_or_tlc string, output_lot_or_tlc string, from_partner_id string, to_partner_id string, confidence double, reviewer_questions array<string>, evidence_ids array<string>, form_review boolean, form_reason string, role_confidence double"
    events = spark.createDataFrame(
        [("e1", "a", "p", "L1", "", None, None, "a", 0.9, ["q"], ["x", "y"], True, None, 0.9), ("e2", None, "lost", "L1", "L1", "L2", "c", None, None, None, None, False, None, None), ("e3", "a", "p", "", None, "L3", None, None, 0.5, [], [], None, None, 0.2)], kind
    )
    entities = [("actor", "a", " An  Actor", 0.5, 1), ("actor", "a", "Last", 0.6, 2), ("lot", "L1", "L1", None, 1), ("counterparty", "a", "A", 0.1, 1), ("product", "p", None, 1.0, 1)]
    objects = N.business_objects(spark.createDataFrame(entities, "object_type string, entity_id string, name string, confidence double, ordinal int"), "r")
    assert {(r.object_type, r.normalized_name) for r in objects.collect()} == {("actor", "last"), ("lot", "l1"), ("counterparty", "a"), ("product", "")}
    ids = {(r.object_type, r.object_key): r.id for r in objects.collect()}
    rows = N.event_rows(events, objects, "r")
    by = {r.event_id: r for r in rows.collect()}
    assert by["e1"].actor_object_id == ids["actor", "a"] and by["e1"].to_object_id == ids["counterparty", "a"] and by["e1"].lot_object_id == ids["lot", "L1"]
    assert by["e2"].product_object_id is None and by["e2"].output_lot_object_id is None
    assert {k: r.review_status for k, r in by.items()} == {"e1": "needs_review", "e2": "unreviewed", "e3": "needs_review"}
    links = {r.normalized_event_id: (r.source_tlc, r.output_tlc, r.confidence, r.review_status) for r in N.lot_links(rows, "r").collect()}
    assert links == {by["e1"].id: ("L1", "L1", 0.7, "unreviewed"), by["e2"].id: ("L1", "L2", 0.85, "unreviewed"), by["e3"].id: (None, "L3", 0.65, "needs_review")}
    assert N.evidence_links(rows).count() == 2
    conflicts = spark.createDataFrame([("c1", "lot", "high")], "conflict_id string, field_key string, severity string")
    items = N.review_items(rows, conflicts, "r").collect()
    assert sorted(i.review_type for i in items) == ["actor_role_review", "event_ambiguity", "evidence_conflict", "food_form_review"] and len({i.id for i in items}) == 4
    records = spark.createDataFrame([("r1", 0.2), ("r2", None), ("r3", 0.5)], "evidence_id string, confidence double")
    asked = N.reviewer_questions(events, records).collect()
    assert {(r.event_id, r.question, tuple(r.evidence_ids)) for r in asked} == {("e1", "q", ("x", "y")), (None, N.UNMAPPED, ("r1", "r2"))}
    assert N.reviewer_questions(events, records.filter("confidence = 0.5")).count() == 1
    assert {r.question_id for r in N.numbered_by_event(N.reviewer_questions(events, records), "q").collect()} == {"q-e1-1", "q-columns-1"}
    checks = {(r.event_id, r.check_type, r.reason) for r in N.scope_checks(events, conflicts, "blocked").collect()}
    assert {c for _, c, _ in checks} == {"scope_or_exemption_uncertainty", "evidence_conflicts", "customer_evidence_quality_gate"} and ("e1", "scope_or_exemption_uncertainty", "Food form requires review.") in checks
    assert N.scope_checks(events, conflicts.limit(0), "pass").count() == 1
    ready = lambda c, gate: {r.check_type: r.status for r in N.records_readiness(records, events.limit(0), c, gate).collect()}
    assert list(ready(conflicts, None).values()) == ["needs_review", "needs_review", "missing"] and list(ready(conflicts.limit(0), "pass").values()) == ["present", "present", "missing"]
    values = N.kde_values(spark.createDataFrame([("x", "row", "lot", "Lot", " 1", "1", 0.6), ("y", None, "lot", "Lot", None, None, None)], "evidence_id string, row_key string, field_key string, column_name string, raw_value string, normalized_value string, confidence double"), rows.withColumn("source_row_key", F.lit("row")), "r")
    assert {(r.evidence_item_id, r.review_status, r.normalized_event_id is None) for r in values.collect()} == {("x", "needs_review", False), ("y", "unreviewed", True)}


def test_export_and_messages(spark):
    events = spark.createDataFrame([("e", ["shipping", "receiving"], "Basil", None)], "event_id string, final_ctes array<string>, product_name string, traceability_lot_code string")
    checks = spark.createDataFrame([("e", "shipping", "quantity", ["5", "6"]), ("e", "shipping", "traceability_lot_code", []), ("e", "shipping", "date", None)], "event_id string, cte string, field_key string, observed_values array<string>")
    rows = N.export_rows(events, checks)
    by = {r.cte: (r["values"], r.missing) for r in rows.collect()}
    assert by["shipping"] == ({"product_name": "Basil", "quantity": "5", "traceability_lot_code": None, "date": None}, ["date", "traceability_lot_code"]) and by["receiving"][1] == []
    assert [tuple(r) for r in N.export_blockers(rows).collect()] == [("e", "shipping", "Sortable export blocked by missing fields: date, traceability_lot_code.")]
    told = lambda fields, lot: one(spark, N.gap_message(F.lit("Cooling"), F.array(*map(F.lit, fields)), ["TLC"], F.lit(lot)))[0]
    assert told(["TLC"], True) == "Cooling is missing its Traceability Lot Code (TLC)."
    assert told(["TLC", "date"], True).endswith("and 1 other required field.") and told(["TLC", "date", "x"], True).endswith("and 2 other required fields.")
    assert told(["date"], False) == "Cooling is missing a required field: date." and told(["a", "b"], False) == "Cooling is missing 2 required fields."


def test_profiles(spark):
    kind = "customer string, draft_id int, sheet_pattern string, source_column string, canonical_field string, confidence double, evidence_ids array<string>, review_status string"
    rows = [("c", 2, "S", "B", "b", 0.9, [str(k) for k in range(40)], "approved"), ("c", 1, "S", "Ä", "a", 1.0, None, "approved"), ("c", 3, "S", "C", "c", 0.1, [], "rejected"), ("c", 4, "S", "D", "d", 0.1, [], None), ("empty", 5, "S", "E", "e", 0.1, [], "draft")]
    by = {r.customer: r for r in P.approved_profiles(spark.createDataFrame(rows, kind), ["customer"]).collect()}
    same = {r.customer: r.profile_hash for r in P.approved_profiles(spark.createDataFrame(rows[::-1], kind).repartition(3), ["customer"]).collect()}
    assert {k: r.profile_hash for k, r in by.items()} == same
    assert ([m.mapping_id for m in by["c"].approved], by["c"].pending, by["c"].rejected, by["empty"].approved) == (["approved-0001", "approved-0002"], [4], [3], [])
    mapping = lambda n, k, c, f, sure, ids: {"mapping_id": f"approved-000{n}", "draft_id": k, "source_sheet_pattern": "S", "source_column_pattern": c, "canonical_field": f, "confidence_floor": sure, "evidence_ids": ids}
    payload = {"customer": "c", "version": 1, "approved_mappings": [mapping(1, 1, "Ä", "a", 1.0, None), mapping(2, 2, "B", "b", 0.9, [str(k) for k in range(25)])]}
    assert by["c"].profile_hash == hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
    suggestions = spark.createDataFrame([("S", "A", "a", 0.9, "spreadsheet_header"), ("S", "B", "b", 0.79, "x"), ("S", "none", "n", None, None)], "source_sheet string, source_column string, field_key string, confidence double, method string")
    records = spark.createDataFrame([("S", "A", n, str(n % 13)) for n in range(40, 0, -1)] + [("S", "B", 1, ""), ("S", "B", 2, None)], "source_sheet string, source_column string, ordinal int, normalized_value string")
    drafts = {r.source_column: r for r in P.mapping_drafts(suggestions, records).collect()}
    assert drafts["A"].examples == [str(k) for k in range(1, 11)] and drafts["A"].reviewer_questions == [] and drafts["A"].extraction_method == "deterministic_header_mapping_draft"
    assert drafts["B"].examples == [] and drafts["B"].reviewer_questions == [P.CONFIRM] == drafts["none"].reviewer_questions


def test_packages(spark):
    drafts = spark.createDataFrame([("a", "obligations", "HIGH", "complete"), ("b", "obligations", "HIGH", None), ("c", "tlc", "LOW", "complete")], "draft_id string, collection string, confidence string, citation_status string")
    issues = spark.createDataFrame([("c", "conflict_detected"), ("c", "unsupported_claim"), ("a2", "x")], "draft_id string, code string")
    package = P.review_package(drafts.filter("draft_id < 'c'"), drafts.filter("draft_id = 'c'"), issues)
    assert {r.draft_id: (r.review_status, r.blockers, r.source_phase) for r in package.collect()} == {
        "a": ("needs_review", [], "deterministic"), "b": ("rejected", ["citation_coverage_failed"], "deterministic"), "c": ("conflict_detected", ["unsupported_claim"], "assisted"),
    }
    assert sorted((r.draft_id, r.step, r.action) for r in P.review_log(package).collect()) == [("a", 1, "draft_ingested"), ("b", 1, "draft_ingested"), ("b", 2, "validation_rejected"), ("c", 1, "draft_ingested"), ("c", 2, "conflict_detected")]
    sources, chunks = spark.createDataFrame([("s", "")], "source_id string, title string"), spark.createDataFrame([("k", "", "text"), ("h", "given", None)], "chunk_id string, text_hash string, text string")
    cited = lambda *rows: P.source_versions(spark.createDataFrame(rows, "source_id string, chunk_id string"), sources, chunks)
    assert {tuple(r) for r in cited(("s", "k"), ("s", "k"), ("s", "h")).collect()} == {("s", "s", 2, "k", hashlib.sha256(b"text").hexdigest()), ("s", "s", 2, "h", "given")}
    with pytest.raises(Exception, match="missing chunk: lost"):
        cited(("s", "lost")).collect()
    areas = P.area_coverage(spark.createDataFrame([("shipping", None), ("odd", "cooling")], "rule_area string, cte_type string"), spark.createDataFrame([("late_shipping_gap",), (None,)], "finding_type string"))
    assert {(r.area, r.status, r.reason) for r in areas.filter("area in ('shipping', 'cooling', 'harvest')").collect()} == {("shipping", "ready", "Evaluated with findings."), ("cooling", "ready", "Evaluated or not applicable."), ("harvest", "blocked", "Missing rule card.")}


def test_registry(spark):
    rank = lambda s, t: one(spark, R.authority(F.col("s"), F.col("t")), s=s, t=t)[0]
    assert [rank("cfr-x", None), rank("fr-2023-technical-amendment", "guidance"), rank("x", "guidance"), rank("x", "odd"), rank("x", None)] == ["codified_rule", "federal_register_notice", "guidance", "support", "support"]
    body = lambda **k: json.dumps(k)
    rows = R.chunk_records(spark.createDataFrame([("s", body(chunkId="k", sectionLabel="L", anchors=[{"pageNumber": "7", "citation": "c"}])), ("s", body(chunk_id="j", section="x", citation="y", text="t")), ("s", "{broken"), ("s", None)], "source_id string, body string")).collect()
    by = {r.chunk_id: r for r in rows}
    assert (by["k"].page_number, by["k"].citation_anchor, by["k"].section_ref) == (7, "c", "document") and (by["j"].section_label, by["j"].citation_anchor, by["j"].section_ref) == ("x", "y", "x")
    assert len(by) == 4 and all(r.text_hash.startswith("sha256:") for r in rows)
    wrong = lambda kind, step, bad: one(spark, *R.event_labels(F.lit(kind), F.lit(step), F.lit(bad)))
    assert wrong("TransformationEvent", "departing", None) == (["shipping", "transformation"], []) and wrong("x", "shipping", True) == ([], ["shipping"]) and wrong(None, None, False) == ([], [])
    said = lambda url, content: one(spark, R.parser_for(F.lit(url), F.lit(None).cast("string"), F.lit(content).cast("binary")))[0]
    assert [said("a.pdf?x=1", ""), said("a", "PKx"), said(None, '<DIV8 TYPE="SECTION">'), said(None, None)] == ["pdf", "xlsx", "ecfr_xml", "html"]


def test_single_rules(spark):
    lines = spark.createDataFrame([("l1", "e1", None, "", None), ("l2", "e1", "x", "a", "b"), ("l3", "e2", None, "a", "b")], "line_id string, event_id string, lot string, source_lot string, output_lot string")
    events = spark.createDataFrame([("e2", "transformation")], "event_id string, event_type string")
    lineage = spark.createDataFrame([("g", "gap", "a"), ("h", "conflicting", "a"), ("i", "complete", "a"), ("j", None, None)], "lineage_id string, status string, source_lot string")
    assert {(r.finding_type, r.subject, r.status) for r in L.lot_findings(lines, events, lineage).collect()} == {("tlc_assignment_gap", "l1", "gap"), ("tlc_preservation_conflict", "l2", "conflict"), ("lineage_gap", "g", "gap"), ("lineage_gap", "h", "conflict")}
    claims = spark.createDataFrame([(1, "kill step", None), (2, "x", True)], "claim_id int, claim_type string, evidence_provided boolean")
    assert [(r.subject, r.title) for r in L.exemption_findings(claims).collect()] == [("1", "Exemption claim needs evidence: kill step")]
    summary = L.summary_rows(spark.createDataFrame([(1, "f", True), (2, "g", None)], "audit_id int, file_name string, passed boolean"), spark.createDataFrame([(1, "gap"), (1, "gap")], "audit_id int, status string"))
    assert {(r.audit_id, r.metric, r.value) for r in summary.collect()} >= {(1, "readiness_gate", "passed"), (2, "readiness_gate", "blocked"), (1, "findings", "2"), (2, "findings", "0"), (1, "findings_gap", "2")}
