"""Draft gates and grounding on fixtures: each gate, conflicts, nulls."""

from tracemill.operators import drafts as D

TEXT = "You must assign a traceability lot code when you do any of the following: Initially pack a raw agricultural commodity; perform the first land-based receiving of a food."
FIELDS = {"subject": "You", "condition": "when you do any of the following", "action": "assign", "object": "traceability lot code", "required_output": "traceability lot code", "applies_to_ctes": "initial_packing"}


def gated(spark, drafts, cited=None):
    columns = "record_id string, collection string, fields map<string,string>, extraction_method string, review_status string, confidence string"
    rows = [(k, c, f, *(more or ("ai_assisted", "draft", "medium"))) for k, c, f, *more in ((*d[:3], *d[3:]) for d in drafts)]
    cited = {k: [("src", "k", "1.1320", "You must assign a  traceability lot code")] for k, *_ in drafts} if cited is None else cited
    citations = [(k, n, *c) for k, cs in cited.items() for n, c in enumerate(cs, 1)]
    chunks = spark.createDataFrame([("k", "src", "1.1320", TEXT)], "chunk_id string, source_id string, citation_anchor string, text string")
    known = {"obligations": [*D.CLAIMS["obligations"], "applies_to_ctes"], "tlc_rules": [*D.CLAIMS["tlc_rules"], "rule_kind", "applies_to_food_scope", "applies_to_ctes"]}
    schemas = spark.createDataFrame([(c, f, f in ("subject", "rule_kind")) for c, fs in known.items() for f in fs], "collection string, field string, required boolean")
    found = D.gate_drafts(
        spark.createDataFrame(rows, columns), spark.createDataFrame(citations, "record_id string, citation_no int, source_id string, chunk_id string, citation_anchor string, support_text string"), chunks, schemas
    )
    return {r.record_id: r for r in found.collect()}


def codes(row):
    return [i["code"] for i in row.issues]


def test_gates(spark):
    good = ("src", "k", "1.1320", "You must assign a traceability lot code")
    got = gated(
        spark,
        [
            ("good", "obligations", FIELDS),
            ("unsupported", "obligations", FIELDS | {"action": "launch a blockchain satellite"}),
            ("by hand", "obligations", FIELDS | {"subject": "you "}, "deterministic", "approved", None),
            ("uncited", "obligations", FIELDS | {"deadline": None}),
            ("partial", "obligations", FIELDS),
            ("short", "obligations", {k: v for k, v in FIELDS.items() if k != "subject"}),
            ("strange", "obligations", FIELDS | {"extra": "x"}, None, None, None),
            ("null", "obligations", None),
            ("elsewhere", "opinions", FIELDS),
        ],
        {k: [good] for k in ("good", "unsupported", "by hand", "short", "strange", "elsewhere")} | {"partial": [good, ("src", "k", None, None)], "null": []},
    )
    assert got["good"].outcome == "accepted" and got["good"].review_status == "draft" and got["good"].confidence == "medium"
    assert [(i["code"], i["fields"]) for i in got["unsupported"].issues] == [("unsupported_claim", ["action"])]
    assert (got["unsupported"].outcome, got["unsupported"].review_status, got["unsupported"].confidence) == ("rejected", "rejected", "unsupported")
    assert codes(got["by hand"]) == ["not_ai_assisted", "ai_attempted_approval"]
    assert codes(got["uncited"]) == ["citation_coverage_failed", "unsupported_claim"]
    assert codes(got["partial"]) == ["citation_coverage_failed"]
    assert [(i["code"], i["fields"]) for i in got["short"].issues] == [("schema_validation_failed", ["subject"])] and got["short"].review_status == "draft"
    assert got["strange"].issues[0]["fields"] == ["extra"] and got["elsewhere"].issues[0]["fields"] == ["opinions"] and codes(got["null"]) == ["schema_validation_failed"]


def test_conflicts(spark):
    base = {"rule_kind": "assignment", "applies_to_food_scope": "foods on the  list", "applies_to_ctes": "initial_packing, cooling"}
    rule = lambda text, **more: base | {"assignment_rule": text} | more
    got = gated(
        spark,
        [
            ("a", "tlc_rules", rule("Initially pack a raw agricultural commodity")),
            ("b", "tlc_rules", rule("perform the first land-based receiving of a food", applies_to_ctes="cooling,initial_packing")),
            ("c", "tlc_rules", rule("Initially pack a raw agricultural commodity", rule_kind="other")),
            ("d", "tlc_rules", rule("initially  PACK a raw agricultural commodity", rule_kind="other")),
            ("e", "tlc_rules", rule("launch blockchain satellites today", rule_kind="other")),
        ],
    )
    assert {k: r.outcome for k, r in got.items()} == {"a": "conflict", "b": "conflict", "c": "accepted", "d": "accepted", "e": "rejected"}
    assert codes(got["a"]) == ["conflict_detected"] and (got["b"].confidence, got["b"].review_status) == ("conflict", "conflict_detected")


def test_grounding(spark):
    rows = [
        (1, "Keep the shipping records", "see 1.1340", "21 CFR 1.1340", "shipping records must be kept"),
        (2, "Keep them", "as 1.1345 and 1.1330 say", "21 CFR 1.1340", "records"),
        (3, "Do something else", None, "21 CFR 1.1340", "records must be kept"),
        (4, "Anything", None, None, None),
    ]
    found = D.grounding(spark.createDataFrame(rows, "id int, plain string, why string, section_ref string, support_text string"))
    assert [(r.stray, r.problem) for r in found.orderBy("id").collect()] == [([], None), (["1.1330", "1.1345"], "uncited_section"), ([], "not_grounded"), ([], None)]
