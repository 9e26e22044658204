"""Phrases, routing, evaluation and drift on fixtures; the automaton against plain substring tests."""

import random

from pyspark.sql import functions as F

from tracemill.operators import evaluation as E
from tracemill.operators import phrases as P


def test_automaton_against_substrings():
    rnd = random.Random(7)
    every = [p for phrases, _ in P.groups().values() for p in phrases]
    texts = ["", None, "RMA", "an rma note", "lot", "a lot of", "TLC", " tlc", "manufactured, packed"]
    texts += ["".join(rnd.choice([p, p.upper(), p[:-1], " ", "x"]) for p in rnd.sample(every, 4)) for _ in range(300)]
    for text in texts:
        low = (text or "").lower()
        want = sorted(n for n, (phrases, ends) in P.groups().items() if any(p in (f" {low} " if ends else low) for p in phrases))
        assert P.found_groups(text) == want, text


def routed(spark, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "record_id int, observed_text string, expected_ctes array<string>, expected_abstentions array<string>")
    return {r.record_id: r for r in P.judge_routing(P.route(df, abstain="expected_abstentions")).collect()}


def test_routing(spark):
    got = routed(
        spark,
        ("ObjectEvent bizStep shipping, outbound to retail customer, quantity 5", ["shipping"], []),  # strong, several families
        ("Shipped yesterday", ["shipping"], []),  # weak and alone: verified, one family
        ("Incoming delivery note", ["receiving"], []),  # weak shipping, but incoming speaks against it
        ("Recipe transforms input lot A into a new finished product", ["transformation"], []),
        ("Product metadata: harvested pack", [], []),  # metadata alone
        ("Carrier manifest, outbound", [], ["shipping"]),
        ("Crew in the field cut one lot", ["harvesting"], []),
        ("Outbound bill of lading", [], ["shipping"]),  # known to be abstained from
        (None, ["cooling"], None),
    )
    by = lambda k: (got[k].auto_approved_ctes, got[k].review_routed_ctes, got[k].abstained_ctes, got[k].status)
    assert by(0) == (["shipping"], [], [], "pass")
    assert dict((e["cte"], e["families"]) for e in got[0].signals)["shipping"] == ["action_semantics", "document_type", "from_to_movement", "product_quantity"]
    assert by(1) == ([], ["shipping"], [], "review_routed")
    assert by(2) == ([], ["receiving", "shipping"], [], "review_routed")
    assert by(3)[0] == ["transformation"]
    assert by(4) == ([], [], [], "pass") and by(5) == ([], [], ["shipping"], "pass")
    assert by(6) == ([], ["harvesting"], [], "review_routed")
    assert by(7) == ([], ["shipping"], ["shipping"], "review_routed")
    assert by(8) == ([], [], [], "fail") and got[8].errors == ["missed_candidate"]


def test_inferred_types(spark):
    texts = ["Harvests, cools and ships it to a distribution center", "A traceability plan for fresh-cut melon", "crates packed there for the first time", "land at the dock", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.c for r in df.select("k", P.infer_ctes(F.col("t")).alias("c")).orderBy("k").collect()] == [
        ["harvesting", "cooling", "shipping"], ["traceability_plan", "transformation"], ["initial_packing"], ["first_land_based_receiving"], [], [],
    ]


def test_errors_and_scores(spark):
    cases = spark.createDataFrame(
        [("a", "harvested", ["harvesting"], []), ("a", "harvested", ["harvesting", "cooling", "cooling"], []), ("a", "rejected", [], ["shipping"]), ("b", "received", [], ["shipping"]), ("b", "3pl", ["receiving"], None), ("b", None, None, None)],
        "source string, observed_text string, expected_ctes array<string>, expected_abstentions array<string>",
    )
    seen = []

    def predict(text):
        seen.append(str(text))
        return P.verified_ctes(P.evidence_groups(text), text, origin_counts=False)

    results = E.evaluate(cases, predict)
    assert len(seen) == 1 and "observed_text" in seen[0]  # the text is all that a predictor gets
    assert sorted((r.source, r.errors) for r in results.collect()) == [
        ("a", []), ("a", []), ("a", ["missed_cte"]), ("b", []), ("b", ["missed_cte", "unexpected_abstention"]), ("b", ["over_triggered_cte", "missing_abstention"]),
    ]
    by = {r.source: r.asDict() for r in E.scores(results, ["source"]).collect()}
    assert (by["a"]["record_count"], by["a"]["exact_match_rate"], by["a"]["precision"], by["a"]["recall"], by["a"]["abstention_recall"]) == (3, 0.6667, 1.0, 0.6667, 1.0)
    assert (by["b"]["tp"], by["b"]["fp"], by["b"]["fn"], by["b"]["false_positive_rate"], by["b"]["abstention_rate"], by["b"]["abstention_recall"]) == (0, 1, 1, 1.0, 0.3333, 0.0)
    assert {(r.cte, r.tp, r.fp, r.fn) for r in E.scores_by_label(results, []).collect()} == {("harvesting", 2, 0, 0), ("cooling", 0, 0, 1), ("receiving", 0, 1, 1)}
    assert {tuple(r) for r in E.error_counts(results, ["source"]).collect()} == {("a", "missed_cte", 1), ("b", "missed_cte", 1), ("b", "unexpected_abstention", 1), ("b", "over_triggered_cte", 1), ("b", "missing_abstention", 1)}
    total = E.scores(results.filter("false"), []).first()
    assert (total.record_count, total.tp, total.precision, total.exact_match_rate) == (0, 0, 1.0, 0.0)


def test_drift_and_gate(spark):
    kind = "input string, measure string, value double, hash string"
    before = spark.createDataFrame([("p", "hash", None, "x"), ("p", "n", 100.0, None), ("q", "n", 100.0, None), ("q", "m", 5.0, None), ("gone", "n", 1.0, None), ("z", "odd", 1.0, None)], kind)
    now = spark.createDataFrame([("p", "hash", None, "y"), ("p", "n", 104.0, None), ("q", "n", 106.0, None), ("q", "m", 5.0, None), ("new", "n", 1.0, None), ("z", "odd", 2.0, None)], kind)
    rules = spark.createDataFrame([("hash", "hash", None, ["benchmark", "unseen"]), ("n", "relative", 0.05, ["unseen"]), ("m", "absolute", 0.0, ["m"])], "measure string, kind string, most double, suites array<string>")
    found = E.drift(now, before, rules)
    assert {(r.input, r.measure): (r.change, r.alert, r.rerun) for r in found.collect()} == {
        ("p", "hash"): ("drifted", True, ["benchmark", "unseen"]), ("p", "n"): ("within", False, []), ("q", "n"): ("drifted", True, ["unseen"]), ("q", "m"): ("stable", False, []),
        ("gone", "n"): ("removed", True, ["unseen"]), ("new", "n"): ("created", True, ["unseen"]), ("z", "odd"): ("drifted", True, []),
    }
    results = spark.createDataFrame([("pass",), ("pass",)], "status string")
    gate = E.publication_gate(found, results, approved=True).first()
    assert (gate.status, gate.alerts, gate.rerun, gate.publication_gate) == ("stable", 5, ["benchmark", "unseen"], "blocked")
    calm = E.drift(now, now, rules)
    assert E.publication_gate(calm, results, approved=True).first().publication_gate == "pass"
    assert E.publication_gate(calm, results, approved=False).first().publication_gate == "blocked"
    assert E.publication_gate(calm, results.unionByName(spark.createDataFrame([("fail",)], "status string")), approved=True).first().status == "needs_review"


def test_templates(spark):
    contexts = spark.createDataFrame([(0, "basil", None), (3, "{lot}", "L1")], "n long, food string, lot string")
    templates = [{"text": "ship {food} of {lot}", "expected_ctes": ["shipping"]}, {"text": "{food} rejected, {food}", "expected_abstentions": ["shipping"]}]
    rows = E.expand_templates(contexts, templates, "n", ["lot", "food"])
    assert sorted((r.case_id, r.observed_text, r.expected_ctes, r.expected_abstentions) for r in rows.collect()) == [
        (1, "ship basil of ", ["shipping"], []), (2, "basil rejected, basil", [], ["shipping"]), (7, "ship {lot} of L1", ["shipping"], []), (8, "{lot} rejected, {lot}", [], ["shipping"]),
    ]
