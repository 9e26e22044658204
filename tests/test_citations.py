"""Chunks, spans and subparagraphs on fixtures, with nulls, blanks, ties and ambiguous markers."""

import pytest

from tracemill.operators import citations as C

SECTIONS = "source_id string, source_hash string, ordinal int, section_label string, section string, paragraph string, table_label string, text string"


def chunks_of(spark, *rows):
    return C.legal_chunks(spark.createDataFrame(rows, SECTIONS))


def test_chunks_and_rejections(spark):
    judged = chunks_of(
        spark,
        ("src-ecfr", "abc", 1, "Shipping KDEs", "21 CFR 1.1340", None, None, "  Shipping records must maintain TLC and immediate subsequent recipient KDEs. "),
        ("src", "abc", 1, "Bad", "x", None, None, "When food is shipped."),
        ("src", "abc", 2, "Good", "y", "(a)", "", "Shipping records must maintain TLC."),
        ("src", "abc", 3, "", None, None, "Table 1", "if " + "long condition " * 10),
        ("src", None, 4, None, "", None, None, " \n "),
        ("src", None, 5, None, None, None, None, None),
    )
    by = {(r.source_id, r.ordinal): r for r in judged.collect()}
    first = by["src-ecfr", 1]
    assert (first.side, first.chunk_id, first.citation, first.section) == ("chunk", "src-ecfr-21-cfr-1-1340-1", "21 CFR 1.1340", "21 CFR 1.1340")
    bad = by["src", 1]
    assert (bad.side, bad.reason, bad.section_label, bad.chunk_id) == ("rejected", C.REJECTED, "Bad", None)
    assert by["src", 2].citation == "y (a)" and by["src", 2].text_hash.startswith("sha256:")
    assert (by["src", 3].section, by["src", 3].section_label, by["src", 3].citation, len(by["src", 3].summary)) == ("document", "document", "document Table 1", 152)
    assert by["src", 4].side == by["src", 5].side == "blank"
    assert {tuple(r) for r in C.chunk_counts(judged).collect()} == {("src-ecfr", 1, 1, 0, 0), ("src", 5, 2, 1, 2)}


def paths(spark, text):
    return [r.path for r in C.paragraphs(spark.createDataFrame([(1, text)], "chunk_id int, text string")).orderBy("ordinal").collect()]


def test_paragraphs(spark):
    text = "(c) Record availability. (3) When necessary. (ii) You must provide an electronic sortable spreadsheet."
    rows = C.paragraphs(spark.createDataFrame([(1, text)], "chunk_id int, text string")).orderBy("ordinal").collect()
    assert [(r.path, r.level) for r in rows] == [("(c)", 1), ("(c)(3)", 2), ("(c)(3)(ii)", 3)]
    assert all(text[r.start :].startswith(r.text) for r in rows)
    assert paths(spark, "before (a) x (1) y (i) z (A) q (B) r (ii) s (2) t (b) u") == ["(a)", "(a)(1)", "(a)(1)(i)", "(a)(1)(i)(A)", "(a)(1)(i)(B)", "(a)(1)(ii)", "(a)(2)", "(b)"]
    assert paths(spark, "(h) eight (i) nine (j) ten") == ["(h)", "(i)", "(j)"]  # letters go on
    assert paths(spark, "(h) eight (1) one (i) numeral (v) five") == ["(h)", "(h)(1)", "(h)(1)(i)", "(h)(1)(v)"]
    assert paths(spark, "(u) a (v) b (w) c (x) d (y) e") == ["(u)", "(v)", "(w)", "(x)", "(y)"]
    assert paths(spark, "(a) a (i) numeral under a letter") == ["(a)", "(a)(i)"]
    assert paths(spark, "(2) a number alone (A) capital (1) again") == ["(2)", "(2)(A)", "(1)"]
    assert paths(spark, "no markers (or none) at all ( a )") == ["(none)"] or paths(spark, "no markers at all") == [""]
    assert paths(spark, "plain") == [""] and paths(spark, "  ") == paths(spark, None) == []


def resolved(spark, cited, targets=()):
    text = "(a) Harvesters keep the location description of the farm. (b) Coolers keep the cooling location description. (c) Other (1) the date of harvesting and cooling."
    chunks = spark.createDataFrame([("k", "src", "21 CFR 1.1325", text)], "chunk_id string, source_id string, citation_anchor string, text string")
    obligations = spark.createDataFrame(
        [("harvest", "keep", "location description", None, "farm", None), ("both", "keep", "location description", "", None, None), ("none", "launch satellites", None, None, None, None)],
        "obligation_id string, action string, object string, required_output string, condition string, noncompliance_risk string",
    )
    cited = spark.createDataFrame(cited, "obligation_id string, citation_no int, source_id string, chunk_id string, citation_anchor string, section_ref string, support_text string")
    targets = spark.createDataFrame(list(targets), "obligation_id string, target_anchors array<string>, review_status string")
    return C.resolve_subparagraphs(cited, obligations, chunks, targets, "targets-v1")


def test_subparagraphs_inferred_with_ties(spark):
    section = "21 CFR 1.1325"
    got = resolved(
        spark,
        [("harvest", 1, "src", "k", section, section, "the  farm."), ("both", 1, "src", "k", None, "", "keep the cooling"), ("none", 1, "src", "k", section, section, None), ("none", 2, "src", "lost", section, section, "x")],
    )
    by = {(r.obligation_id, r.citation_no): r for r in got.collect()}
    assert (by["harvest", 1].resolved_subparagraph_anchors, by["harvest", 1].section_level_status, by["harvest", 1].candidate_count) == ([section + "(a)"], "valid_normalized", 4)
    assert by["both", 1].resolved_subparagraph_anchors == ["(a)", "(b)"] and by["both", 1].section_level_status == "valid"  # no section named: bare paths, both tie
    assert (by["none", 1].resolution_status, by["none", 1].section_level_status, by["none", 1].notes) == ("section_only", "partial", [C.ADDITIVE, C.NO_TARGET])
    assert (by["none", 2].section_level_remains_valid, by["none", 2].candidate_count) == (False, 0)
    assert C.resolution_summary(got).first().asDict() == {"citations": 4, "resolved": 2, "section_only": 2, "unresolved": 0, "invalid_sections": 1, "status": "review_required"}


def test_approved_targets_come_first(spark):
    section = "21 CFR 1.1325"
    cited = [("harvest", 1, "src", "k", section, section, "keep"), ("both", 1, "other", "k", section, section, "keep")]
    got = resolved(spark, cited, [("harvest", [section + "(c)(1)", section], "approved"), ("both", [section + "(z)"], "approved"), ("harvest", ["draft"], "draft")])
    by = {r.obligation_id: r for r in got.collect()}
    assert by["harvest"].resolved_subparagraph_anchors == [section + "(c)(1)", section] and by["harvest"].method == "approved_target_artifact:targets-v1"
    assert (by["both"].resolution_status, by["both"].unresolved_targets, by["both"].section_level_status) == ("unresolved", [section + "(z)"], "invalid")
    with pytest.raises(Exception, match="two approved targets: both"):
        resolved(spark, cited, [("both", ["a"], "approved"), ("both", ["b"], "approved")]).collect()
