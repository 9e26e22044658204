"""Extraction and read-side operators on fixtures, with nulls, empty texts and broken input."""

import json

import pytest

from tracemill.operators import extract, markup, readside


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_terms(spark):
    text = "Cooling means  active reduction. Harvesting applies to farms [2].\nPerson includes an individual ."
    chunks = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing here")], "chunk_id int, text string")
    found = extract.defined_terms(chunks, {"Person": "Person includes", "Harvesting": "Harvesting applies", "Cooling": "Cooling means", "Farm": "Farm means"})
    assert rows(found, "chunk_id", "term_id", "definition") == [
        (1, "term_cooling", "active reduction."), (1, "term_harvesting", "to farms [2]."), (1, "term_person", "an individual."),
    ]


def test_list_items(spark):
    text = "Intro. Melons Includes all fresh melons. Examples include, but are not limited to, cantaloupe[1] and honeydew. Does not include watermelons. Herbs (fresh)"
    (melons, herbs) = extract.list_items(spark.createDataFrame([(text,)], "text string"), ["Herbs (fresh)", "Melons", "Nuts"]).orderBy("item_id", ascending=False).collect()
    assert (melons.item_id, melons.description) == ("ftl_melons", "Includes all fresh melons.")
    assert (melons.examples, melons.exclusions, melons.notes) == (["cantaloupe", "honeydew"], ["Does not include watermelons."], ["Melons Includes all fresh melons."])
    assert (herbs.item_id, herbs.description, herbs.examples) == ("ftl_herbs_fresh", "Herbs (fresh)", [])


def test_bullets(spark):
    text = "Page • Location description for the place. • Location description for the place. • short • Quantity and unit  of measure www.fda.gov 3"
    found = extract.bullet_candidates(spark.createDataFrame([(2, text), (99, text), (3, None)], "page_number int, text string"), {2: "harvesting", 3: "cooling"})
    assert rows(found, "position", "kde_id") == [(1, "kde_harvesting_01_location_description_for_the_place"), (3, "kde_harvesting_03_quantity_and_unit_of_measure")]


def test_missing_chunks_are_errors(spark):
    specs = spark.createDataFrame([("a", 1), ("b", 2)], "spec string, section int")
    chunks = spark.createDataFrame([(1, 7, "text")], "section int, chunk_id int, text string")
    with pytest.raises(Exception, match="missing chunk: 2"):
        extract.cited_specs(specs, chunks, ["section"]).collect()
    assert rows(extract.cited_specs(specs.filter("section = 1"), chunks, ["section"]), "spec", "chunk_id") == [("a", 7)]


def test_sections_and_rows(spark):
    html = "<p>before<h1 class=x>21 CFR 1.1340 Shipping</h1><p>one <b>bold</b></p><ul><li>two</ul><h4>no</h4><h2>Other</h2><div>three<span>four</span></div><script>x</script>"
    pages = spark.createDataFrame([(1, html), (2, "bare"), (3, None)], "page_id long, html string")
    assert rows(markup.html_sections(pages), "page_id", "ordinal", "section_label", "section", "text") == [
        (1, 1, "Document", "Document", "before"), (1, 2, "21 CFR 1.1340 Shipping", "21 CFR 1.1340", "one two"), (1, 3, "Other", "Other", "three four"),
        (2, 1, "Document", "document", "bare"), (3, 1, "Document", "document", ""),
    ]
    listing = "<table><tr><th>Rule<th>Docket<tr><td>Trace <i>rule</i> <a href=/a>x</a><td>FDA-2014-N-0053</table>"
    assert markup.rules_rows(spark.createDataFrame([(1, listing), (2, None)], "page_id long, html string")).collect()[0][:] == (1, 2, "Trace rule x", "FDA-2014-N-0053", ["/a"])


def test_nested_events(spark):
    event = {"type": "ObjectEvent", "eventID": "e1", "x": [{"type": "ObjectEvent"}]}
    lines = spark.createDataFrame([(json.dumps([{"deep": {"list": [event]}}]),), (json.dumps(event),), ("{broken",), (None,), ("[]",)], "content string")
    found = extract.visibility_events(lines, ("ObjectEvent",)).collect()
    assert len(found) == 2 and {r.event_id for r in found} >= {"e1"} and all(len(r.event_id) in (2, 64) for r in found)


def test_events_of_xml(spark):
    inner = "<AggregationEvent><eventID>in</eventID></AggregationEvent>"
    xml = f"<d xmlns:e='urn:e'><e:ObjectEvent><eventID>out</eventID><bizStep>urn:epcglobal:cbv:bizstep:shipping</bizStep><l><a> x </a>{inner}</l></e:ObjectEvent><Other/></d>"
    lines = spark.createDataFrame([("\ufeff<?xml version='1.0' encoding='latin-1'?>" + xml,), (xml + "<",), ("<d>" * 3000 + "<ObjectEvent/>" + "</d>" * 3000,), (None,), ("",)], "content string")
    found = sorted(tuple(r) for r in extract.visibility_events(lines, ("ObjectEvent", "AggregationEvent")).collect())
    assert [(i, k, s, json.loads(b).get("l")) for i, k, s, b in found if len(i) < 64] == [("in", "AggregationEvent", "", None), ("out", "ObjectEvent", "shipping", "x in")]
    assert [(k, json.loads(b)) for i, k, _, b in found if len(i) == 64] == [("ObjectEvent", {"type": "ObjectEvent"})]
    line = json.dumps({"epcisBody": {"eventList": [{"@type": "epcis:ObjectEvent", "id": "j", "bizStep": "shipping"}]}})
    assert extract.nested_events(line, ("ObjectEvent",))[0][:3] == ("j", "ObjectEvent", "shipping")


def test_short_xml_needs_no_stream(monkeypatch):
    """Short texts are read as a tree, long ones as a stream, with the same events; to set up a stream for each short text took most of the time."""
    deep = "<ObjectEvent><eventID>o</eventID><l> a <m>b</m><AggregationEvent><eventID>i</eventID><x/></AggregationEvent></l> tail</ObjectEvent>"
    texts = [f"<d xmlns:e='urn:e'><e:ObjectEvent/>{deep}<o>{deep}</o><!-- c --></d>", f"<d>{deep}</wrong>", deep, "<" + "d" * 50, "<d>\ud800</d>", "<d>" * 3000 + deep + "</d>" * 3000]
    kinds = ("ObjectEvent", "AggregationEvent")
    streamed = []
    with monkeypatch.context() as m:
        m.setattr(extract, "WHOLE_XML", -1)
        streamed = [sorted(map(str, extract.nested_events(t, kinds))) for t in texts]
    assert [len(x) for x in streamed] == [5, 0, 2, 0, 0, 2]
    monkeypatch.setattr(extract.ElementTree, "iterparse", None)
    assert [sorted(map(str, extract.nested_events(t, kinds))) for t in texts] == streamed


def test_read_side(spark):
    runs = spark.createDataFrame(
        [("r1", "succeeded", None, "p", "e"), ("r2", "succeeded", "blocked", None, None), ("r3", "failed", None, None, None), ("r4", "queued", None, None, None)],
        "run_id string, status string, readiness string, parser_version string, execution_version string",
    )
    findings = spark.createDataFrame([("r1", "f1", "pass"), ("r1", "f2", "open")], "run_id string, finding_id string, status string")
    assert rows(readside.blockers(runs, findings), "run_id", "blocker") == [("r1", "f2"), ("r2", "readiness status: blocked"), ("r3", "audit run failed"), ("r4", "audit run is queued")]
    assert rows(readside.coverage(runs, findings).filter("run_id in ('r1', 'r4')"), "run_id", "area", "status") == [
        ("r1", "Findings", "review"), ("r1", "Parser", "ready"), ("r1", "Rule execution", "ready"), ("r4", "Findings", "pending"), ("r4", "Parser", "queued"), ("r4", "Rule execution", "queued"),
    ]
    titled = spark.createDataFrame([("r1", "f2", "low", "b"), ("r1", "f1", "critical", "a")], "run_id string, finding_id string, severity string, title string")
    report = readside.report_lines(readside.readiness(runs), titled).filter("run_id = 'r1'")
    assert [r.line for r in report.orderBy("line_number").collect()] == ["# Audit r1", "Status: ready", "- [critical] a", "- [low] b"]


def test_sections_survive_odd_markup(spark):
    cases = {
        "<h1>A</h1><p>one<br>two<img>three</p><p>four</p>": [("A", "A", "one two three four")],
        "<h1>A<p>inside the heading</h1></p><p>one": [("A inside the heading", "A inside the heading", "one")],
        "<p>x</span></div>y<h2></h2><p>z": [("Document", "Document", "x y"), ("Document", "Document", "z")],
        "<ul><li>a<ul><li>b</ul>c<li>d</ul>": [("Document", "Document", "a b c d")],
        "<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table>e</table>f": [("Document", "Document", "a b c d e")],
        "<script>x</script>bare <b>text</b>": [("Document", "document", "bare text")],
        "<div>" * 5000 + "deep": [("Document", "Document", "deep")],
        "<h3>21 cfr 1.1455</h3><p>see 1.1340": [("21 cfr 1.1455", "21 cfr 1.1455", "see 1.1340")],
    }
    for html, want in cases.items():
        assert markup.sections_of(html) == want, html
    assert markup.rows_of("<table><tr><td>a <a href=/x>b</a><table><tr><td>c</table>d<td>e</table><tr><td>stray") == [(["a b d", "e"], ["/x"]), (["c"], []), (["stray"], [])]
