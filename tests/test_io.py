"""Readers, sinks and streams on small files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tracemill.operators import evidence, ontology
from tracemill.operators import jobs as jobs_of
from tracemill.sources import readers, sinks
from tracemill.streaming import jobs


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Product,Lot #\n"Fresh\nBasil",tlc 9\n,\n'.encode())
    rows = {r.row_number: r.cells for r in readers.read_evidence(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {1: ["Product", "Lot #"], 2: ["Fresh\nBasil", "tlc 9"], 3: [None, None]}
    found = evidence.evidence_records(readers.read_evidence(spark, str(tmp_path / "a.csv")))
    assert {(r.field_key, r.normalized_value) for r in found.collect()} == {("product_name", "Fresh Basil"), ("traceability_lot_code", "TLC9")}


def make_book(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    sheet = (
        f'<worksheet {main}><cols><col min="3" max="3" hidden="1"/></cols><sheetData>'
        f'<row r="1">{cell("A1", "Title")}</row><row r="2">{cell("A2", "Lot #")}{cell("B2", "Quantity")}{cell("C2", "Secret")}</row>'
        f'<row r="3" hidden="1">{cell("A3", "no")}</row><row r="4">{cell("A4", "tlc-777")}<c r="B4"><f>2+3</f></c>{cell("C4", "x")}</row>'
        '</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    )
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbook(spark, tmp_path):
    make_book(tmp_path / "b.xlsx")
    rows = [(r.sheet, r.row_number, r.cells) for r in readers.read_evidence(spark, str(tmp_path / "b.xlsx")).collect()]
    assert rows == [("S1", 1, ["Title", "Title"]), ("S1", 2, ["Lot #", "Quantity"]), ("S1", 4, ["tlc-777", "=2+3"])]


def test_xml_and_json(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<R><DIV8 N="1.1320" TYPE="SECTION"><HEAD>h</HEAD><P>a</P><P>b</P></DIV8><DIV8 N="1.9999" TYPE="SECTION"><P>c</P></DIV8><DIV8 N="1.1325" TYPE="PART"/></R>'
    )
    assert [tuple(r) for r in readers.read_xml_sections(spark, str(tmp_path / "r.xml"), 1300, 1500).collect()] == [("1.1320", "h", "a\nb")]
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json_list(spark, str(tmp_path / "l.json"), "a int").count() == 2
    assert readers.read_json_list(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int")
    sinks.replace_run(rows, str(tmp_path / "runs"))
    sinks.replace_run(rows.filter("run_id = 'r2'").withColumn("x", F.lit(9)), str(tmp_path / "runs"))
    assert {(r.run_id, r.x) for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {("r1", 1), ("r2", 9)}
    new = spark.createDataFrame([("r2", 7), ("r3", 3)], "run_id string, x int")
    assert {tuple(r) for r in sinks.upserted(rows, new, ["run_id"]).collect()} == {("r1", 1), ("r2", 7), ("r3", 3)}
    assert {tuple(r) for r in sinks.upserted(rows, new, ["run_id"], update=False).collect()} == {("r1", 1), ("r2", 2), ("r3", 3)}
    mark = sinks.write_snapshot(rows, str(tmp_path / "v1"), ["run_id"])
    assert mark == sinks.write_snapshot(rows.orderBy(F.desc("x")), str(tmp_path / "v2"), ["run_id"])


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k // 24} {k % 24:02d}:30:00", k % 3, "view" if k % 2 else "click", 1.0, "{}") for k in range(72)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp("ts")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.windowed_counts(jobs.read_events(spark, str(tmp_path / "in"), 2), "1 day", "1 day")
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = jobs.current_status(spark.read.schema(jobs.EVENTS).parquet(str(tmp_path / "in")))
    assert {r.user_id: r.changes for r in batch.collect()} == {0: 24, 1: 24, 2: 24}
    done = spark.read.parquet(str(tmp_path / "out")).filter("start = '2024-01-01'").collect()
    assert {(r.event_type, r.n) for r in done} <= {("view", 12), ("click", 12)}


def test_evidence_of_mixed_suffixes(spark, tmp_path):
    make_book(tmp_path / "b.XLSX")
    files = [("x/a.csv", "p,q\n1,\n".encode()), ("b.XLSX", (tmp_path / "b.XLSX").read_bytes())]
    found = readers.evidence_cells(spark.createDataFrame(files, "path string, content binary"))
    assert {(r.file, r.row_number) for r in found.collect()} == {("x/a.csv", 1), ("x/a.csv", 2), ("b.XLSX", 1), ("b.XLSX", 2), ("b.XLSX", 4)}
    assert {r.text for r in readers.sheet_text(found).collect()} == {"p | q", "1", "Title | Title", "Lot # | Quantity", "tlc-777 | =2+3"}
    with pytest.raises(Exception, match="unsupported evidence file: c.pdf"):
        readers.evidence_cells(spark.createDataFrame([("c.pdf", b"")], "path string, content binary")).collect()


def test_workbook_export(spark):
    long = "t" * 40
    rows = [("r", "Findings", 1, {"z": "<&>"}), ("r", long, 1, {"b": " x ", "a": None}), ("r", long, 2, {"c": "é"}), ("r", "Summary", 1, {"n": "3"}), ("s", "Summary", 1, None)]
    df = spark.createDataFrame(rows, "run_id string, tab string, n int, fields map<string,string>")
    books = sinks.export_workbooks(df, ["n"]).select(F.col("run_id").alias("path"), "content")
    got = [(r.file, r.sheet, r.row_number, r.cells) for r in readers.workbook_cells(books).orderBy("file").collect()]
    assert [g for g in got if g[0] == "r"] == [
        ("r", "Summary", 1, ["n"]), ("r", "Summary", 2, ["3"]), ("r", "t" * 31, 1, ["a", "b", "c"]), ("r", "t" * 31, 2, [None, " x ", None]), ("r", "t" * 31, 3, [None, None, "é"]),
        ("r", "Findings", 1, ["z"]), ("r", "Findings", 2, ["<&>"]),
    ]
    parts = sinks.export_workbooks(df.filter("run_id = 'r'"), ["n"], part_rows=3)
    assert sorted(r.part for r in parts.collect()) == [0, 1]
    assert sinks.export_workbooks(df.limit(0), ["n"]).count() == 0


def test_artifacts_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "kind string, z int, a string")
    sinks.write_artifacts(rows, str(tmp_path / "out"), "kind")
    sinks.write_artifacts(rows.filter("kind = 'b'"), str(tmp_path / "out"), "kind")
    assert {(r.kind, r.value) for r in spark.read.text(str(tmp_path / "out")).collect()} == {("b", '{"a":null,"z":2}'), ("a", '{"a":"x","z":1}')}
    (tmp_path / "reg/one/normalized").mkdir(parents=True)
    (tmp_path / "reg/one/normalized/c.json").write_text('[{"sourceId": "s", "x": 1},\n {"x": 2}]')
    found = readers.read_registry(spark, str(tmp_path / "reg"), "sourceId string, x int")
    assert {tuple(r) for r in found.collect()} == {("one", "c.json", "s", 1), ("one", "c.json", "one", 2)}


def test_legacy_workbook(spark):
    rows = [
        ("w", ontology.PRODUCTS, 1, {"product_id": "p", "is_ftl_maybe": "maybe"}), ("w", ontology.PLAN, 2, {"plan_item": "point_of_contact", "answer": "late"}),
        ("w", ontology.PLAN, 1, {"plan_item": "point_of_contact", "answer": None}), ("v", ontology.VALUES, 3, {"kde_name": "Lot", "kde_value": None}), ("v", ontology.EVENTS, 1, None),
    ]
    made = ontology.ontology(spark.createDataFrame(rows, "workbook string, sheet string, position int, fields map<string,string>"))
    assert [(r.status, r.reason) for r in made["product_scope"].collect()] == [("not_determined", "needs_review")]
    assert {(r.workbook, r.plan_exists, r.point_of_contact) for r in made["plans"].collect()} == {("w", True, None), ("v", False, None)}
    assert [(r.kde_id, r.cte, r.field_key, r.status) for r in made["kde_values"].collect()] == [("kde-3", "receiving", "Lot", "missing")]
    assert [(r.event_id, r.event_type) for r in made["events"].collect()] == [(None, "receiving")]
    assert made["lineage"].count() == 0


def test_name_facts(spark):
    rows = [("in/Farm North_batch #AB-12_05-06-2024.csv", "Melon Salad"), ("in/Farm North_batch #AB-12_05-06-2024.csv", None), (None, "")]
    found = ontology.inferred_facts(spark.createDataFrame(rows, "file string, sheet string")).filter("field_key <> 'source_document_type'")
    assert {(r.source_kind, r.field_key, r.raw_value) for r in found.collect()} == {
        ("filename", "traceability_lot_code", "AB-12"), ("filename", "event_datetime", "05 06 2024"), ("sheet_name", "product_name", "Melon"), ("sheet_name", "product_name", "Salad"), ("filename", "location_name", "Farm North"),
    }


def test_follow_ups(spark):
    columns = "job_id string, run_id string, job_type string, status string, priority int, package_id string, previous_job_id string"
    parse = "parse_customer_workbook"
    rows = [("a", "r", parse, "succeeded", None, "p", None), ("b", "r", parse, "succeeded", 5, "", None), ("c", "r", parse, "failed", 5, "p", None), ("d", "r", parse, "succeeded", 5, "p", None), ("e", "r", "execute_approved_rules", "queued", 15, "p", "d")]
    found = jobs_of.follow_ups(spark.createDataFrame(rows, columns))
    assert [(r.job_id, r.priority, r.previous_job_id) for r in found.collect()] == [("execute_approved_rules:a", 110, "a")]
    assert jobs_of.follow_ups(spark.createDataFrame(rows, columns).unionByName(found)).count() == 0


def test_template_scan(spark):
    from tracemill.sources import template

    cells = spark.createDataFrame(
        [("a", "One", 1, [" Key ", "Name!", "Key"]), ("a", "One", 2, ["k", " n ", "last"]), ("a", "One", 4, [None]), ("a", "Other", 1, ["x"]), ("b", "Two", 3, ["Date"]), ("b", "One", 1, None)],
        "file string, sheet string, row_number int, cells array<string>",
    )
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    records, errors = template.template_scan(files, cells, {"One": ["key", "name"], "Two": ["date", "place"]})
    assert sorted((r.file, r.sheet, r.row_number, tuple(sorted(r["values"].items()))) for r in records.collect()) == [
        ("a", "One", 2, (("key", "last"), ("name", "n"))), ("a", "One", 4, (("key", ""), ("name", ""))),
    ]
    assert sorted(map(tuple, errors.collect()), key=str) == sorted(
        [
            ("a", "Two", None, template.NO_SHEET), ("b", "One", None, template.NO_SHEET), ("b", "Two", "place", template.NO_COLUMN), ("c", "One", None, template.NO_SHEET),
            ("c", "Two", None, template.NO_SHEET),
        ], key=str,
    )


def test_places_within_keys(spark):
    from pyspark.sql import functions as F

    from tracemill.operators.relational import first_rows_of, place_across

    rows = [("a", k) for k in range(500)] + [("b", 3), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows[::-1], "g string, k int").repartition(7)
    got = place_across(df, ["g"], [F.col("k")], "n").collect()
    assert sorted(((r.g, r.k, r.n) for r in got), key=str) == sorted([("a", k, k + 1) for k in range(500)] + [("b", 3, 1), (None, 1, 1), (None, 2, 2)], key=str)
    assert sorted(r.n for r in place_across(df, [], [F.col("k"), F.col("g")], "n").collect()) == list(range(1, 504))
    assert place_across(df.filter("false"), ["g"], [F.col("k")], "n").count() == 0
    assert sorted((r.g or "", r._n) for r in first_rows_of(df, ["g"], [F.col("k")], 2).collect()) == [("", 1), ("", 2), ("a", 1), ("a", 2), ("b", 1)]


def test_files_pass_in_few_batches(spark):
    """Small files share batches and no group is made for a file; a long run beside short ones is still cut into files."""
    rows = [(f"r{k}", "Summary", 0, {"n": str(k)}) for k in range(40)] + [("long", f"t{k % 2}", k, {"k": str(k)}) for k in range(25)] + [(None, "Summary", 0, {"n": None})]
    df = spark.createDataFrame(rows, "run_id string, tab string, n int, fields map<string,string>").repartition(5)
    made = sinks.export_workbooks(df, ["n"], part_rows=10)
    assert sorted(((r.run_id or "", r.part) for r in made.select("run_id", "part").collect())) == sorted([("", 0), *((f"r{k}", 0) for k in range(40)), *(("long", p) for p in range(3))])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    cells = readers.workbook_cells(made.filter("run_id = 'long'").select(F.col("part").cast("string").alias("path"), "content"))
    assert sorted(int(r.cells[0]) for r in cells.filter("row_number > 1").collect()) == list(range(25))
    found = readers.evidence_cells(made.select(F.concat_ws(".", F.coalesce("run_id", F.lit("none")), F.lit("xlsx")).alias("path"), "content"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # files are made once and read once
    assert found.filter("row_number = 2").count() == 40 + 4  # a tab has its header again in each file, a row without filled cells isn't there
