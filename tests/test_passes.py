"""How often queries make and read their files and rows, as their plans tell."""

import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import ontology
from tracemill.plans import queries_io, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no shared tables here")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_template_scan_makes_and_reads_files_once(spark):
    for rows in queries_io.template_parts(spark, DATA):
        assert plan(rows).count("MapInArrow") == 2  # one that makes them, one that reads them


def test_pages_are_parsed_by_all_tasks(spark):
    assert "RepartitionByExpression" in plan(registry.queries()["S4_built_sections"](spark, DATA))


def test_a_legacy_sheet_makes_no_other_rows(spark):
    rows = queries_io.legacy_rows(spark, DATA)
    of_one = plan(ontology.products(rows))
    assert "Union" not in of_one and ontology.VALUES not in of_one
    assert rows.groupBy("sheet").agg(F.count(F.lit(1))).count() == 9
