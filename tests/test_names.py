"""Facts in names: their plan stays small, ties go to the first type, a product counts once."""

from pyspark.sql import functions as F

from tracemill.functions.scalars import document_type
from tracemill.operators import ontology


def test_names(spark):
    rows = [("invoice dock vessel",), ("FREIGHT invoice",), ("none",), (None,), ("lettuce-LETTUCE_basil",), ("salads",)]
    df = spark.createDataFrame(rows, "n string")
    kinds = [r.k.document_type for r in df.select(document_type("n").alias("k")).collect()]
    assert kinds == ["seafood_landing_record", "invoice", "unknown", "unknown", "unknown", "unknown"]
    facts = [[(f.field_key, f.raw_value) for f in r.f] for r in df.select(ontology.name_facts(F.col("n")).alias("f")).collect()]
    product = lambda *names: [("product_name", n) for n in names]
    assert facts[2:] == [[], [], product("Basil", "Lettuce"), []]
    # every mention of the types' words or of the name's own expression in the plan is evaluated for each row
    plan = df.select(F.inline(ontology.name_facts(F.concat("n", F.lit("mark of the name")))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mark of the name") == 1 and plan.count("landing ticket") <= 1
