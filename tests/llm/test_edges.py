"""Empty tables, clashing columns, nulls and one very long text for operators that had no such tests."""

import public_tokenizers
from pyspark.sql import functions as F

from tracemill.llm import op01_token_counts, op02_packing, op06_html_extraction, op07_byte_bpe, op10_toxicity

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bias string, found string"


def edits():
    return F.array(F.struct(F.lit(3).alias("at"), F.lit(2).alias("remove"), F.lit("new ").alias("insert")))


def docs(spark):
    long = "word " * 60_000 + "x" * 300_000
    rows = [(1, "a short text", "en", "s", None, 0.5, "b", "f"), (None, None, None, None, None, None, None, None), (2, "", "", "", 0, 0.0, "", ""), (3, long, "en", "s", 1, 1.0, "b", "f"), (1, "a short text", "en", "s", None, 0.5, "b", "f")]
    return spark.createDataFrame(rows, DOCS).repartition(2)


def test_empty_tables(spark):
    none = docs(spark).filter("false")
    assert op01_token_counts.count_with_edits(none.withColumn("edits", edits()), BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    assert op02_packing.pack(none, WORD_BPE).count() == op07_byte_bpe.round_trip_digests(none, BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    assert op06_html_extraction.extract_text(none.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    none = docs(spark).filter("false").select("doc_id", "text", "lang", "source", "n_chars")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashes_and_long_texts(spark):
    rows = docs(spark)
    counted = op01_token_counts.count_with_edits(rows.withColumn("edits", edits()).withColumn("n_tokens", F.lit("clash")), BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 60_000) for r in counted) == [(0, False), (1, False), (1, False), (2, False), (3, True)]
    packed = op02_packing.pack(rows.withColumn("start", F.lit("clash")), WORD_BPE, keep_ids=False)
    held = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"), F.count_distinct("sequence_id").alias("s")).collect()
    assert all(r.n == r.of * (2 if r.doc_id == 1 else 1) for r in held) and len(held) == 4
    digests = op07_byte_bpe.round_trip_digests(rows.withColumn("ids_sha256", F.lit("clash")), BYTE_BPE, public_tokenizers.PATTERN)
    assert digests.count() == 5 and digests.filter("doc_id = 3").first().n_tokens > 60_000
    model = op10_toxicity.Model({"^clown$": 9.0}, -1.0)
    bad = spark.createDataFrame([(9, "you clown", "en", "s", None, 0.1, "b", "f")], DOCS)
    kept = op10_toxicity.clean(rows.unionByName(bad), model)
    assert kept.columns == rows.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 3]
    scored = op10_toxicity.score(rows.unionByName(bad), model).collect()
    assert {(r.doc_id, r.predicted) for r in scored} == {(1, 0), (None, 0), (2, 0), (3, 0), (9, 1)}
