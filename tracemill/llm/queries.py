"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import small_batches, table
from tracemill.llm.op01_token_counts import count_with_edits
from tracemill.llm.op02_packing import pack
from tracemill.llm.op03_embedding_near_dedup import embedding_links
from tracemill.llm.op04_substring_dedup import passages
from tracemill.llm.op05_ngram_jaccard_join import jaccard_classes
from tracemill.llm.op06_html_extraction import extract_text
from tracemill.llm.op07_byte_bpe import round_trip_digests
from tracemill.llm.op08_language_id import document_evidence, identify, page_evidence, train_trigrams
from tracemill.llm.op09_media_copies import edited, find_copies, pictures
from tracemill.llm.op10_toxicity import score, train
from tracemill.llm.op11_line_dedup import kept_digests
from tracemill.llm.op12_centroid_clustering import clustered
from tracemill.llm.op13_vector_codes import codes_with_errors

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def sample_edits(text: str = "text", key: str = "doc_id"):
    """Three edits for every document, placed by its length and id: a deletion, an insertion, a replacement."""
    n, k = F.length(F.coalesce(F.col(text), F.lit(""))), F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(97))
    edit = lambda at, remove, insert: F.struct(
        at.cast("int").alias("at"), F.lit(remove).alias("remove"), insert.alias("insert")
    )
    return F.array(
        edit(F.floor(n / 3), 7, F.lit("")),
        edit(F.floor(n / 2), 0, F.concat(F.lit(" revised "), k.cast("string"), F.lit("'s"))),
        edit(F.floor(n * k / 97), 5, F.lit("It's 2024.\n")),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sample_edits().alias("edits"))
    return count_with_edits(docs, BYTE_BPE, public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), WORD_BPE, keep_ids=False)



def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return passages(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_text(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source is the host) and pages (with markup and address) in one result, told apart by `corpus`."""
    small_batches(spark)
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = document_evidence(docs).select(F.lit("documents").alias("corpus"), "*", none.alias("page_id"))
    rows = rows.unionByName(page_evidence(pages).select(F.lit("pages").alias("corpus"), "*", none.alias("doc_id")))
    found = identify(rows, train_trigrams(docs))
    return found.select("corpus", "doc_id", "page_id", "lang", "confidence", "rejected", "declared", "host")


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all vectors, searched with cropped and edited pictures of those whose id is divisible by 50."""
    small_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return find_copies(edited(pictures(vectors.filter(F.col("vec_id") % 50 == 0))), pictures(vectors))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes_with_errors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other
), parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts USING (vec_id)
"""

OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words)
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM (SELECT DISTINCT doc_id FROM documents) d
  LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
SELECT doc_id, n AS n_shingles, least(doc_id, min(other)) AS component_id
FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
"""

OP11_SQL = """
WITH lines AS (
  SELECT doc_id, row, unnest(l) AS line, generate_subscripts(l, 1) AS place
  FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), held AS (
  SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS documents FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.*, coalesce(h.documents > 1 AND h.first <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN held h USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row, doc_id
"""


def _floor_mean(values: str, counts: str) -> str:
    """floor(sum / count) of whole numbers; DuckDB's // cuts towards zero."""
    return f"(({values}) - ((({values}) % ({counts})) + ({counts})) % ({counts})) // ({counts})"


def _op12_sql(clusters: int = 40, rounds: int = 5, seed: int = 2) -> str:
    squared = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)"  # whole and far below 2**53, so exact
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x FROM embeddings WHERE len(embedding) = 64"
        " AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o, x) - 1 AS k, x FROM (SELECT sha256('{seed}:' || vec_id) AS o, x FROM v WHERE vec_id IS NOT NULL ORDER BY o, x LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, x, (m).k AS k, (m).d AS d FROM (SELECT v.vec_id, v.x, min(struct_pack(d := ({squared})::BIGINT, k := c.k)) AS m FROM v, c{r} c GROUP BY v.vec_id, v.x))"
        )
        if r < rounds:
            mean = _floor_mean("sum(e)::BIGINT", "count(*)")
            steps.append(
                f"m{r} AS (SELECT k, list(f::DOUBLE ORDER BY i) AS x FROM (SELECT k, i, {mean} AS f FROM (SELECT k, unnest(x)::BIGINT AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY k, i) GROUP BY k)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(list_transform(c.x, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} c USING (k)"
    )


def _op13_sql(entries: int = 256, parts: int = 4, rounds: int = 4) -> str:
    squared = "list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)"
    cut = "x[(p * (len(x) // {0}) + 1):((p + 1) * (len(x) // {0}))]".format(parts)
    steps = [
        "w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT r, vec_id, label, p, {cut} AS x FROM w, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS k, x FROM v WHERE r <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT r, p, x, (m).k AS k, (m).d AS d FROM (SELECT v.r, v.p, v.x, min(struct_pack(d := ({squared})::BIGINT, k := c.k)) AS m FROM v JOIN c{r} c ON v.p = c.p GROUP BY v.r, v.p, v.x))"
        )
        if r < rounds:
            mean = _floor_mean("sum(e)::BIGINT", "count(*)")
            steps.append(
                f"m{r} AS (SELECT p, k, list(f::DOUBLE ORDER BY i) AS x FROM (SELECT p, k, i, {mean} AS f FROM (SELECT p, k, unnest(x)::BIGINT AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.k = c.k)")
    steps.append(f"done AS (SELECT r, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda e: e::BIGINT::VARCHAR), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM done JOIN w USING (r), book"


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op4_substring_dedup": op4_substring_dedup,
        "op9_media_copies": op9_media_copies,
        "op6_html_extraction": op6_html_extraction,
        "op8_language_id": op8_language_id,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op10_toxicity": op10_toxicity,
        "op1_token_counts": op1_token_counts,
        "op2_packing": op2_packing,
        "op7_byte_bpe": op7_byte_bpe,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op11_line_dedup": op11_line_dedup,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_vector_codes": op13_vector_codes,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": OP3_SQL,
        "op5_ngram_jaccard_join": OP5_SQL,
        "op11_line_dedup": OP11_SQL,
        "op12_centroid_clustering": _op12_sql(),
        "op13_vector_codes": _op13_sql(),
    }
