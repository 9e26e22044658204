"""Operator 11, line dedup: lines that stand in several documents stay in the first of them only. DataFrame functions throughout.

Lines are exploded with their positions and normalised, and two 64-bit hashes stand for a normalised line from then on, so no
line's text is shuffled. Distinct documents are counted per hash pair in two steps, (hash, document) before
hash, so a line of a third of all rows is spread until it has been summed. What each document loses is
gathered as positions, which its own length bounds, and the document is put together again by position.

Two different lines share both hashes with a probability of about 2**-127 for a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import measured, small

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def lowered(line: Column) -> Column:
    """A-Z in lower case; other letters as they are. Spark's lower() does just that for lines of one byte a character, and faster."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 10, most_documents: int = 1) -> DataFrame:
    """docs with the lines taken from `text` that stand elsewhere too, and the columns n_lines and n_dropped.

    A line's key is the line without white space (0x20, 0x09-0x0D) at both ends, with A-Z lower-cased. A key of at least
    `least_chars` code points in more than `most_documents` documents loses all its lines, but for those in the least id holding it.
    A line repeated within one document only stays.

    Nulls and odd cases: a null or empty text is one empty line and gives an empty text. Rows that repeat an id are one
    document for the count, and each keeps or loses lines by that id. Rows without an id are together one document,
    greater than all others. An empty table stays empty. Columns named n_lines or n_dropped are replaced, others kept.
    """
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    base = docs.select(F.struct(*rest).alias("row"), F.col(doc_id).alias("doc"), F.xxhash64(doc_id, text).alias("mark"), lines_of(F.col(text)).alias("lines"))
    each = base.select("doc", "mark", F.posexplode("lines").alias("at", "line")).withColumn("line", stripped(F.col("line")))
    each = each.filter(F.char_length("line") >= least_chars).withColumn("line", lowered(F.col("line")))
    each = each.select("doc", "mark", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))

    keys = each.groupBy("h", "g").agg(F.count_distinct(F.struct("doc")).alias("documents"), F.min("doc").alias("first"))
    keys, count = measured(keys.filter(F.col("documents") > most_documents).select("h", "g", "first"))
    lost = each.join(small(keys, count.rows), ["h", "g"]).filter(~F.col("doc").eqNullSafe(F.col("first")))
    lost = lost.groupBy(F.col("doc").alias("of"), F.col("mark").alias("with")).agg(F.collect_set("at").alias("lost"))

    joined = base.join(lost, F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("with")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))  # hashed, so linear for long documents
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda at: F.get("lines", at)))
    n_dropped = F.coalesce(F.size("lost"), F.lit(0)).cast("long")
    out = {c: F.col("row").getField(c) for c in rest} | {text: F.array_join(kept, "\n")}
    order = [c for c in docs.columns if c in out]
    return joined.select(*(out[c].alias(c) for c in order), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped"))


def kept_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of documents."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
