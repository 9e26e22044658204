"""Legal chunks with anchors, and citations resolved down to the paragraphs of the section that they cite.

Sections are judged in one pass, so each is a chunk, a rejected section or a blank one. A section's text is cut at its paragraph
markers and every piece gets the path of the paragraphs that it stands in, by window functions over the section's
pieces; a citation then meets its section once, with all its paragraphs, and is scored against them inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import collapse, distinct_words, sha256, shortened, strip

# --- Fixed values: words of a condition and of an obligation, and the length up to which a condition alone is no chunk.
CONDITION = r"\b(if|when|unless|where|provided that)\b"
OBLIGATION = r"\b(must|shall|required|requires|maintain|keep|establish)\b"
LONGEST_FRAGMENT = 120
REJECTED = "Chunk has condition language without an obligation."
# --- Fixed values: a paragraph's marker, lower roman numerals, and the words of an obligation that a paragraph has to share to be inferred.
MARKER = r"\([A-Za-z0-9]+\)"
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
LETTER_BEFORE = {"i": "h", "v": "u", "x": "w"}
LEAST_SHARED = 3
QUERY_FIELDS = ["action", "object", "required_output", "condition", "noncompliance_risk"]
ADDITIVE = "Subparagraph resolution is additive; section-level validation remains authoritative."
NO_TARGET = "No confident subparagraph target was inferred; retain section-level citation only."
MISSING = "One or more proposed subparagraph anchors were not found in the cited section text."


def filled(name: str) -> Column:
    """The column, with an empty string as null."""
    return F.nullif(F.col(name), F.lit(""))


def is_fragment(text: Column) -> Column:
    """A short text with the words of a condition and none of an obligation."""
    lower = F.lower(text)
    return (F.length(lower) <= LONGEST_FRAGMENT) & lower.rlike(CONDITION) & ~lower.rlike(OBLIGATION)


def citation_anchor(section: Column, paragraph: Column, table_label: Column) -> Column:
    """The parts that are there, joined by spaces."""
    return F.array_join(F.filter(F.array(section, paragraph, table_label), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def legal_chunks(sections: DataFrame) -> DataFrame:
    """Every section with its `side`: chunk, rejected or blank.

    sections: source_id, source_hash, ordinal (from 1, within its source), section_label, section, paragraph, table_label, text; other columns stay.
    A section without a name goes by its label, else as document. Added: chunk_id (source, section as a slug, ordinal), citation, summary, text_hash (over
    the source's hash and the text) for chunks, reason for rejected ones. Null texts are blank. Rows that repeat an ordinal repeat a chunk_id.
    """
    name = F.coalesce(filled("section"), filled("section_label"), F.lit("document"))
    rows = sections.withColumns({"text": strip("text"), "section": name, "section_label": F.coalesce(filled("section_label"), name)})
    side = F.when(F.col("text") == "", "blank").when(is_fragment(F.col("text")), "rejected").otherwise("chunk")
    rows = rows.withColumn("side", side)
    chunk = lambda value: F.when(F.col("side") == "chunk", value)
    part = F.regexp_replace(F.regexp_replace(F.lower("section"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return rows.withColumns(
        {
            "chunk_id": chunk(F.concat_ws("-", "source_id", part, F.col("ordinal").cast("string"))),
            "citation": chunk(citation_anchor(F.col("section"), F.col("paragraph"), F.col("table_label"))),
            "summary": chunk(shortened(collapse("text"))),
            "text_hash": chunk(F.concat(F.lit("sha256:"), sha256(F.concat(F.coalesce("source_hash", F.lit("")), "text")))),
            "reason": F.when(F.col("side") == "rejected", REJECTED),
        }
    )


def chunk_counts(judged: DataFrame) -> DataFrame:
    """(source_id, sections, chunks, rejected, blank): what came in is what went out."""
    count = lambda s: F.count_if(F.col("side") == s)
    return judged.groupBy("source_id").agg(F.count(F.lit(1)).alias("sections"), count("chunk").alias("chunks"), count("rejected").alias("rejected"), count("blank").alias("blank"))


def span_status(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations (source_id, chunk_id, citation_anchor, support_text, ...) with span_status, from chunks (chunk_id, source_id, citation_anchor, text).

    invalid where the chunk is missing, of another source, under another anchor or without the text; partial without a text to look
    for; valid if it stands in the chunk as it is, valid_normalized if it does once white space is collapsed.
    A chunk's id is its key; a null one is never found. Columns of the chunk stay as chunk_text only.
    """
    known = chunks.select("chunk_id", F.col("source_id").alias("_source"), F.col("citation_anchor").alias("_anchor"), F.col("text").alias("chunk_text"), F.lit(True).alias("_found"))
    support = strip("support_text")
    same_anchor = filled("citation_anchor").isNull() | (strip("_anchor") == strip("citation_anchor"))
    text = F.coalesce("chunk_text", F.lit(""))
    status = (
        F.when(F.col("_found").isNull() | ~F.col("_source").eqNullSafe(F.col("source_id")) | ~same_anchor, "invalid")
        .when(support == "", "partial")
        .when(F.contains(text, support), "valid")
        .when(F.contains(collapse(text), collapse(support)), "valid_normalized")
        .otherwise("invalid")
    )
    return citations.join(known, "chunk_id", "left").withColumn("span_status", status).drop("_source", "_anchor", "_found")


def _kind(token: Column) -> Column:
    """1 letters, 2 numbers, 3 roman numerals, 4 capitals, by the token alone."""
    capital = token.rlike("[A-Z]") & ~token.rlike("[a-z]")
    return F.when(token.rlike("^[0-9]+$"), 2).when(capital, 4).when(F.lower(token).isin(ROMAN), 3).otherwise(1)


def paragraphs(sections: DataFrame) -> DataFrame:
    """(chunk_id, ordinal, path, level, start, text) of the marked paragraphs of sections (chunk_id, text).

    Levels are letters, numbers, roman numerals, capitals; a paragraph stands in the last one before it of each higher level that no
    other has closed, and levels may be left out. The markers i, v and x are letters only if the paragraph before on
    that level is h, u or w and no number is open in it; else they are numerals. path: the markers in brackets, as in (c)(3)(ii). start: place of the marker in the text, from 0.
    A text without markers is one paragraph with an empty path; what stands before the first marker is none; a blank or null text has none.
    """
    pieces = sections.select("chunk_id", F.posexplode(F.split("text", rf"(?={MARKER})", -1)).alias("ordinal", "piece"))
    order = Window.partitionBy("chunk_id").orderBy("ordinal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    token = F.nullif(F.regexp_extract("piece", rf"^\(({MARKER[2:-2]})\)", 1), F.lit(""))
    rows = pieces.withColumns({"token": token, "start": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))})
    rows = rows.withColumn("kind", F.when(F.col("token").isNotNull(), _kind(F.col("token"))))
    # the last letter or number tells whether i, v or x goes on with the letters
    last = F.last_value(F.when(F.col("kind") <= 2, F.col("token")), ignoreNulls=True).over(before)
    letter = F.create_map(*(F.lit(x) for item in LETTER_BEFORE.items() for x in item))
    rows = rows.withColumn("level", F.when(F.try_element_at(letter, "token") == last, 1).otherwise(F.col("kind")))
    path = F.concat(F.lit("("), F.col("token"), F.lit(")"))
    for level in (3, 2, 1):
        nearest = F.last_value(F.when(F.col("level") <= level, F.struct("level", "token")), ignoreNulls=True).over(before)
        here = (F.col("level") > level) & (nearest["level"] == level)
        path = F.concat(F.when(here, F.concat(F.lit("("), nearest["token"], F.lit(")"))).otherwise(""), path)
    marked = F.max(F.col("token").isNotNull()).over(Window.partitionBy("chunk_id"))
    rows = rows.withColumns({"path": F.coalesce(path, F.lit("")), "marked": marked, "text": strip("piece")})
    rows = rows.filter(F.when(F.col("marked"), F.col("token").isNotNull()).otherwise(F.col("text") != ""))
    return rows.select("chunk_id", "ordinal", "path", "level", F.col("start").cast("int").alias("start"), "text")


def resolve_subparagraphs(citations: DataFrame, obligations: DataFrame, chunks: DataFrame, targets: DataFrame, artifact: str) -> DataFrame:
    """A row for each citation: the paragraphs of its section that it means, and whether they are there.

    citations: obligation_id, citation_no, source_id, chunk_id, citation_anchor, section_ref, support_text. obligations: obligation_id and the QUERY_FIELDS. chunks: as in
    span_status. targets: obligation_id, target_anchors, review_status. Approved targets hold; without them the paragraphs that share most
    words of three letters or more with the obligation are meant, all that tie, if they share three. Missing targets make a citation unresolved, no target
    leaves it at its section, and neither weakens the section's own status. Two approved rows for one obligation are an error.
    """
    section = F.coalesce(filled("section_ref"), F.coalesce("citation_anchor", F.lit("")))
    words = distinct_words(F.concat_ws(" ", *QUERY_FIELDS), 3)
    cited = span_status(citations, chunks).drop("chunk_text").withColumn("section_ref", section)
    cited = cited.join(obligations.select("obligation_id", words.alias("_words")), "obligation_id")
    approved = targets.filter("review_status = 'approved'").groupBy("obligation_id").agg(F.count(F.lit(1)).alias("_n"), F.any_value("target_anchors").alias("_approved"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two approved targets: "), F.col("obligation_id").cast("string")))).otherwise(F.col("_approved"))
    cited = cited.join(approved, "obligation_id", "left").withColumn("_approved", once)
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "path", distinct_words("text", 3).alias("words"))))  # as many as the section has
    cited = cited.join(paragraphs(chunks).groupBy("chunk_id").agg(parts.alias("_parts")), "chunk_id", "left")

    scored = F.transform(
        F.coalesce("_parts", F.array().cast("array<struct<ordinal:int,path:string,words:array<string>>>")),
        lambda p: F.struct(F.concat(F.col("section_ref"), p["path"]).alias("anchor"), F.size(F.array_intersect(p["words"], F.col("_words"))).alias("shared")),
    )
    cited = cited.withColumn("_scored", scored)
    most = F.array_max(F.transform("_scored", lambda p: p["shared"]))
    cited = cited.withColumn("_most", most)
    best = F.filter("_scored", lambda p: (p["shared"] == F.col("_most")) & (p["shared"] >= LEAST_SHARED))
    wanted = F.coalesce(F.col("_approved"), F.transform(best, lambda p: p["anchor"]))
    there = F.array_union(F.array("section_ref"), F.transform("_scored", lambda p: p["anchor"]))
    cited = cited.withColumns({"_wanted": wanted, "_there": there})
    found = F.filter("_wanted", lambda a: F.array_contains("_there", a))
    missing = F.filter("_wanted", lambda a: ~F.array_contains("_there", a))
    cited = cited.withColumns({"resolved_subparagraph_anchors": found, "unresolved_targets": missing})
    status = F.when(F.size("unresolved_targets") > 0, "unresolved").when(F.size("resolved_subparagraph_anchors") > 0, "resolved").otherwise("section_only")
    notes = F.array_compact(F.array(F.lit(ADDITIVE), F.when(F.size("_wanted") == 0, NO_TARGET), F.when(F.size("unresolved_targets") > 0, MISSING)))
    return cited.select(
        "obligation_id", "citation_no", "chunk_id", "section_ref", "citation_anchor", F.col("span_status").alias("section_level_status"),
        (F.col("span_status") != "invalid").alias("section_level_remains_valid"), status.alias("resolution_status"), "resolved_subparagraph_anchors",
        "unresolved_targets", F.size("_scored").alias("candidate_count"),
        F.when(F.col("_approved").isNull(), "semantic_overlap").otherwise(f"approved_target_artifact:{artifact}").alias("method"), notes.alias("notes"),
    )


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """One row: counts by status and of invalid sections; pass if nothing is unresolved and no section invalid."""
    count = lambda s: F.count_if(F.col("resolution_status") == s).alias(s)
    invalid = F.count_if(~F.col("section_level_remains_valid")).alias("invalid_sections")
    out = resolved.agg(F.count(F.lit(1)).alias("citations"), count("resolved"), count("section_only"), count("unresolved"), invalid)
    return out.withColumn("status", F.when((F.col("unresolved") == 0) & (F.col("invalid_sections") == 0), "pass").otherwise("review_required"))
