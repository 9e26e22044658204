"""Column functions on regulatory texts: sentences, bullets, examples, what a field's heading says of its type and need, and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.scalars import _col, collapse

# --- Fixed values: beginnings of what stands in brackets but is no example, and how many examples count.
NO_EXAMPLES = ["mm/dd", "if applicable"]
MOST_EXAMPLES = 8


def _real(parts: Column) -> Column:
    """Parts without white space at their ends, without empty ones."""
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def sentences(text) -> Column:
    """Sentences of a text, cut after each full stop that white space follows."""
    return _real(F.split(collapse(F.coalesce(_col(text), F.lit(""))), r"(?<=\.)\s+"))


def bullets(text) -> Column:
    """Different items after bullets, in order, up to the page's footer; what stands before the first bullet is none."""
    parts = _real(F.split(F.coalesce(_col(text), F.lit("")), r"\s*•\s*"))
    after = F.filter(parts, lambda p, i: (i > 0) | F.ltrim(_col(text)).startswith("•"))
    cut = F.transform(after, lambda p: collapse(F.get(F.split(p, r"\s*www\.fda\.gov\s*|\nFood Traceability Rule:"), F.lit(0))))
    return F.array_distinct(F.filter(cut, lambda p: p != ""))


def listed_examples(text, marker: str) -> Column:
    """The examples that the sentence with a marker lists, split at commas and `and`; none without such a sentence."""
    sentence = F.regexp_extract(F.coalesce(_col(text), F.lit("")), rf"(?is)({marker}[^.]*\.)", 1)
    listed = F.regexp_replace(F.regexp_replace(sentence, r"(?is)^.*?include,?\s*(but are not limited to,)?", ""), r"\.+$", "")
    return F.transform(_real(F.split(listed, r",| and ")), lambda p: F.trim(F.regexp_replace(p, r"\[\d+\]", "")))


def bracketed_examples(header) -> Column:
    """Examples in a heading's brackets, split at commas and `or`; eight at most, as a heading has room for."""
    groups = F.regexp_extract_all(F.coalesce(_col(header), F.lit("")), F.lit(r"(?i)\((?:e\.g\.,|example:)?\s*([^)]+)\)"), 1)
    parts = _real(F.flatten(F.transform(groups, lambda g: F.split(g, r",| or "))))
    bad = lambda p: F.lower(p).startswith(NO_EXAMPLES[0]) | F.lower(p).startswith(NO_EXAMPLES[1])
    return F.slice(F.filter(parts, lambda p: ~bad(p)), 1, MOST_EXAMPLES)


def data_type(heading) -> Column:
    h = F.lower(F.coalesce(_col(heading), F.lit("")))
    has = lambda *words: h.rlike("|".join(words))
    return F.when(has("date", "mm/dd/yyyy"), "date").when(has("quantity"), "number").when(has("phone"), "phone").when(has("zip", "postal"), "postal_code").otherwise("text")


def required_status(heading) -> Column:
    return F.when(F.lower(F.coalesce(_col(heading), F.lit(""))).rlike("if applicable|if available|if needed"), "conditional").otherwise("required")


def condition(heading) -> Column:
    """When a conditional field is needed, in words; null if the heading doesn't say."""
    h = F.lower(F.coalesce(_col(heading), F.lit("")))
    return F.when(h.contains("if applicable"), "Required when applicable to the event, product, or entity context.").when(
        h.contains("if available"), "Expected when available from the source event or trading partner."
    )


def evidence_cell(evidence_id, labels: dict[str, str]) -> Column:
    """`sheet · row n` of an id such as x-06_event_lines-r12-c3, the sheet by its label where it has one; null for other ids."""
    found = lambda k: F.regexp_extract(F.coalesce(_col(evidence_id), F.lit("")), r"(?i)-(\d{2}_[a-z0-9_]+)-r(\d+)-c\d+", k)
    pairs = [F.lit(x) for item in labels.items() for x in item]
    sheet = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(found(1))), found(1)) if pairs else found(1)
    return F.when(found(1) != "", F.concat(sheet, F.lit(" · row "), found(2)))


def json_set(json, path: list[str], value: Column) -> Column:
    """A JSON object with a value (JSON text) at a path of keys, objects made where they are missing; null and broken objects start empty. Keys come sorted."""
    entries = "map<string,variant>"
    base = F.coalesce(F.try_variant_get(F.try_parse_json(_col(json)), "$", entries), F.create_map().cast(entries))
    key, rest = path[0], path[1:]
    inner = json_set(F.to_json(F.element_at(base, key)), rest, value) if rest else value
    one = F.create_map(F.lit(key), F.parse_json(inner))
    kept = F.map_filter(base, lambda k, _: k != key)
    return F.to_json(F.parse_json(F.to_json(F.map_concat(kept, one))))
