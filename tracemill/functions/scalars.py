"""Column functions for messy record values. All stay in the JVM; none throws on bad input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.plans import cards


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(value) -> Column:
    """Remove white space of any script from both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(_col(value).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def collapse(value) -> Column:
    return strip(F.regexp_replace(_col(value), r"(?U)\s+", " "))


def contains_any(text: Column, words: list[str]) -> Column:
    """Plain substring tests, never on word bounds."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def matched_words(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def lookup(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def slug(value) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(_col(value), F.lit(""))), "[^a-z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def header_key(value) -> Column:
    return F.regexp_replace(F.replace(F.lower(strip(value)), F.lit("_"), F.lit(" ")), r"(?U)\s+", " ")


def stable_id(prefix: str, value) -> Column:
    text = F.substring(slug(value), 1, 80)
    return F.concat(F.lit(prefix + "-"), F.when(text == "", "unknown").otherwise(text))


def title(value) -> Column:
    """Capitals after anything that isn't a letter; underscores become spaces."""
    text = F.lower(F.replace(_col(value), F.lit("_"), F.lit(" ")))
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


def column_letter(index) -> Column:
    """Spreadsheet letters of a 1-based column, up to three."""
    n = _col(index).cast("int")
    letter = lambda k: F.char(F.lit(65) + k)
    one = letter(F.pmod(n - 1, F.lit(26)))
    two = F.concat(letter(F.pmod(F.floor((n - 27) / 26), F.lit(26))), one)
    three = F.concat(letter(F.pmod(F.floor((n - 703) / 676), F.lit(26))), two)
    return F.when(n < 1, "A").when(n <= 26, one).when(n <= 702, two).otherwise(three)


def is_answered(value) -> Column:
    """False for null and for placeholders such as "n/a" or "tbd"."""
    return F.coalesce(~F.lower(strip(value)).isin(cards.PLACEHOLDERS), F.lit(False))


def real_value(value) -> Column:
    return F.when(is_answered(value), _col(value))


def first_present(values: Column) -> Column:
    """First element that isn't null, empty, "None" or "null"."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & ~v.isin("", "None", "null")), F.lit(1))


def parse_date(value) -> Column:
    """ISO date text of eight written forms, months before days where both fit; null if none fits."""
    text = strip(value)
    spaced = text.rlike(r"^(\d{4}\s+\d{1,2}\s+\d{1,2}|\d{1,2}\s+\d{1,2}\s+\d{4})$")
    text = F.replace(F.when(spaced, F.regexp_replace(text, r"\s+", "-")).otherwise(text), F.lit("."), F.lit("/"))
    attempt = lambda shape, pattern: F.when(text.rlike(shape), F.try_to_date(text, pattern))
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(text, "M/d/yy"))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    words = F.initcap(F.regexp_replace(text, r"(?U)\s+", " "))
    named = lambda shape, pattern: F.when(words.rlike(shape), F.try_to_date(words, pattern))
    dashed = F.concat_ws("-", F.split_part(text, F.lit("-"), F.lit(1)), F.initcap(F.split_part(text, F.lit("-"), F.lit(2))), F.split_part(text, F.lit("-"), F.lit(3)))
    found = F.coalesce(
        attempt(r"^\d{8}$", "yyyyMMdd"),
        attempt(r"^\d{8}$", "MMddyyyy"),
        attempt(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        attempt(r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        attempt(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        short,
        attempt(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        F.when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.try_to_date(dashed, "d-MMM-yyyy")),
        named(r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
        named(r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"),
    )
    return F.date_format(found, "yyyy-MM-dd")


def normalize_unit(value) -> Column:
    text = F.regexp_replace(F.lower(_col(value)), r"^\.+|\.+$", "")
    return F.coalesce(lookup(text, cards.UNITS), text)


def normalize_quantity(value) -> Column:
    number = F.regexp_extract(F.replace(_col(value), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.when(number == "", _col(value)).otherwise(number)


def normalize_value(value, field_key) -> Column:
    """A cell's canonical text by its field: dates, identifiers, units, quantities, yes and no; formulas stay."""
    text, key = strip(value), F.coalesce(_col(field_key), F.lit(""))
    dated = F.when((key == "") | F.contains(key, F.lit("date")), parse_date(text))
    flat = collapse(text)
    return F.coalesce(
        dated,
        F.when(flat.startswith("="), flat)
        .when(key.endswith("_id") | F.contains(key, F.lit("lot")), F.replace(F.upper(flat), F.lit(" "), F.lit("")))
        .when(key == "unit", normalize_unit(flat))
        .when(key == "quantity", normalize_quantity(flat))
        .when(F.lower(flat).isin("y", "yes", "true"), "yes")
        .when(F.lower(flat).isin("n", "no", "false"), "no")
        .otherwise(flat),
    )


def field_type(field_key, value) -> Column:
    key, text = _col(field_key), F.coalesce(_col(value), F.lit(""))
    return (
        F.when(text.startswith("="), "formula")
        .when(F.contains(key, F.lit("date")) | text.rlike(r"^\d{4}-\d{2}-\d{2}.*$"), "date")
        .when(key.endswith("_id") | F.contains(key, F.lit("lot")), "identifier")
        .when(F.lower(text).isin("yes", "no", "true", "false", "unknown"), "boolean_like")
        .when(text.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .otherwise("text")
    )


def evidence_cte(value) -> Column:
    """Event type as evidence names it."""
    return lookup(F.regexp_replace(F.replace(F.lower(strip(value)), F.lit("_"), F.lit(" ")), r"(?U)[\s-]+", " "), cards.EVIDENCE_CTE)


def classifier_cte(value) -> Column:
    """Event type as the classifier reads it; hyphens aren't spaces here."""
    text = collapse(F.replace(F.lower(F.coalesce(_col(value), F.lit(""))), F.lit("_"), F.lit(" ")))
    return F.when(text.isin(cards.TRANSFORMATION_WORDS), "transformation").otherwise(lookup(text, cards.CLASSIFIER_CTE))


def tri_state(value) -> Column:
    """Yes, no, or null for unknown."""
    text = F.lower(strip(value))
    return F.when(text.isin("yes", "y", "true", "1", "t"), True).when(text.isin("no", "n", "false", "0"), False)


def match_token(value) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(value), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def document_type(text) -> Column:
    """(document_type, signals): the type with most words in the text, the first on ties."""
    named = lambda name, signals: F.struct(name.alias("document_type"), signals.alias("signals"))
    types = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, words)).alias("words")) for name, words in cards.DOCUMENT_WORDS))
    # the text is taken as a variable and the types are folded, so that nothing is evaluated more than once
    found = lambda lower: F.transform(types, lambda t: named(t["name"], F.filter(t["words"], lambda w: F.contains(lower, w))))
    none = named(F.lit("unknown"), F.array().cast("array<string>"))
    most = lambda lower: F.reduce(found(lower), none, lambda best, x: F.when(F.size(x["signals"]) > F.size(best["signals"]), x).otherwise(best))
    return F.element_at(F.transform(F.array(F.lower(_col(text))), most), 1)


def actor_role(name, kind, event_type) -> Column:
    """(role, confidence): by the words of name, type and event, else by the event type."""
    text = F.lower(F.concat_ws(" ", *(F.when(_col(x) != "", _col(x)) for x in (name, kind, event_type))))
    role, sure = lookup(evidence_cte(event_type), cards.CTE_ROLE), F.lit(0.62)
    out = F.when(role.isNotNull(), F.struct(role.alias("role"), sure.alias("confidence"))).otherwise(
        F.struct(F.lit("unknown").alias("role"), F.lit(0.3).alias("confidence"))
    )
    for known, words in reversed(cards.ROLE_WORDS):
        out = F.when(contains_any(text, words), F.struct(F.lit(known).alias("role"), F.lit(0.86).alias("confidence"))).otherwise(out)
    return out


def food_form(product, category, form, matched_item=None) -> Column:
    """(form_state, is_listed, remains_listed, review_required, confidence) of a food by its words."""
    text = F.lower(F.concat_ws(" ", *(F.when(_col(x) != "", _col(x)) for x in (product, category, form))))
    states = F.filter(F.array(*(F.when(contains_any(text, words), F.lit(name)) for name, words in cards.FORM_WORDS)), lambda s: s.isNotNull())
    unlisted = F.arrays_overlap(states, F.array(*map(F.lit, cards.UNLISTED_FORMS)))
    has_category = F.coalesce(_col(category) != "", F.lit(False))
    item = F.lit(None).cast("string") if matched_item is None else _col(matched_item)
    listed = F.when(has_category | item.isNotNull(), F.lit(True))
    remains = F.when(unlisted, F.lit(False)).when(listed, F.lit(True))
    base = F.when(item.isNotNull(), 0.9).when(has_category, 0.82).otherwise(0.35)
    fresh = (F.size(states) == 0) & contains_any(text, cards.FRESH_PRODUCE)
    killed = F.array_contains(states, "kill_step_applied")
    return F.struct(
        F.when(fresh, F.array(F.lit("fresh"))).otherwise(F.array_sort(states)).alias("form_state"),
        listed.alias("is_listed"),
        remains.alias("remains_listed"),
        (listed.isNull() | remains.isNull() | unlisted | killed).alias("review_required"),
        F.when(unlisted, F.least(base, F.lit(0.78))).otherwise(base).alias("confidence"),
    )


def shortened(text, most: int = 180) -> Column:
    """At most `most` characters, the last three dots where it was cut."""
    return F.when(F.length(_col(text)) > most, F.concat(F.substring(_col(text), 1, most - 3), F.lit("..."))).otherwise(_col(text))


def sha256(value) -> Column:
    return F.sha2(_col(value).cast("binary"), 256)


def row_hash_id(prefix: str, *parts) -> Column:
    """prefix and 24 hex digits of the parts joined by bars; null parts are empty."""
    text = F.concat_ws("|", *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, 24))


def ratio(part, whole, empty: float = 0.0) -> Column:
    """part / whole to four places, halves up, in whole numbers; `empty` where whole is 0."""
    p, q = _col(part).cast("long"), _col(whole).cast("long")
    return F.when(q == 0, F.lit(empty)).otherwise(F.floor((20000 * p + q) / (2 * q)) / 10000)


def distinct_words(text, least: int = 1) -> Column:
    """Distinct lower-case words of letters and digits, in order of first use."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"([a-z0-9]+)"), 1), lambda w: F.length(w) >= least))
