"""Event types from the phrases of a text: evidence by family, a verifier, and routing.

All phrases of all families are found in one pass over a text by an automaton; what was found is an array of group names, and every rule
is a Column expression over that array. A text in which a phrase stands many times costs no more than one in which it stands once.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: families of evidence for an event type, each with its phrases.
SIGNALS = [
    ("shipping", "action_semantics", ["shipping", "shipped", "outbound", "outgoing", "transportation process", "loaded to truck", "leaves warehouse"]),
    ("shipping", "from_to_movement", ["moves to external customer", "between two supply-chain companies", "to retail customer", "tracked to store", "from point of origin to a retail location", "from supplier to buyer", "future sales"]),
    ("shipping", "document_type", ["shipping log", "bill of lading", "bizstep shipping", "pallet shipping"]),
    ("shipping", "reference_document", ["reference document", "delivery note", "desadv", "po/"]),
    ("receiving", "action_semantics", ["received", "receiving", "inbound", "unloaded", "recipient scans"]),
    ("receiving", "from_to_movement", ["received from supplier", "incoming", "enters the distribution center", "transportation for"]),
    ("receiving", "document_type", ["receiving log", "supplier delivery note", "bizstep receiving"]),
    ("transformation", "action_semantics", ["transformation", "transformed", "transforms", "manufactured", "processed into", "recipe"]),
    ("transformation", "lot_tlc", ["input lot", "output lot", "source lot", "finished lot", "ingredient batch", "out-"]),
    ("transformation", "product_quantity", ["new product", "new finished product", "new form"]),
    ("harvesting", "action_semantics", ["harvested", "harvesting", "harvest event", "field harvest"]),
    ("harvesting", "lot_tlc", ["harvest location", "field lot"]),
    ("initial_packing", "action_semantics", ["packing operation", "cases are packed", "bizstep packing"]),
    ("initial_packing", "document_type", ["packinghouse", "packing log"]),
]
# --- Fixed values: families that count for every event type that has other evidence; and what takes all evidence away.
ANY_TYPE = [("lot_tlc", [" lot ", " tlc", " batch "]), ("date_field", [" date ", "eventtime=", "date you"]), ("product_quantity", [" quantity", " kgm", " pounds", " cases "])]
NO_EVIDENCE = ["correction record", "error declaration", "transporter registers", "carrier manifest", "internal transfer"]
METADATA = ["product metadata"]
METADATA_WITH_EVIDENCE = ["objectevent", "transformationevent", "shipping event", "receiving event"]
# --- Fixed values: phrases of the verifier.
VERIFIER = {
    "named_event": [
        "objectevent", "aggregationevent", "transformationevent", "transactionevent", "associationevent", "shipping event", "receiving event", "harvest event",
        "transformation event",
    ],
    "correction": [
        "correction record", "error declaration", "reverses prior", "prior event", "was incorrect", "incorrect event", "incorrect record", "credit memo",
        "credit note", " rma ", "rejected", "rejection", "disposal", "write-off", "write off",
    ],
    "transporter": ["transporter registers", "carrier registers", "carrier manifest", "freight bill", "3pl", "third-party logistics", "transport-only"],
    "internal": ["internal", "inside the same facility", "same facility"],
    "receiving": ["received", "receiving", "inbound", "unloaded", "acquired from supplier", "enters the distribution center", "recipient scans", "transportation for", "is terminated"],
    "strong_shipping": [
        "bizstep shipping", "pallet shipping", "outbound", "outgoing", "loaded to truck", "transported to", "transportation process",
        "between two supply-chain companies", "moves to external customer", "leaves warehouse", "to retail customer", "tracked to store", "future sales",
    ],
    "origin_to_retail": ["from point of origin to a retail location"],
    "weak_shipping": ["shipping", "shipped", "movement", "delivery note", "retail"],
    "not_shipping": [
        "incoming", "inbound", "supplier delivery note", "product metadata", "countries and retailers", "storage only", "with no movement", "without physical movement",
    ],
    "making": [
        "transformation", "transformed", "transforms", "manufactured", "manufactured, packed", "produced", "consumed", "processed into", "processing into", "repacked",
        "repacking", "blended", "blending", "mixed", "mixing", "cut into", "fresh-cut", "fresh cut", "recipe applied", "recipe transforms",
        "traces its ingredients", "production flow", "production:", "transformationevent",
    ],
    "lineage": [
        "input lot", "output lot", "out-", "new product", "new finished product", "finished product", "finished lot", "new form", "bulk material", "bottled",
        "ingredient batch", "input resource batch codes", "output product batch code", "input token", "output token", "source lots", "production flow",
        "manufactured in",
    ],
    "made_somewhere": ["manufactured in", "manufactured, packed"],
    "registration": ["product registration"],
    "harvest": ["harvest date", "harvested", "harvesting", "harvest event", "harvest lot", "harvest crew", "field harvest"],
    "packing": ["packing operation", "cases are packed", "packinghouse", "bizstep packing"],
    "lot_words": [" lot ", " tlc", " batch "],
}
FIELD_LOT = r"\bfield\b.{0,80}\blot\b"
FAMILIES = ["action_semantics", "actor_role", "from_to_movement", "document_type", "date_field", "lot_tlc", "reference_document", "product_quantity"]
LEAST_FAMILIES = 2
# --- Fixed values: patterns of event types in free text, in the order in which they are named.
CTE_PATTERNS = [
    ("traceability_plan", ["traceability plan"]),
    ("harvesting", [r"\bharvest", r"\bfarm harvest"]),
    ("cooling", [r"\bcool", r"\bhydrocool", r"\bforced air"]),
    ("initial_packing", [r"\binitial pack", r"\bpackinghouse", r"\bpack(s|ed)? .*for the first time"]),
    ("first_land_based_receiving", [r"\bfishing vessel", r"\bland(s|ed)? .*dock", r"\bfirst land"]),
    ("receiving", [r"\breceiv", r"\binbound"]),
    ("transformation", [r"\btransform", r"\bfresh-cut", r"\bchop", r"\bslic", r"\bsmok", r"\bgrind", r"\brepack", r"\brelabel", r"\bcommingl", r"\bmix"]),
    ("shipping", [r"\bship", r"\bsend(s|ing)? .*to", r"\boutbound", r"\bdistribution center", r"\bdistributor"]),
]

_TEXTS = "array<string>"


def groups() -> dict[str, tuple[list[str], bool]]:
    """Every group of phrases: its phrases, and whether the text's ends count as blanks for it."""
    out = {f"signal:{cte}:{family}": (phrases, True) for cte, family, phrases in SIGNALS}
    out |= {f"any:{family}": (phrases, True) for family, phrases in ANY_TYPE}
    out |= {"no_evidence": (NO_EVIDENCE, True), "metadata": (METADATA, True), "metadata_with_evidence": (METADATA_WITH_EVIDENCE, True)}
    return out | {name: (phrases, False) for name, phrases in VERIFIER.items()}


@functools.lru_cache(1)
def _automaton():
    import ahocorasick

    by_phrase: dict[str, list[tuple[str, bool]]] = {}
    for name, (phrases, ends) in groups().items():
        for phrase in phrases:
            by_phrase.setdefault(phrase, []).append((name, ends))
    found = ahocorasick.Automaton()
    for phrase, names in by_phrase.items():
        found.add_word(phrase, (len(phrase), names))
    found.make_automaton()
    return found


def found_groups(text: str | None) -> list[str]:
    """Names of the groups that have a phrase in the text, A-Z or not, in order of the names."""
    padded = f" {(text or '').lower()} "
    seen = set()
    for end, (size, names) in _automaton().iter(padded):
        inside = end - size >= 0 and end < len(padded) - 1
        seen.update(name for name, ends in names if ends or inside)
    return sorted(seen)


@F.pandas_udf(T.ArrayType(T.StringType()))
def evidence_groups(texts: pd.Series) -> pd.Series:
    return texts.map(found_groups)


def _array(*values: Column) -> Column:
    return F.array_compact(F.array(*values)).cast(_TEXTS)


def infer_ctes(text: Column) -> Column:
    """The event types whose patterns the text holds, the plan first. Null has none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return _array(*(F.when(lower.rlike("|".join(f"(?:{p})" for p in patterns)), cte) for cte, patterns in CTE_PATTERNS))


def verified_ctes(groups: Column, text: Column, origin_counts: bool = True) -> tuple[Column, Column]:
    """(event types, abstentions) that the verifier's rules give for what was found in a text.

    Metadata alone says nothing; corrections, transport by others and moves within a facility mean that shipping is to be abstained from. Shipping needs strong
    words, or weak ones without any that speak against it; transformation an action and a lineage. origin_counts: whether the way from its origin to
    a retail location is a strong word.
    """
    has = lambda name: F.array_contains(groups, name)
    silent = has("metadata") & ~has("named_event")
    barred = has("correction") | has("transporter") | has("internal")
    strong = has("strong_shipping") | has("origin_to_retail") if origin_counts else has("strong_shipping")
    field_lot = F.lower(F.coalesce(text, F.lit(""))).rlike(FIELD_LOT)
    rules = [
        ("harvesting", has("harvest") | field_lot),
        ("initial_packing", has("packing")),
        ("receiving", has("receiving")),
        ("shipping", strong | (has("weak_shipping") & ~has("not_shipping"))),
        ("transformation", (has("making") & has("lineage")) | (has("made_somewhere") & ~has("registration"))),
    ]
    none = F.array().cast(_TEXTS)
    found = F.when(silent | barred, none).otherwise(_array(*(F.when(rule, cte) for cte, rule in rules)))
    return found, F.when(~silent & barred, F.array(F.lit("shipping"))).otherwise(none)


def families_by_cte(groups: Column, verified: Column) -> Column:
    """An array of (cte, families), by name, of the event types that have evidence; a verified one has that of its action."""
    has = lambda name: F.array_contains(groups, name)
    nothing = (has("metadata") & ~has("metadata_with_evidence")) | has("no_evidence")
    entries = []
    for cte in sorted({cte for cte, *_ in SIGNALS}):
        own = _array(*(F.when(has(f"signal:{cte}:{family}"), family) for c, family, _ in SIGNALS if c == cte))
        common = _array(*(F.when(has(f"any:{family}"), family) for family, _ in ANY_TYPE))
        own = F.when(nothing | (F.size(own) == 0), F.array().cast(_TEXTS)).otherwise(F.array_union(own, common))
        by_rule = _array(F.lit("action_semantics"), F.when(has("lot_words"), "lot_tlc"))
        families = F.array_sort(F.when(F.array_contains(verified, cte), F.array_union(own, by_rule)).otherwise(own))
        entries.append(F.struct(F.lit(cte).alias("cte"), families.alias("families")))
    return F.filter(F.array(*entries), lambda e: F.size(e["families"]) > 0)


def route(records: DataFrame, text: str = "observed_text", abstain: str | None = None) -> DataFrame:
    """records with signals, candidate_ctes, auto_approved_ctes, review_routed_ctes and abstained_ctes.

    A verified event type with two families of evidence is approved, unless it is to be abstained from; every other one with evidence is
    routed to review. abstain: an array column of event types known beforehand to be abstained from. Null texts have no evidence.
    """
    rows = records.withColumn("_groups", evidence_groups(F.col(text)))
    verified, barred = verified_ctes(F.col("_groups"), F.col(text))
    known = F.coalesce(F.col(abstain), F.array().cast(_TEXTS)) if abstain else F.array().cast(_TEXTS)
    rows = rows.withColumns({"_verified": verified, "_barred": barred, "_known": known})
    rows = rows.withColumn("signals", families_by_cte(F.col("_groups"), F.col("_verified")))
    sure = lambda e: (
        F.array_contains("_verified", e["cte"]) & (F.size(e["families"]) >= LEAST_FAMILIES) & ~F.array_contains("_known", e["cte"]) & ~F.array_contains("_barred", e["cte"])
    )
    names = lambda a: F.transform(a, lambda e: e["cte"])
    rows = rows.withColumns({"candidate_ctes": names(F.col("signals")), "auto_approved_ctes": names(F.filter("signals", sure))})
    routed = F.array_except(F.array_except("candidate_ctes", "auto_approved_ctes"), "_barred")
    rows = rows.withColumns({"review_routed_ctes": routed, "abstained_ctes": F.array_sort(F.array_union("_known", "_barred"))})
    return rows.drop("_groups", "_verified", "_barred", "_known")


def judge_routing(routed: DataFrame, expected: str = "expected_ctes", abstentions: str = "expected_abstentions") -> DataFrame:
    """routed with errors and status: fail on an approval that wasn't expected or on an expected event type or abstention that is missing, else review_routed or pass."""
    none = F.array().cast(_TEXTS)
    want, refuse = F.coalesce(expected, none), F.coalesce(abstentions, none)
    errors = _array(
        F.when(F.size(F.array_except("auto_approved_ctes", want)) > 0, "auto_approved_false_positive"),
        F.when(F.size(F.array_except(want, F.array_union("auto_approved_ctes", "review_routed_ctes"))) > 0, "missed_candidate"),
        F.when(F.size(F.array_except(refuse, "abstained_ctes")) > 0, "missed_abstention"),
    )
    rows = routed.withColumn("errors", errors)
    return rows.withColumn("status", F.when(F.size("errors") > 0, "fail").when(F.size("review_routed_ctes") > 0, "review_routed").otherwise("pass"))
