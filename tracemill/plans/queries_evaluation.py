"""Event types from phrases, routing, and evaluation with drift, over texts that the shared event table gives rise to."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import evaluation as E
from tracemill.operators import phrases as P
from tracemill.plans.registry import register, table

#: Phrases from which texts are made: those of the families, of the verifier, and some of neither.
SAID = list(dict.fromkeys(p.strip() for phrases, _ in P.groups().values() for p in phrases)) + ["apples in a box", "fresh basil", "a field of the lot", "cooled by forced air", "traceability plan", "RMA", "lot", "TLC"]
LABELS = ["shipping", "receiving", "transformation", "harvesting", "initial_packing"]


def _lit(values):
    return F.array(*map(F.lit, values))


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def records(spark, d):
    """Every event with a text of three phrases chosen by its numbers, and what is expected of it."""
    key, user = F.col("event_id"), F.col("user_id")
    pick = lambda n: F.get(_lit(SAID), (n % len(SAID)).cast("int"))
    text = F.concat_ws(" ", pick(key), F.when(key % 3 > 0, pick(user * 7 + 3)), F.when(key % 7 == 0, pick(F.floor(key / 11))), F.when(key % 2 == 0, F.upper(F.lit("quantity 5 kgm"))))
    expected = F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(_lit(LABELS), (key % 5).cast("int"))))
    refuse = F.when(key % 10 == 0, F.array(F.lit("shipping"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select(
        key.alias("record_id"), F.col("event_type").alias("source_name"), F.when(key % 13 > 0, text).alias("observed_text"), expected.alias("expected_ctes"), refuse.alias("expected_abstentions")
    )


_S = _sql_list(SAID)
_RECORDS = f"""SELECT event_id AS record_id, event_type AS source_name, CASE WHEN event_id % 13 > 0 THEN array_to_string(list_filter([({_S})[event_id % {len(SAID)} + 1],
    CASE WHEN event_id % 3 > 0 THEN ({_S})[(user_id * 7 + 3) % {len(SAID)} + 1] END, CASE WHEN event_id % 7 = 0 THEN ({_S})[(event_id // 11) % {len(SAID)} + 1] END,
    CASE WHEN event_id % 2 = 0 THEN 'QUANTITY 5 KGM' END], lambda p: p IS NOT NULL), ' ') END AS observed_text,
  CASE WHEN event_id % 4 = 0 THEN [] ELSE [({_sql_list(LABELS)})[event_id % 5 + 1]] END AS expected_ctes, CASE WHEN event_id % 10 = 0 THEN ['shipping'] ELSE [] END AS expected_abstentions FROM events"""


def _has(*names):
    """SQL: the text has a phrase of one of the groups; `low` is the text in lower case, `wide` the same between blanks."""
    known = P.groups()
    return "(" + " OR ".join(f"contains({'wide' if known[n][1] else 'low'}, '{p}')" for n in names for p in known[n][0]) + ")"


_BARRED = _has("correction", "transporter", "internal")
_SILENT = f"({_has('metadata')} AND NOT {_has('named_event')})"


def _verified(strong):
    rules = {
        "harvesting": rf"({_has('harvest')} OR regexp_matches(low, '{P.FIELD_LOT}'))",
        "initial_packing": _has("packing"),
        "receiving": _has("receiving"),
        "shipping": f"({_has(*strong)} OR ({_has('weak_shipping')} AND NOT {_has('not_shipping')}))",
        "transformation": f"(({_has('making')} AND {_has('lineage')}) OR ({_has('made_somewhere')} AND NOT {_has('registration')}))",
    }
    cases = ", ".join(f"CASE WHEN {rule} THEN '{cte}' END" for cte, rule in rules.items())
    return f"CASE WHEN {_SILENT} OR {_BARRED} THEN [] ELSE list_filter([{cases}], lambda c: c IS NOT NULL) END"


_LOW = f"SELECT *, lower(coalesce(observed_text, '')) AS low, ' ' || lower(coalesce(observed_text, '')) || ' ' AS wide FROM ({_RECORDS})"
_REFUSED = f"CASE WHEN NOT {_SILENT} AND {_BARRED} THEN ['shipping'] ELSE [] END"


@register(
    "F22_regex_inference",
    f"SELECT record_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(low, $${'|'.join(f'(?:{x})' for x in patterns)}$$) THEN {chr(39)}{cte}{chr(39)} END' for cte, patterns in P.CTE_PATTERNS)}], lambda c: c IS NOT NULL), ',') AS ctes FROM ({_LOW})",
)
def infer_ctes(spark, d):
    return records(spark, d).select("record_id", F.array_join(P.infer_ctes(F.col("observed_text")), ",").alias("ctes"))


def _families_sql():
    nothing = f"(({_has('metadata')} AND NOT {_has('metadata_with_evidence')}) OR {_has('no_evidence')})"
    out = []
    for cte in sorted({c for c, *_ in P.SIGNALS}):
        own = [f for c, f, _ in P.SIGNALS if c == cte]
        some = f"(NOT {nothing} AND {_has(*(f'signal:{cte}:{f}' for f in own))})"
        by_rule = f"list_contains(verified, '{cte}')"
        cases = [f"CASE WHEN {some} AND {_has(f'signal:{cte}:{f}')} THEN '{f}' END" for f in own]
        cases += [f"CASE WHEN {some} AND {_has(f'any:{f}')} THEN '{f}' END" for f, _ in P.ANY_TYPE]
        cases += [f"CASE WHEN {by_rule} THEN 'action_semantics' END", f"CASE WHEN {by_rule} AND {_has('lot_words')} THEN 'lot_tlc' END"]
        out.append(f"struct_pack(cte := '{cte}', families := list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda f: f IS NOT NULL))))")
    return f"list_filter([{', '.join(out)}], lambda e: len(e.families) > 0)"


_SIGNALLED = f"""SELECT *, {_families_sql()} AS signals FROM (SELECT *, {_verified(("strong_shipping", "origin_to_retail"))} AS verified, {_REFUSED} AS barred FROM ({_LOW}))"""


@register(
    "F23_signal_families",
    f"SELECT record_id, array_to_string(list_transform(signals, lambda e: e.cte || ':' || array_to_string(e.families, '+')), ' ') AS signals, array_to_string(verified, ',') AS verified, array_to_string(barred, ',') AS barred FROM ({_SIGNALLED})",
)
def signal_families(spark, d):
    rows = records(spark, d).withColumn("g", P.evidence_groups("observed_text"))
    verified, barred = P.verified_ctes(F.col("g"), F.col("observed_text"))
    rows = rows.withColumns({"verified": verified, "barred": barred})
    said = F.transform(P.families_by_cte(F.col("g"), F.col("verified")), lambda e: F.concat(e["cte"], F.lit(":"), F.array_join(e["families"], "+")))
    return rows.select("record_id", F.array_join(said, " ").alias("signals"), F.array_join("verified", ",").alias("verified"), F.array_join("barred", ",").alias("barred"))


_ROUTED = f"""SELECT *, list_filter(candidate, lambda c: NOT list_contains(auto, c) AND NOT list_contains(barred, c)) AS routed FROM (
  SELECT *, list_transform(signals, lambda e: e.cte) AS candidate, list_sort(list_distinct(list_concat(expected_abstentions, barred))) AS abstained,
    list_transform(list_filter(signals, lambda e: list_contains(verified, e.cte) AND len(e.families) >= 2 AND NOT list_contains(expected_abstentions, e.cte) AND NOT list_contains(barred, e.cte)), lambda e: e.cte) AS auto FROM ({_SIGNALLED}))"""


@register(
    "C23_two_stage_routing",
    f"""SELECT record_id, array_to_string(candidate, ',') AS candidates, array_to_string(auto, ',') AS approved, array_to_string(routed, ',') AS routed, array_to_string(abstained, ',') AS abstained,
          CASE WHEN errors <> '' THEN 'fail' WHEN len(routed) > 0 THEN 'review_routed' ELSE 'pass' END AS status, errors FROM (
          SELECT *, array_to_string(list_filter([CASE WHEN len(list_filter(auto, lambda c: NOT list_contains(expected_ctes, c))) > 0 THEN 'auto_approved_false_positive' END,
            CASE WHEN len(list_filter(expected_ctes, lambda c: NOT list_contains(auto, c) AND NOT list_contains(routed, c))) > 0 THEN 'missed_candidate' END,
            CASE WHEN len(list_filter(expected_abstentions, lambda c: NOT list_contains(abstained, c))) > 0 THEN 'missed_abstention' END], lambda e: e IS NOT NULL), ',') AS errors FROM ({_ROUTED}))""",
)
def two_stage_routing(spark, d):
    found = P.judge_routing(P.route(records(spark, d), abstain="expected_abstentions"))
    names = {"candidates": "candidate_ctes", "approved": "auto_approved_ctes", "routed": "review_routed_ctes", "abstained": "abstained_ctes", "errors": "errors"}
    return found.select("record_id", "status", *(F.array_join(c, ",").alias(n) for n, c in names.items()))


def predictor(text):
    return P.verified_ctes(P.evidence_groups(text), text, origin_counts=False)


_EVALUATED = f"""SELECT *, len(list_filter(p, lambda c: list_contains(expected_ctes, c))) AS hit, list_filter([CASE WHEN len(list_filter(p, lambda c: NOT list_contains(expected_ctes, c))) > 0 THEN 'over_triggered_cte' END,
    CASE WHEN len(list_filter(expected_ctes, lambda c: NOT list_contains(p, c))) > 0 THEN 'missed_cte' END, CASE WHEN len(list_filter(expected_abstentions, lambda c: NOT list_contains(a, c))) > 0 THEN 'missing_abstention' END,
    CASE WHEN len(list_filter(a, lambda c: NOT list_contains(expected_abstentions, c))) > 0 THEN 'unexpected_abstention' END], lambda e: e IS NOT NULL) AS errors
  FROM (SELECT *, {_verified(("strong_shipping",))} AS p, {_REFUSED} AS a FROM ({_LOW}))"""


def _ratio_sql(part, whole, empty):
    return f"CASE WHEN {whole} = 0 THEN {empty} ELSE ((20000 * ({part}) + ({whole})) // (2 * ({whole}))) / 10000.0 END"


_SUMS = f"""SELECT source_name, count(*) AS record_count, count(*) FILTER (WHERE len(errors) = 0) AS pass_count, sum(hit)::BIGINT AS tp, sum(len(p) - hit)::BIGINT AS fp, sum(len(expected_ctes) - hit)::BIGINT AS fn,
    count(*) FILTER (WHERE len(a) > 0) AS abstained_count, count(*) FILTER (WHERE len(expected_abstentions) > 0 AND len(a) > 0) AS right_abstentions, count(*) FILTER (WHERE len(expected_abstentions) > 0) AS due_abstentions
  FROM ({_EVALUATED}) GROUP BY source_name"""


@register(
    "X21_evaluation_scores",
    f"""SELECT *, {_ratio_sql('pass_count', 'record_count', '0.0')} AS exact_match_rate, {_ratio_sql('tp', '(tp + fp)', '1.0')} AS precision, {_ratio_sql('tp', '(tp + fn)', '1.0')} AS recall,
          {_ratio_sql('fp', '(tp + fp)', '0.0')} AS false_positive_rate, {_ratio_sql('fn', '(tp + fn)', '0.0')} AS false_negative_rate, {_ratio_sql('abstained_count', 'record_count', '0.0')} AS abstention_rate,
          {_ratio_sql('right_abstentions', 'due_abstentions', '1.0')} AS abstention_recall FROM ({_SUMS})""",
)
def evaluation_scores(spark, d):
    return E.scores(E.evaluate(records(spark, d), predictor), ["source_name"])


@register(
    "X21_scores_by_label",
    f"""SELECT *, {_ratio_sql('tp', '(tp + fp)', '1.0')} AS precision, {_ratio_sql('tp', '(tp + fn)', '1.0')} AS recall FROM (
          SELECT cte, count(*) FILTER (WHERE due AND said) AS tp, count(*) FILTER (WHERE NOT due AND said) AS fp, count(*) FILTER (WHERE due AND NOT said) AS fn FROM (
            SELECT cte, list_contains(expected_ctes, cte) AS due, list_contains(p, cte) AS said FROM (SELECT *, unnest(list_distinct(list_concat(expected_ctes, p))) AS cte FROM ({_EVALUATED}))) GROUP BY cte)""",
)
def scores_by_label(spark, d):
    return E.scores_by_label(E.evaluate(records(spark, d), predictor), [])


@register("X21_error_classes", f"SELECT source_name, error, count(*) AS n FROM (SELECT source_name, unnest(errors) AS error FROM ({_EVALUATED})) GROUP BY source_name, error")
def error_classes(spark, d):
    return E.error_counts(E.evaluate(records(spark, d), predictor), ["source_name"])


_MEASURED = """SELECT lang AS input, 'documents' AS measure, count(*)::DOUBLE AS value, NULL AS hash FROM documents WHERE {0} GROUP BY lang
  UNION ALL SELECT lang, 'chars', sum(n_chars)::DOUBLE, NULL FROM documents WHERE {0} GROUP BY lang UNION ALL SELECT lang, 'sources', NULL, sha256(string_agg(DISTINCT source, ',' ORDER BY source)) FROM documents WHERE {0} GROUP BY lang"""
_BEFORE = "doc_id % 20 <> 0 AND NOT (lang = 'es' AND source = 'src1') AND lang <> 'fr'"


@register(
    "X19_drift_monitor",
    f"""SELECT coalesce(b.input, c.input) AS input, coalesce(b.measure, c.measure) AS measure, b.value AS before, c.value AS now, change, change NOT IN ('stable', 'within') AS alert,
          CASE WHEN change IN ('stable', 'within') THEN '' WHEN coalesce(b.measure, c.measure) = 'sources' THEN 'benchmark,unseen' ELSE 'unseen' END AS rerun
        FROM ({_MEASURED.format(_BEFORE)}) b FULL JOIN ({_MEASURED.format("true")}) c ON b.input = c.input AND b.measure = c.measure,
        LATERAL (SELECT CASE WHEN b.input IS NULL THEN 'created' WHEN c.input IS NULL THEN 'removed' WHEN b.value IS NOT DISTINCT FROM c.value AND b.hash IS NOT DISTINCT FROM c.hash THEN 'stable'
          WHEN coalesce(b.measure, c.measure) = 'documents' AND abs(c.value - b.value) <= 0.12 * abs(b.value) THEN 'within' WHEN coalesce(b.measure, c.measure) = 'chars' AND abs(c.value - b.value) <= 5000 THEN 'within' ELSE 'drifted' END AS change)""",
)
def drift_monitor(spark, d):
    """Counts and a hash of each language's documents against a baseline from which some are missing."""
    docs = table(spark, d, "documents")

    def measured(rows):
        sums = rows.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("n_chars").cast("double").alias("chars"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))  # a few sources
        row = lambda name, value, digest: F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"), digest.cast("string").alias("hash"))
        none = F.lit(None)
        digest = F.sha2(F.col("sources").cast("binary"), 256)
        return sums.select(F.col("lang").alias("input"), F.inline(F.array(row("documents", F.col("n"), none), row("chars", F.col("chars"), none), row("sources", none, digest))))

    rules = [("documents", "relative", 0.12, ["unseen"]), ("chars", "absolute", 5000.0, ["unseen"]), ("sources", "hash", None, ["benchmark", "unseen"])]
    rules = spark.createDataFrame(rules, "measure string, kind string, most double, suites array<string>")
    before = docs.filter("doc_id % 20 <> 0 and not (lang = 'es' and source = 'src1') and lang <> 'fr'")
    return E.drift(measured(docs), measured(before), rules).select("input", "measure", "before", "now", "change", "alert", F.array_join("rerun", ",").alias("rerun"))


TEMPLATES = [
    {"text": "{food} in cases, outbound to retail customer by {brand}", "expected_ctes": ["shipping"]},
    {"text": "{brand} received {food} from supplier", "expected_ctes": ["receiving"]},
    {"text": "Credit memo for {food}", "expected_abstentions": ["shipping"]},
    {"text": "Recipe transforms input lot of {food} into a new product", "expected_ctes": ["transformation"]},
]
_TEMPLATES = "[" + ", ".join(f"struct_pack(t := '{t['text']}', e := {_sql_list(t.get('expected_ctes', []))}::VARCHAR[], a := {_sql_list(t.get('expected_abstentions', []))}::VARCHAR[])" for t in TEMPLATES) + "]"


def expanded(spark, d):
    """Every part in every template."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("food"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("brand"))
    return E.expand_templates(parts, TEMPLATES, "n", ["food", "brand"])


_CASES = f"""SELECT n * 4 + i AS case_id, (i - 1)::INTEGER AS template, replace(replace(s.t, '{{food}}', food), '{{brand}}', brand) AS observed_text, s.e AS expected_ctes, s.a AS expected_abstentions
  FROM (SELECT p_partkey AS n, coalesce(p_name, '') AS food, CASE WHEN p_size > 5 THEN p_brand ELSE '' END AS brand, unnest({_TEMPLATES}) AS s, generate_subscripts({_TEMPLATES}, 1) AS i FROM part)"""


@register("X18_scenario_generator", f"SELECT case_id, template, array_to_string(expected_ctes, ',') AS expected, array_to_string(expected_abstentions, ',') AS abstain FROM ({_CASES})")
def scenario_generator(spark, d):
    return expanded(spark, d).select("case_id", "template", F.array_join("expected_ctes", ",").alias("expected"), F.array_join("expected_abstentions", ",").alias("abstain"))


@register("X40_template_rows", f"SELECT case_id AS id, observed_text AS text FROM ({_CASES})")
def template_rows(spark, d):
    return expanded(spark, d).select(F.col("case_id").alias("id"), F.col("observed_text").alias("text"))


@register("X40_template_scores", "SELECT i::INTEGER AS template, n AS record_count, n AS pass_count FROM (SELECT count(*) AS n FROM part), range(4) t(i)")
def template_scores(spark, d):
    """The predictor over all expanded cases, by template: every one is right."""
    return E.scores(E.evaluate(expanded(spark, d), predictor), ["template"]).select("template", "record_count", "pass_count")
