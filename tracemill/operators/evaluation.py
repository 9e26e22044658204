"""Evaluation of predictors over labelled cases: errors, scores by stratum and by label, and drift against a stored baseline.

A predictor is a function of the text column, so what is expected can't reach it. Every score is a sum that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scalars import ratio

Predictor = Callable[[Column], tuple[Column, Column]]
_TEXTS = "array<string>"
# --- Fixed values: classes of error.
ERRORS = ["over_triggered_cte", "missed_cte", "missing_abstention", "unexpected_abstention"]


def expand_templates(contexts: DataFrame, templates: list[dict], number: str, names: list[str], text: str = "observed_text") -> DataFrame:
    """Cases of every context by every template: case_id, template (from 0), the text with {name} filled in, and what the template expects.

    contexts: a number from 0 and columns that the texts name. templates: text, expected_ctes, expected_abstentions. Ids count templates within contexts, from 1, so that a case keeps its id when contexts are added. Templates are a short list in each row's expression; nothing is joined.
    A null value leaves its place empty.
    """
    labels = lambda found: F.array(*map(F.lit, found or ())).cast(_TEXTS)

    def filled(template: str) -> Column:
        out = F.lit(template)
        for name in names:
            out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
        return out

    made = F.array(*(F.struct(filled(t["text"]).alias(text), labels(t.get("expected_ctes")).alias("expected_ctes"), labels(t.get("expected_abstentions")).alias("expected_abstentions")) for t in templates))
    rows = contexts.select("*", F.posexplode(made).alias("template", "_case"))
    return rows.withColumn("case_id", F.col(number) * len(templates) + F.col("template") + 1).select(*contexts.columns, "case_id", "template", "_case.*")


def evaluate(cases: DataFrame, predict: Predictor, text: str = "observed_text") -> DataFrame:
    """cases (expected_ctes, expected_abstentions, ...) with predicted_ctes, predicted_abstentions, errors in the order of ERRORS, and status.

    Null arrays are empty, and repeated or unordered labels don't matter.
    """
    none = F.array().cast(_TEXTS)
    found, refused = predict(F.col(text))
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    rows = cases.withColumns({"predicted_ctes": tidy(found), "predicted_abstentions": tidy(refused), "expected_ctes": tidy("expected_ctes"), "expected_abstentions": tidy("expected_abstentions")})
    more = lambda a, b: F.size(F.array_except(a, b)) > 0
    kinds = [more("predicted_ctes", "expected_ctes"), more("expected_ctes", "predicted_ctes"), more("expected_abstentions", "predicted_abstentions"), more("predicted_abstentions", "expected_abstentions")]
    rows = rows.withColumn("errors", F.array_compact(F.array(*(F.when(k, name) for k, name in zip(kinds, ERRORS, strict=True)))))
    return rows.withColumn("status", F.when(F.size("errors") == 0, "pass").otherwise("fail"))


def scores(results: DataFrame, strata: list[str]) -> DataFrame:
    """A row for each stratum (one in all without strata): counts, exact match, precision, recall, their complements and abstention rates."""
    hit, said, wanted = F.size(F.array_intersect("predicted_ctes", "expected_ctes")), F.size("predicted_ctes"), F.size("expected_ctes")
    refused, to_refuse = F.size("predicted_abstentions"), F.size("expected_abstentions")
    sums = results.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if(F.col("status") == "pass").alias("pass_count"), F.coalesce(F.sum(hit), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(said - hit), F.lit(0)).alias("fp"), F.coalesce(F.sum(wanted - hit), F.lit(0)).alias("fn"), F.count_if(refused > 0).alias("abstained_count"),
        F.count_if((to_refuse > 0) & (F.size(F.array_except("expected_abstentions", "predicted_abstentions")) == 0)).alias("right_abstentions"), F.count_if(to_refuse > 0).alias("due_abstentions"),
    )
    return sums.withColumns(
        {
            "exact_match_rate": ratio("pass_count", "record_count"),
            "precision": ratio("tp", F.col("tp") + F.col("fp"), 1.0),
            "recall": ratio("tp", F.col("tp") + F.col("fn"), 1.0),
            "false_positive_rate": ratio("fp", F.col("tp") + F.col("fp")),
            "false_negative_rate": ratio("fn", F.col("tp") + F.col("fn")),
            "abstention_rate": ratio("abstained_count", "record_count"),
            "abstention_recall": ratio("right_abstentions", "due_abstentions", 1.0),
        }
    )


def scores_by_label(results: DataFrame, strata: list[str]) -> DataFrame:
    """(strata, cte, tp, fp, fn, precision, recall) of every event type that was expected or predicted."""
    rows = results.select(*strata, F.explode(F.array_union("expected_ctes", "predicted_ctes")).alias("cte"), F.col("expected_ctes").alias("_e"), F.col("predicted_ctes").alias("_p"))
    due, said = F.array_contains("_e", F.col("cte")), F.array_contains("_p", F.col("cte"))
    sums = rows.groupBy(*strata, "cte").agg(F.count_if(due & said).alias("tp"), F.count_if(~due & said).alias("fp"), F.count_if(due & ~said).alias("fn"))
    return sums.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp"), 1.0), "recall": ratio("tp", F.col("tp") + F.col("fn"), 1.0)})


def error_counts(results: DataFrame, strata: list[str]) -> DataFrame:
    return results.select(*strata, F.explode("errors").alias("error")).groupBy(*strata, "error").agg(F.count(F.lit(1)).alias("n"))


def drift(current: DataFrame, baseline: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each monitored (input, measure): before, now, change, whether it is an alert, and the suites to run again.

    current, baseline: input, measure, value (a number) or hash (a string). rules: measure, kind (hash, relative or absolute), most, suites. A hash drifts when it differs, a number when it is off by more
    than `most` (relative: of the baseline). What is new or gone is an alert, too, as is a measure that has no rule and differs. Keys are unique in each table; nulls in keys match nothing.
    """
    b = baseline.select("input", "measure", F.col("value").alias("before"), F.col("hash").alias("hash_before"), F.lit(True).alias("_was"))
    c = current.select("input", "measure", F.col("value").alias("now"), F.col("hash").alias("hash_now"), F.lit(True).alias("_is"))
    rows = b.join(c, ["input", "measure"], "full_outer").join(rules.select("measure", "kind", "most", "suites"), "measure", "left")
    off = F.abs(F.col("now") - F.col("before"))
    same = F.col("now").eqNullSafe(F.col("before")) & F.col("hash_now").eqNullSafe(F.col("hash_before"))
    within = F.when(F.col("kind") == "relative", off <= F.col("most") * F.abs("before")).when(F.col("kind") == "absolute", off <= F.col("most")).otherwise(same)
    change = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "removed").when(same, "stable").when(F.coalesce(within, F.lit(False)), "within").otherwise("drifted")
    rows = rows.withColumn("change", change).withColumn("alert", ~F.col("change").isin("stable", "within"))
    return rows.select("input", "measure", "before", "now", "hash_before", "hash_now", "change", "alert", F.when(F.col("alert"), F.coalesce("suites", F.array().cast(_TEXTS))).otherwise(F.array().cast(_TEXTS)).alias("rerun"))


def publication_gate(drifted: DataFrame, results: DataFrame, approved: bool) -> DataFrame:
    """One row: stable or needs_review by the results, passes, alerts, suites to run again, and the gate: pass only if stable, approved and without alerts."""
    passes = results.agg(F.count(F.lit(1)).alias("record_count"), F.count_if(F.col("status") == "pass").alias("pass_count"))
    alerts = drifted.agg(F.count_if("alert").alias("alerts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("rerun")))).alias("rerun"))  # a few suites in all
    rows = passes.crossJoin(alerts)  # one row each
    rows = rows.withColumn("status", F.when(F.col("pass_count") == F.col("record_count"), "stable").otherwise("needs_review"))
    gate = (F.col("status") == "stable") & (F.col("alerts") == 0) & F.lit(approved)
    return rows.withColumn("publication_gate", F.when(gate, "pass").otherwise("blocked"))
