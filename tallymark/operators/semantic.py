"""Scores of models as data: cosine similarity, entailment probabilities, their classification.

Models run elsewhere; their scores enter as tables. A score is never an approval and never
lifts an abstention of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DISTANCE = 0.8
# Thresholds of the entailment classes, uncalibrated, and the tolerance of a probability sum.
CONTRADICTION, ENTAILMENT, GAP, LOW_ENTAILMENT, TOLERANCE = 0.65, 0.55, 0.45, 0.30, 0.001
LABELS = ("contradiction", "entailment", "neutral")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; 0 if a vector is zero; null for empty, unequal or null vectors."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    product = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) * total(F.transform(b, lambda x: x.cast("double") * x.cast("double")))
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), product / F.sqrt(norms)))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.when(norms > 0, bounded).otherwise(0.0))


def eligible(rows: DataFrame, unverified: bool = False) -> DataFrame:
    """Gated rows that a model may compare: a reference, another text, one row of their key."""
    fine = F.col("comparison_status") == "compared"
    if unverified:
        fine = fine | (F.col("comparison_reason") == "unverified_reference")
    once = F.count("*").over(Window.partitionBy("file_id", "row_number")) == 1
    rows = rows.withColumn("__once", once)
    keep = fine & F.col("__once") & T.meaningful(F.col("text")) & T.meaningful(F.col("reference.text"))
    return rows.where(keep & (F.col("text") != F.col("reference.text"))).drop("__once")


def first_results(results: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Results of eligible rows only, the first of each key."""
    once = Window.partitionBy(*key).orderBy(order)
    return results.join(rows.select(*key).distinct(), key, "left_semi").withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")


def distances(results: DataFrame, threshold: float = DISTANCE) -> DataFrame:
    """Results (similarity, truncated) that deserve a look, with their code; invalid scores are dropped."""
    fine = results.where(F.col("similarity").isNotNull() & ~F.isnan("similarity") & F.col("similarity").between(-1, 1))
    told = fine.where((F.col("similarity") < threshold) | F.col("truncated"))
    return told.withColumn("code", F.when(F.col("truncated"), "semantic_input_truncated").otherwise("semantic_distance"))


def softmax(logits: Column, labels: list[str]) -> Column:
    """struct(contradiction, entailment, neutral) of three logits in the order of the given labels; null unless all are finite."""
    if sorted(labels) != sorted(LABELS):
        raise ValueError("labels must be contradiction, entailment and neutral in some order")
    top = F.array_max(logits)
    powers = [F.exp(F.get(logits, i).cast("double") - top) for i in range(3)]
    total = powers[0] + powers[1] + powers[2]
    fine = (F.size(logits) == 3) & ~F.exists(logits, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(fine, F.struct(*[(powers[labels.index(x)] / total).alias(x) for x in LABELS]))


def both_ways(forward: Column, reverse: Column) -> Column:
    """struct(contradiction, entailment, neutral, gap) of two directions; null if either isn't a distribution."""
    def sound(d: Column) -> Column:
        total = sum((d[x] for x in LABELS), F.lit(0.0))
        inside = [d[x].between(0, 1) for x in LABELS]
        return d.isNotNull() & inside[0] & inside[1] & inside[2] & (F.abs(total - 1) <= TOLERANCE)

    return F.when(
        sound(forward) & sound(reverse),
        F.struct(
            F.greatest(forward["contradiction"], reverse["contradiction"]).alias("contradiction"),
            F.least(forward["entailment"], reverse["entailment"]).alias("entailment"),
            F.greatest(forward["neutral"], reverse["neutral"]).alias("neutral"),
            F.abs(forward["entailment"] - reverse["entailment"]).alias("gap"),
        ),
    )


def classified(scores: Column, truncated: Column) -> Column:
    """struct(outcome, reason): risk, no_signal or abstain, in a fixed order of tests."""
    risk, calm, none = F.lit("risk"), F.lit("no_signal"), F.lit("abstain")
    tests = [
        (scores.isNull(), none, "invalid_or_missing_result"),
        (truncated, none, "input_truncated"),
        (scores["contradiction"] >= CONTRADICTION, risk, "potential_contextual_contradiction"),
        ((scores["gap"] >= GAP) & (scores["entailment"] < LOW_ENTAILMENT), risk, "potential_information_change"),
        (scores["entailment"] >= ENTAILMENT, calm, "no_context_signal_at_experimental_threshold"),
    ]
    out = F.struct(none.alias("outcome"), F.lit("insufficient_context_or_model_confidence").alias("reason"))
    for test, outcome, reason in reversed(tests):
        out = F.when(test, F.struct(outcome.alias("outcome"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def confusion(cases: DataFrame) -> DataFrame:
    """Counts and rates by type and in all (type null): cases (type, expected_risk, predicted, has_result).

    ``predicted`` is an outcome. An abstention on a risk counts as missed; a safe case
    without a result counts as nothing. Rates without a denominator are null.
    """
    expected, result = F.col("expected_risk"), F.col("has_result")
    risk, abstains = F.col("predicted") == "risk", F.col("predicted") == "abstain"
    counts = cases.rollup("type").agg(
        F.grouping("type").alias("in_all"), F.count("*").alias("cases"),
        F.count_if(expected & risk).alias("tp"), F.count_if(~expected & result & risk).alias("fp"),
        F.count_if(expected & ~risk).alias("fn"), F.count_if(~expected & result & ~risk).alias("tn"),
        F.count_if(expected.isNotNull() & result & abstains).alias("known_abstentions"),
        F.count_if(expected & result & abstains).alias("risk_abstentions"),
        F.count_if(expected.isNull()).alias("unknown"), F.count_if(expected.isNull() & result & abstains).alias("unknown_abstentions"),
        F.count_if(~result).alias("missing"),
    )

    def rate(over: Column, under: Column) -> Column:
        return F.try_divide(over.cast("double"), under.cast("double"))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("precision", rate(tp, tp + fp)).withColumn("recall", rate(tp, tp + fn)).withColumn("f1", rate(2 * tp, 2 * tp + fp + fn))
        .withColumn("specificity", rate(tn, tn + fp)).withColumn("abstention_rate", rate(F.col("known_abstentions"), tp + fp + fn + tn))
    )


def with_context(rows: DataFrame, findings: DataFrame, results: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """Rows and findings with entailment results (file_id, row_number, seq, forward, reverse, truncated) taken in.

    Earlier context findings are replaced. Pairs outside their language's script are
    blocked and abstain; of repeated results the first counts.
    """
    from .structure import finding

    key = ["file_id", "row_number"]
    pairs = eligible(rows, unverified=True)
    gate = F.struct(T.script_gate(F.col("text"), F.lit(language))["compatible"].alias("a"), T.script_gate(F.col("reference.text"), F.lit(language))["compatible"].alias("b"))
    pairs = pairs.withColumn("__fits", gate["a"] & gate["b"])
    scored = first_results(results, pairs.where("__fits"), key, "seq")
    scored = scored.withColumn("scores", both_ways(F.col("forward"), F.col("reverse"))).where("scores IS NOT NULL")
    scored = scored.withColumn("class", classified(F.col("scores"), F.col("truncated"))).select(*key, "scores", "class")
    blocked = pairs.where("NOT __fits").select(*key).withColumn("__blocked", F.lit(True))
    fits = pairs.where("__fits").select(*key).withColumn("__eligible", F.lit(True))
    out = rows.join(scored, key, "left").join(blocked, key, "left").join(fits, key, "left")
    status = (
        F.when(F.col("__blocked"), "abstain").when(F.col("class").isNotNull(), F.col("class.outcome"))
        .when(F.col("__eligible"), "not_processed").otherwise("not_eligible")
    )
    out = out.withColumn("context_status", status)
    reason = F.col("class.reason")
    evidence = {"scores": F.col("scores"), "outcome": F.col("class.outcome"), "reason": reason}
    kept = findings.where("code NOT LIKE 'context\\\\_%'")
    for code, which in (
        ("context_contradiction", reason == "potential_contextual_contradiction"), ("context_information_change", reason == "potential_information_change"),
        ("context_input_truncated", reason == "input_truncated"), ("context_uncertain", reason == "insufficient_context_or_model_confidence"),
    ):
        kept = kept.unionByName(finding(out.where(which), code, evidence))
    kept = kept.unionByName(finding(out.where("__blocked"), "context_language_mismatch", {"language": F.lit(language)}))
    raised = (F.col("context_status") == "risk") | (reason == "input_truncated")
    status = (
        F.when(F.col("status") == "needs_review", "needs_review").when(raised, "needs_review")
        .when((F.col("context_status") == "abstain") & (F.col("status") == "no_signal"), "abstain").otherwise(F.col("status"))
    )
    return out.withColumn("status", status).drop("__blocked", "__eligible"), kept
