"""Comparison of rows with a reference edition: gates, lexical rules, statuses.

A row meets its reference only through an aggregate of the reference by identifier, so
duplicate reference rows never multiply anything: none is missing, one is a match, more
are ambiguous and match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .index import dealt
from .structure import CODES, RAISED, listed, with_copies

OVERLAP = 0.65
LEAST_TOKENS = 3
TEACHING_PREFIX = "SYNTHETIC TRAINING TEXT"
#: What a reference row may bring beside its text and number.
EXTRA = {"verification_status": "string", "source_kind": "string", "allow_no_signal": "boolean", "language": "string", "source_url": "string"}
REFERENCE = "struct<" + ", ".join(f"{c}: {t}" for c, t in {"text": "string", "row_number": "long", **EXTRA}.items()) + ">"


def reference_by_id(reference: DataFrame) -> DataFrame:
    """One row for each valid identifier of keyed reference rows: how many there are, and the row if it is the only one.

    Trust is the engine's to give: only ``verification_status`` and ``allow_no_signal`` of
    the reference table are read, and a row may lower a verified source, never raise one.
    """
    given = [F.col(c) if c in reference.columns else F.lit(None).cast(t).alias(c) for c, t in EXTRA.items()]
    rows = reference.where("valid").select("id", "row_number", "text", *given)
    one = rows.groupBy("id").agg(
        F.count("*").alias("references"), F.array_sort(F.collect_list("row_number")).alias("reference_rows"),
        F.first(F.struct("text", "row_number", *EXTRA)).alias("r"),
    )
    only = F.when(F.col("references") == 1, F.col("r"))
    return one.select("id", "references", "reference_rows", only.alias("reference"))


def integrity(reference: DataFrame) -> DataFrame:
    """One row: invalid and empty reference rows, duplicated identifiers, usable ones."""
    by_id = reference.where("valid").groupBy("id").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    ids = by_id.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.count_if((F.col("n") == 1) & T.meaningful(F.col("text"))).alias("usable_ids"),
    )
    rows = reference.agg(
        F.count_if(~F.col("valid")).alias("invalid_rows"),
        F.count_if(F.col("valid") & ~T.meaningful(F.col("text"))).alias("empty_rows"),
    )
    return rows.join(ids, how="cross")  # one row each


def gated(rows: DataFrame, reference: DataFrame | None, candidate_language: str = "", reference_language: str = "", verified: bool = False, many: int | None = None) -> DataFrame:
    """Keyed rows with reference, comparison_status and comparison_reason.

    ``verified`` says that the engine verified the source as a whole. The reasons, in
    order: the row's own identifier, scope and text, its copies, then the reference's.
    Without a reference (None) it is missing for every row; rows with one meet it in ``many`` tasks.
    """
    out = rows if "copies" in rows.columns else with_copies(rows)
    own = (
        F.when(~F.col("valid"), "invalid_id").when(~F.col("in_scope"), "out_of_scope")
        .when(~T.meaningful(F.col("text")), "empty_text").when(F.col("copies") > 1, "duplicate_candidate")
    )
    if reference is None:
        # nothing to meet: no join, and literals that later steps fold
        given = {"references": "long", "reference_rows": "array<long>", "reference": REFERENCE}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in given.items()} | {"lexical": F.lit(False), "comparison_status": F.lit("abstain")})
        return out.withColumn("comparison_reason", F.coalesce(own, F.lit("missing_reference")))
    # rows without an identifier meet nothing: a key of their own spreads them
    key = F.coalesce("id", F.concat(F.lit("#"), F.col("input_index").cast("string")))
    known = reference_by_id(reference).withColumnRenamed("id", "__id")
    out = dealt(out.withColumn("__id", key), many, "__id").join(known, "__id", "left").drop("__id")
    differ = bool(candidate_language and reference_language and candidate_language != reference_language)
    r = F.col("reference")
    row_verified = F.coalesce(r["verification_status"], F.lit("verified")) != "unverified"
    teaching = (r["source_kind"] == "synthetic-teaching") & r["text"].startswith(TEACHING_PREFIX)
    trusted = F.lit(verified) & row_verified & F.coalesce((F.coalesce(r["allow_no_signal"], F.lit(True))) | teaching, F.lit(False))
    usable = F.coalesce(F.col("references") == 1, F.lit(False)) & T.meaningful(r["text"])
    theirs = (
        F.when(F.col("references") > 1, "ambiguous_reference").when(F.col("references") == 1, F.when(~usable, "empty_reference"))
        .otherwise("missing_reference")
    )
    out = out.withColumn("gate", F.coalesce(own, theirs))
    out = out.withColumn("reference", F.when(F.col("gate").isNull(), r))
    compared = F.col("gate").isNull() & F.lit(not differ)
    out = out.withColumn("lexical", compared)
    out = out.withColumn("comparison_status", F.when(compared & trusted, "compared").otherwise("abstain"))
    reason = F.coalesce(F.col("gate"), F.lit("language_mismatch") if differ else F.when(~trusted, "unverified_reference"))
    return out.withColumn("comparison_reason", reason).drop("gate")


def lexical(pairs: DataFrame, language: str = "") -> DataFrame:
    """Pairs (text, other) with the review of their tokens, negations and overlap, in the JVM.

    Adds negation counts and state, overlap, and added and removed tokens; a language
    without markers has the state "unsupported".
    """
    out = pairs.withColumn("a", T.token_values(F.col("text"))).withColumn("b", T.token_values(F.col("other")))
    out = out.withColumn("negations", T.negation_count(F.col("a"), language)).withColumn("other_negations", T.negation_count(F.col("b"), language))
    equal = F.col("a") == F.col("b")
    ours, theirs = F.col("negations"), F.col("other_negations")
    state = (
        F.when(ours.isNull(), "unsupported")
        .when(~equal & (ours > 0) & (theirs > 0) & (ours != theirs), "abstain")
        .when(~equal & ((ours > 0) != (theirs > 0)), "difference")
        .when((ours > 0) | (theirs > 0), "unchanged_count").otherwise("none")
    )
    out = out.withColumns({"negation_state": state, "__a": F.array_distinct("a"), "__b": F.array_distinct("b")})
    out = out.withColumns({"added": F.array_except("__a", "__b"), "removed": F.array_except("__b", "__a")})
    # all values are those of one side and what the other has besides
    every, shared = F.size("__a") + F.size("removed"), F.size("__b") - F.size("removed")
    out = out.withColumn("overlap", F.when(every == 0, F.lit(1.0)).otherwise(shared / every)).drop("__a", "__b")
    long_enough = (F.size("a") >= LEAST_TOKENS) | (F.size("b") >= LEAST_TOKENS)
    return out.withColumn("lexical_difference", ~equal & (F.col("overlap") < OVERLAP) & long_enough)


def _settled(state: str, schema: str):
    empty = [F.array().alias(c) for c in ("candidate", "reference", "reasons")]
    return F.struct(F.lit(state).alias("state"), *empty).cast(schema)


def reviewed(rows: DataFrame, language: str = "") -> DataFrame:
    """Gated rows with numeric_review, qualifier_review and the columns of ``lexical``.

    Texts without a comparison and texts equal to their reference never reach Python: the
    functions, which Catalyst evaluates eagerly, get nulls for them.
    """
    from ..functions.udfs import QUALIFIER_REVIEW, QUANTITY_REVIEW, qualifier_review, quantity_review

    base = T.language_base(F.lit(language))
    equal = F.coalesce(F.col("lexical"), F.lit(False))
    differs = F.coalesce(F.col("lexical") & (F.col("text") != F.col("reference.text")), F.lit(False))
    pair = [F.when(differs, F.col(c)) for c in ("text", "reference.text")]
    reviews = (("numeric_review", quantity_review, QUANTITY_REVIEW), ("qualifier_review", qualifier_review, QUALIFIER_REVIEW))
    settled = lambda schema: F.when(equal, _settled("unchanged", schema)).otherwise(_settled("not_compared", schema))
    out = rows.withColumns({name: F.when(differs, review(*pair, base)).otherwise(settled(schema)) for name, review, schema in reviews})
    out = lexical(out.withColumn("other", F.col("reference.text")), language).drop("other", "a", "b")
    unmet = ~F.coalesce(F.col("lexical"), F.lit(False))
    out = out.withColumn("negation_state", F.when(unmet, "not_compared").otherwise(F.col("negation_state")))
    out = out.withColumn("lexical_difference", F.coalesce(F.col("lexical_difference") & ~unmet, F.lit(False)))
    limited = language not in ("", "en", "ar")
    return out.withColumn("language_state", F.when(unmet, "not_compared").otherwise("abstain" if limited else "supported"))


def unreviewed(rows: DataFrame, language: str = "") -> DataFrame:
    """Gated rows without a reference, with the columns of ``reviewed``: nothing is compared, and who reads no counts of tokens pays for none."""
    from ..functions.udfs import QUALIFIER_REVIEW, QUANTITY_REVIEW

    none = F.lit("not_compared")
    out = rows.withColumns({"numeric_review": _settled("not_compared", QUANTITY_REVIEW), "qualifier_review": _settled("not_compared", QUALIFIER_REVIEW)})
    out = lexical(out.withColumn("other", F.lit(None).cast("string")), language).drop("other", "a", "b")
    return out.withColumns({"negation_state": none, "lexical_difference": F.lit(False), "language_state": none})


def row_comparison(rows: DataFrame, language: str = "") -> DataFrame:
    """Reviewed rows whose ``raised`` and ``codes`` hold the comparison's findings too, evidence ones included."""
    c = F.col
    issues = T.hygiene(c("reference.text"), F.coalesce(c("reference.language"), F.lit(language)))
    rows = rows.withColumn("__issues", F.when(c("reference").isNotNull(), issues))
    counts = {"negations": c("negations"), "reference_negations": c("other_negations")}
    both = lambda review: {"candidate": c(f"{review}.candidate"), "reference": c(f"{review}.reference")}
    num, qual, neg = c("numeric_review.state"), c("qualifier_review.state"), c("negation_state")
    found, codes = listed([
        ("ambiguous_reference", c("comparison_reason") == "ambiguous_reference", {"reference_rows": c("reference_rows")}),
        ("reference_text_hygiene", F.size("__issues") > 0, {"issues": c("__issues")}),
        ("language_rule_abstain", c("language_state") == "abstain", {"language": F.lit(language)}),
        ("numeric_comparison_abstain", num == "abstain", {"reasons": c("numeric_review.reasons")}),
        ("potential_numeric_change", num == "difference", both("numeric_review")),
        ("qualifier_comparison_abstain", qual == "abstain", {"reasons": c("qualifier_review.reasons")}),
        ("potential_qualifier_change", qual == "difference", both("qualifier_review")),
        ("negation_comparison_abstain", neg == "abstain", counts),
        ("potential_negation_change", neg == "difference", counts),
        ("lexical_difference", c("lexical_difference"), {"overlap": F.round(c("overlap").cast("decimal(20,10)"), 4), "added": c("added"), "removed": c("removed")}),
    ])
    have = {"raised": F.array().cast(RAISED), "codes": F.array().cast("array<string>")}
    have |= {name: c(name) for name in have if name in rows.columns}
    return rows.withColumns({"raised": F.concat(have["raised"], found), "codes": F.concat(have["codes"], codes)}).drop("__issues")


def statuses(rows: DataFrame) -> DataFrame:
    """Rows with their status: needs_review, abstain or no_signal, never an approval.

    What a row raises is in the row already, copies included, so no join is needed. Only the
    codes are read: who reads statuses alone pays for no evidence.
    """
    grave = F.array(*[F.lit(code) for code, (kind, _) in CODES.items() if kind in ("structural", "comparison")])
    hit = F.arrays_overlap("codes", grave) | (F.col("copies") > 1)
    states = [F.col("numeric_review.state"), F.col("qualifier_review.state"), F.col("negation_state"), F.col("language_state")]
    abstained = F.lit(False)
    for s in states:
        abstained = abstained | F.coalesce(s == "abstain", F.lit(False))
    status = F.when(hit, "needs_review").when((F.col("comparison_status") == "abstain") | abstained, "abstain").otherwise("no_signal")
    return rows.withColumn("status", status)
