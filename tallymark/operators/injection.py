"""Known defects put into sound files, and which of them an audit tells: choice without replacement, injection, detection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .index import identifier
from .intervals import joined
from .ranks import ranked

_TEXT = ("potential_negation_change", "lexical_difference")
#: Kinds of defects and the codes that tell them. Those of a text come with their variants.
STRUCTURAL = {
    "missing_row": ("missing_ids",), "duplicate_row": ("duplicate_id",), "swapped_rows": ("out_of_order",),
    "invalid_id": ("invalid_id",), "emptied_text": ("empty_text",), "merged_rows": ("suspected_merged_range",),
}
TEXTUAL = {
    "negation_removed": _TEXT, "negation_added": _TEXT, "word_to_negation": _TEXT, "critical_word": _TEXT, "number_changed": _TEXT,
    "light_paraphrase": _TEXT, "moderate_paraphrase": _TEXT,
}
RELEVANT = STRUCTURAL | TEXTUAL
#: Kinds that change nothing a reader would mind: what is told of them is noise.
HARMLESS = ("light_paraphrase", "moderate_paraphrase")
#: Codes that are about rows and identifiers.
ROW_CODES = (*dict.fromkeys(c for codes in RELEVANT.values() for c in codes), "out_of_scope", "invalid_text_type", "ambiguous_reference")
#: Kinds that change the next row too.
PAIRS = ("swapped_rows", "merged_rows")
#: One row of each run of so many can be chosen, out of its first half: chosen rows are five apart at least.
RUN = 8
#: Cases up to which they, and the rows that they touch, are broadcast.
FEW = 100_000


def few(cases: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What is put around tables with a row or two a case: a broadcast if there are few, as whole files meet them."""
    return F.broadcast if cases.count() <= FEW else lambda df: df


def drawn(seed: int, *what: Column | str) -> Column:
    """32 bits of a digest, as a long: the same in every engine and on every run."""
    return F.conv(F.substring(_digest(seed, *what), 1, 8), 16, 10).cast("long")


def _digest(seed: int, *what: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(w) if isinstance(w, str) else w).cast("string") for w in what]))


def chosen(rows: DataFrame, per_kind: int, seed: int = 0) -> DataFrame:
    """Cases (file_id, position, defect, and the other columns of ``rows``) of sound rows
    (file_id, position, grp, ord, n, text, variants): ``per_kind`` of each kind a file, fewer where no more are offered to it.

    ``n`` is the size of the group, ``variants`` (map of kind and text, null: none) what a text can turn into. A row
    can be chosen if another follows in its group; it is offered to one of the kinds that it can have, so none gets
    two, and each kind takes those of the lowest digests. Spark limits the groups before the shuffle.
    """
    run = F.floor(F.col("position") / RUN)
    here = F.pmod("position", F.lit(RUN)) == drawn(seed, F.lit("run"), "file_id", run) % (RUN // 2)
    rows = rows.where(here & (F.col("position") > 1) & (F.col("ord") < F.col("n")))
    kinds = F.array_sort(F.concat(F.array(*map(F.lit, STRUCTURAL)), F.coalesce(F.map_keys("variants"), F.array().cast("array<string>"))))
    at = drawn(seed, F.lit("kind"), "file_id", "position") % F.size(kinds)
    rows = rows.withColumn("defect", F.element_at(kinds, (at + 1).cast("int")))
    order = Window.partitionBy("file_id", "defect").orderBy(_digest(seed, F.lit("pick"), "file_id", "position"), "position")
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= per_kind).drop("__place")


def affected(cases: DataFrame) -> DataFrame:
    """Rows (file_id, position, case_id, defect, second, grp, ord, id): what each case touches; ``second`` is the next row of a pair."""
    second = F.explode(F.when(F.col("defect").isin(*PAIRS), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    spread = cases.select("*", second.alias("second")).withColumn("step", F.col("second").cast("int"))
    out = spread.select("file_id", (F.col("position") + F.col("step")).alias("position"), case_id(), "defect", "second", "grp", (F.col("ord") + F.col("step")).alias("ord"))
    return out.withColumn("id", identifier(F.col("grp"), F.col("ord")))


def case_id() -> Column:
    return F.concat_ws(":", "defect", "file_id", F.col("position").cast("string")).alias("case_id")


def injected(rows: DataFrame, cases: DataFrame, bad_group: str = "0", many: int | None = None) -> DataFrame:
    """Rows (file_id, input_index, row_number, group_raw, ordinal_raw, text, case_id) of the files with their defects, numbered anew.

    Rows meet the cases once, by position. A copy stands behind its row, swapped rows change
    places, and the first of two merged rows takes both ordinals and texts. ``many`` ranges are numbered.
    """
    near = few(cases)
    touched = affected(cases).select("file_id", "position", "case_id", "defect", "second")
    variant = cases.select("file_id", "position", F.element_at("variants", F.col("defect")).alias("variant"))
    following = cases.where("defect = 'merged_rows'").select("file_id", (F.col("position") + 1).alias("position"))
    following = rows.join(near(following), ["file_id", "position"]).select("file_id", (F.col("position") - 1).alias("position"), F.col("ord").alias("next_ord"), F.col("text").alias("next_text"))
    touched = touched.join(variant.join(following, ["file_id", "position"], "left"), ["file_id", "position"], "left")
    base = rows.select("file_id", "position", "grp", "ord", "text").join(near(touched), ["file_id", "position"], "left")
    is_ = lambda kind: F.coalesce(F.col("defect") == kind, F.lit(False))
    merged, second = is_("merged_rows"), F.coalesce("second", F.lit(False))
    base = base.where(~(is_("missing_row") | (merged & second)))
    step = F.when(is_("swapped_rows"), F.when(second, -1).otherwise(1)).otherwise(0)
    text = F.when(is_("emptied_text"), "").when(merged, F.concat_ws(" ", "text", "next_text")).otherwise(F.coalesce("variant", "text"))
    ordinal = F.col("ord").cast("string")
    out = base.select(
        "file_id", (F.col("position") + step).alias("__at"), F.when(is_("invalid_id"), bad_group).otherwise(F.col("grp").cast("string")).alias("group_raw"),
        F.when(merged, F.concat_ws("-", ordinal, F.col("next_ord").cast("string"))).otherwise(ordinal).alias("ordinal_raw"), text.alias("text"), "case_id",
        F.explode(F.when(is_("duplicate_row"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    )
    out = ranked(out, ["file_id"], [F.col("__at"), F.col("__copy")], "__number", many)
    return out.select("file_id", (F.col("__number") - 1).alias("input_index"), (F.col("__number") + 1).alias("row_number"), "group_raw", "ordinal_raw", "text", "case_id")


def told(cases: DataFrame, rows: DataFrame, findings: DataFrame, codes: tuple[str, ...] = ROW_CODES) -> DataFrame:
    """Rows (case_id, code), once each: findings with one of the codes that meet a case by identifier, by row or in a missing run."""
    ids = affected(cases).select("file_id", "case_id", "grp", "ord", "id")
    # read three times, and the audit behind is long
    found = written(findings.where(F.col("code").isin(*codes)).select("file_id", "code", "ids", "row_numbers", "evidence"), "told")
    by_id = found.select("file_id", "code", F.explode("ids").alias("id")).join(ids, ["file_id", "id"])
    places = rows.where("case_id IS NOT NULL").select("file_id", "row_number", "case_id")
    by_row = found.select("file_id", "code", F.explode("row_numbers").alias("row_number")).join(places, ["file_id", "row_number"])
    gaps = found.where("code = 'missing_ids'").select("file_id", "code", F.from_json("evidence", "grp long, ranges array<struct<first: long, last: long>>").alias("e"))
    gaps = gaps.select("file_id", "code", F.col("e.grp").alias("grp"), F.explode("e.ranges").alias("r")).select("file_id", "code", "grp", "r.first", "r.last")
    by_gap = joined(ids, gaps, ["file_id", "grp"], "ord")
    both = [part.select("case_id", "code") for part in (by_id, by_row, by_gap)]
    return both[0].unionByName(both[1]).unionByName(both[2]).distinct()


def naive(cases: DataFrame, rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows (case_id, naive_a, naive_b): whether a lookup by key flags a case's rows, or the reverse lookup its identifiers.

    Only rows of cases are looked up; keys are taken as they are written. The reference and
    the rows are cut to the keys of cases before they are dealt out.
    """
    key, near = ["group_raw", "ordinal_raw"], few(cases)
    asked = rows.where("case_id IS NOT NULL").select(*key).distinct()
    last = reference.join(near(asked), key, "left_semi").groupBy(*key).agg(F.max_by("text", "row_number").alias("reference"), F.lit(True).alias("found"))
    hits = rows.where("case_id IS NOT NULL").join(last, key, "left")
    flagged = hits.where("found IS NULL OR NOT (text <=> reference)").select("case_id", F.lit(True).alias("a"))
    ids = affected(cases).select("file_id", "case_id", F.col("grp").cast("string").alias("group_raw"), F.col("ord").cast("string").alias("ordinal_raw"))
    present = rows.select("file_id", *key).join(near(ids.select("file_id", *key).distinct()), ["file_id", *key], "left_semi").distinct()
    absent = ids.join(present, ["file_id", *key], "left_anti").select("case_id", F.lit(False).alias("a"))
    return flagged.unionByName(absent).groupBy("case_id").agg(F.bool_or("a").alias("naive_a"), F.lit(True).alias("naive_b"))


def recall(cases: DataFrame, rows: DataFrame, findings: DataFrame, reference: DataFrame, by: tuple[str, ...] = (), codes: tuple[str, ...] = ROW_CODES, relevant: dict[str, tuple[str, ...]] = RELEVANT) -> DataFrame:
    """Rows (defect, by..., injected, touched, detected, recall, naive_a, naive_b): cases by kind and sub-kind, with any finding, with one that tells them.

    For harmless kinds ``touched`` is the noise.
    """
    telling = F.create_map(*[x for kind, c in relevant.items() for x in (F.lit(kind), F.array(*map(F.lit, c)))])
    hits = told(cases, rows, findings, codes).groupBy("case_id").agg(F.collect_set("code").alias("codes"))
    flags = naive(cases, rows, reference)
    out = cases.select("defect", *by, case_id()).join(hits, "case_id", "left").join(flags, "case_id", "left")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = out.groupBy("defect", *by).agg(
        F.count("*").alias("injected"), yes(F.size("codes") > 0).alias("touched"), yes(F.arrays_overlap("codes", telling[F.col("defect")])).alias("detected"),
        yes(F.col("naive_a")).alias("naive_a"), yes(F.col("naive_b")).alias("naive_b"),
    )
    return out.withColumn("recall", F.round(F.col("detected") / F.col("injected"), 3))


def alarms(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (untouched, false_alarms): audited rows (file_id, id, row_number, case_id, status) outside every case, and those that need review."""
    ids = few(cases)(affected(cases).select("file_id", "id").distinct())
    # rows without an identifier get a key of their own
    rest = rows.where("case_id IS NULL").withColumn("id", F.coalesce("id", F.concat(F.lit("#"), F.col("row_number").cast("string"))))
    rest = rest.join(ids, ["file_id", "id"], "left_anti")
    return rest.agg(F.count("*").alias("untouched"), F.count_if(F.col("status") == "needs_review").alias("false_alarms"))
