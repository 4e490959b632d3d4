"""The composed audit: structure, reference, comparison, statuses and one summary a file."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from . import compare, structure
from .index import dealt
from .structure import finding


class Audit:
    """Rows with statuses, findings, and a summary row for each file, each planned when asked for.

    Rows and summary read the input once and keep nothing; the summary needs no evidence, so
    none is written down for it. Findings read the rows several times: they share a persisted
    form (memory, then disk) of the columns that they need, which ``unpersist`` frees; lost
    parts are computed again.
    """

    #: What findings read; what a comparison said of a row is in ``raised`` by then.
    KEPT = (
        "file_id", "input_index", "row_number", "grp", "ord", "id", "position", "text", "valid", "in_scope", "raised", "status",
        "lexical", "comparison_status", "comparison_reason", "language_state",
    )

    def __init__(self, rows: DataFrame, findings: Callable[[DataFrame], DataFrame], summary: Callable[[], DataFrame]):
        self.rows, self._findings, self._summary = rows, findings, summary

    @cached_property
    def _kept(self) -> DataFrame:
        return self.rows.select(*self.KEPT).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def findings(self) -> DataFrame:
        return self._findings(self._kept)

    @cached_property
    def summary(self) -> DataFrame:
        return self._summary()

    def unpersist(self) -> None:
        if "_kept" in self.__dict__:
            self._kept.unpersist()


def audit(
    rows: DataFrame, index: DataFrame, reference: DataFrame | None = None, groups: DataFrame | None = None, complete: bool = True,
    candidate_language: str = "", reference_language: str = "", verified: bool = False, many: int | None = None,
) -> Audit:
    """Audit rows against an index and, if given, reference rows of the same shape.

    ``groups`` (grp) declares complete groups as the scope; ``complete=False`` checks the
    given rows only and claims no completeness. Without a reference, rows abstain. Rows that
    are too many for the session's partitions are dealt to ``many`` tasks.
    """
    ship(rows.sparkSession)
    ours = structure.keyed(rows, index, groups, many)
    theirs = structure.keyed(rows.limit(0) if reference is None else reference, index, many=many)
    language = candidate_language or reference_language
    # the rules on texts are the work, and joins leave small inputs in few tasks: rows meet their reference in a set number of them
    tasks = many or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gated = compare.gated(structure.counted(ours), None if reference is None else structure.named(reference), candidate_language, reference_language, verified, tasks)
    gated = structure.row_structure(gated, candidate_language)
    if reference is None:
        # what a comparison raises needs a reference
        done = compare.unreviewed(gated, language)
    else:
        done = compare.row_comparison(compare.reviewed(gated, language), language)
    # texts have been read when rows meet by their place in the file, and need not move again unless they are asked for
    placed = compare.statuses(structure.ordered(done, many, ours)).drop("fresh", "whole")

    def findings(kept: DataFrame) -> DataFrame:
        found = structure.row_findings(kept).unionByName(structure.group_findings(kept, index, groups, complete))
        return found.unionByName(_file_findings(kept, theirs, language, verified))

    def summary() -> DataFrame:
        return summarise(compare.statuses(done), None if reference is None else theirs, index, groups, complete, verified, many)

    return Audit(placed, findings, summary)


_COUNTS = {
    "missing": "comparison_reason IN ('missing_reference', 'empty_reference')", "ambiguous": "comparison_reason = 'ambiguous_reference'",
    "unverified": "comparison_reason = 'unverified_reference'", "mismatched": "comparison_reason = 'language_mismatch'", "limited": "language_state = 'abstain'",
}
# a file's evidence as a whole, by these counts and those of the reference
_BROKEN = "invalid_rows > 0 OR empty_rows > 0 OR duplicate_ids > 0"
_GAPS = "missing > 0 OR ambiguous > 0 OR unverified > 0 OR mismatched > 0 OR reference_rows = 0"
_UNPROVED = "({verified} OR unverified > 0) AND reference_rows > 0"
_LIMITED = "limited > 0"


def _file_findings(rows: DataFrame, reference: DataFrame, language: str, verified: bool) -> DataFrame:
    """Findings about a file's evidence as a whole."""
    counts = rows.groupBy("file_id").agg(*[F.count_if(F.expr(when)).alias(name) for name, when in _COUNTS.items()])
    counts = counts.join(compare.integrity(reference), how="cross")  # one row on the right
    counts = counts.withColumn("reference_rows", F.col("invalid_rows") + F.col("usable_ids") + F.col("duplicate_ids") + F.col("empty_rows"))
    nothing = (F.array(), F.array(), F.lit(None))
    out = finding(counts.where(_BROKEN), "reference_integrity", {c: F.col(c) for c in ("invalid_rows", "empty_rows", "duplicate_ids")}, *nothing)
    out = out.unionByName(finding(counts.where(_GAPS), "reference_coverage", {c: F.col(c) for c in ("missing", "ambiguous", "unverified")}, *nothing))
    unproved = counts.where(_UNPROVED.format(verified=not verified))
    out = out.unionByName(finding(unproved, "unverified_reference", {"unverified": F.col("unverified")}, *nothing))
    return out.unionByName(finding(counts.where(_LIMITED), "language_checks_limited", {"language": F.lit(language), "rows": F.col("limited")}, *nothing))


_STATUSES = ("needs_review", "abstain", "no_signal")
_COUNTED = [
    "invalid_id", "empty_text", "out_of_order", "out_of_scope", "suspected_merged_range", "text_hygiene", "reference_text_hygiene",
    "potential_numeric_change", "numeric_comparison_abstain", "potential_qualifier_change", "qualifier_comparison_abstain",
    "potential_negation_change", "negation_comparison_abstain", "language_rule_abstain", "lexical_difference",
]


def _by_file(rows: DataFrame, many: int | None) -> DataFrame:
    """Counters of each file, in one pass over rows whose order isn't told yet.

    Order is told within a stride, and of a stride's first valid row, which depends on the strides
    before it, when only its counters are left: if that row is late, they are corrected by one.
    """
    c, late = F.col, F.col("__late")
    rows = dealt(rows.withColumn("__stride", structure.stride()), many, "file_id", "__stride")
    before = Window.partitionBy("file_id", "__stride").orderBy("input_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__previous", F.last(F.when(c("valid"), c("position")), ignorenulls=True).over(before))
    rows = rows.withColumn("__late", c("valid") & F.coalesce(c("position") < c("__previous"), F.lit(False)))
    rows = rows.withColumn("status", F.when(late, "needs_review").otherwise(c("status")))
    kinds = {kind: F.array(*[F.lit(code) for code, (k, _) in structure.CODES.items() if k == kind]) for kind in ("structural", "comparison")}
    fresh, big = c("fresh"), c("group_size") >= structure.BLOCK
    blocks = F.struct("grp", F.expr(f"group_size div {structure.BLOCK} + 1").alias("blocks"))
    counters = {
        "total_rows": F.count("*"), "valid_rows": F.count_if("valid"), "covered_ids": F.count_if(fresh & c("in_scope")),
        "compared_rows": F.count_if(c("comparison_status") == "compared"), "lexical_rows": F.count_if("lexical"),
        **{name: F.count_if(F.expr(when)) for name, when in _COUNTS.items()}, **{f"{s}_rows": F.count_if(c("status") == s) for s in _STATUSES},
        "found": F.coalesce(F.sum(F.size("codes")), F.lit(0)) + F.count_if(late),
        **{f"{kind}_found": F.coalesce(F.sum(F.size(F.array_intersect("codes", codes))), F.lit(0)) + (F.count_if(late) if kind == "structural" else 0) for kind, codes in kinds.items()},
        **{f"n_{code}": F.count_if(late if code == "out_of_order" else F.array_contains("codes", code)) for code in _COUNTED},
        "repeated_ids": F.count_if(fresh & (c("copies") > 1)), "repeated_rows": F.count_if(c("valid") & ~fresh),
        "whole_groups": F.count_if(c("whole") & c("in_scope") & ~big),
    }
    strides = rows.groupBy("file_id", "__stride").agg(
        *[n.alias(name) for name, n in counters.items()], F.max_by("position", F.when(c("valid"), c("input_index"))).alias("__end"),
        F.min_by(F.struct("position", "status"), F.when(c("valid"), c("input_index"))).alias("__first"),
        F.collect_list(F.when(c("whole") & c("in_scope") & big, blocks)).alias("__blocks"),
    )
    earlier = Window.partitionBy("file_id").orderBy("__stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = strides.withColumn("__late", F.coalesce(c("__first.position") < F.last("__end", ignorenulls=True).over(earlier), F.lit(False)))
    # a late first row: one finding more, and another status
    more = {name: late.cast("long") for name in ("found", "structural_found", "n_out_of_order")}
    was = c("__first.status")
    more |= {f"{s}_rows": (late & (was != s)).cast("long") if s == "needs_review" else -(late & (was == s)).cast("long") for s in _STATUSES}
    out = strides.groupBy("file_id").agg(
        *[F.sum(c(name) + more[name] if name in more else c(name)).alias(name) for name in counters],
        F.array_sort(F.flatten(F.collect_list("__blocks"))).alias("__blocks"),
    )
    return out.withColumn("whole_groups", c("whole_groups") + _whole(c("__blocks"))).drop("__blocks")


def _whole(blocks: Column) -> Column:
    """How many groups have all their blocks in a sorted array of those that a file has."""
    start = F.struct(F.lit(None).cast("long").alias("grp"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("whole"))

    def step(so_far: Column, b: Column) -> Column:
        seen = F.when(so_far["grp"].eqNullSafe(b["grp"]), so_far["seen"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(b["grp"].alias("grp"), seen.alias("seen"), (so_far["whole"] + (seen == b["blocks"]).cast("long")).alias("whole"))

    return F.aggregate(blocks, start, step, lambda x: x["whole"])


def summarise(rows: DataFrame, reference: DataFrame | None, index: DataFrame, groups: DataFrame | None, complete: bool, verified: bool, many: int | None = None) -> DataFrame:
    """One row a file of rows with statuses but for their order: counters, coverage, constant safety flags.

    What is found is counted, not made: the rows are read once, and nothing of them is kept.
    """
    c, zero = F.col, F.lit(0).cast("long")
    out = _by_file(rows, many)
    scope = index if groups is None else index.join(groups.select("grp").distinct(), "grp", "left_semi")
    if complete:
        wanted = scope.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("expected_ids"), F.count_if(c("n") > 0).alias("__groups"))
        out = out.join(F.broadcast(wanted), how="cross")  # one row
    else:
        out = out.withColumns({"expected_ids": c("covered_ids"), "__groups": c("whole_groups")})
    names = ("invalid_rows", "empty_rows", "duplicate_ids", "usable_ids")
    # a subquery, which isn't run for who doesn't ask for what depends on it
    theirs = F.struct(*[zero.alias(n) for n in names]) if reference is None else compare.integrity(reference).select(F.struct(*names)).scalar()
    out = out.withColumn("__theirs", theirs).withColumns({n: c(f"__theirs.{n}") for n in names})
    out = out.withColumn("reference_rows", c("invalid_rows") + c("usable_ids") + c("duplicate_ids") + c("empty_rows"))
    of_file = sum((F.coalesce(F.expr(e).cast("long"), zero) for e in (_BROKEN, _GAPS, _UNPROVED.format(verified=not verified), _LIMITED)), zero)
    by_group = c("repeated_ids") + c("__groups") - c("whole_groups")
    percent = F.when(c("expected_ids") > 0, (c("covered_ids") * 100 / c("expected_ids")).cast("decimal(20,10)")).otherwise(0)
    out = out.withColumns({"findings": c("found") + by_group + of_file, "structural_findings": c("structural_found") + by_group, "missing_ids": c("expected_ids") - c("covered_ids")})
    return out.select(
        "file_id", "total_rows", "valid_rows", "covered_ids", "compared_rows", "lexical_rows", c("unverified").alias("unverified_rows"),
        c("missing").alias("reference_missing_rows"), c("ambiguous").alias("reference_ambiguous_rows"), *[f"{s}_rows" for s in _STATUSES],
        "findings", "structural_findings", c("comparison_found").alias("comparison_findings"), *[f"n_{code}" for code in _COUNTED],
        c("repeated_ids").alias("duplicate_ids"), c("repeated_rows").alias("duplicate_rows"), "expected_ids", "missing_ids",
        F.round(percent, 2).cast("double").alias("coverage_percent"),
        ((c("total_rows") > 0) & (c("missing_ids") == 0) & (c("structural_findings") == 0)).alias("structurally_complete"),
        F.lit("none").alias("certification"),
    )


def pairs_as_rows(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and reference rows of pairs (file_id, input_index, text, reference_text), numbered 1:n."""
    base = pairs.select("file_id", F.col("input_index").cast("long"), (F.col("input_index") + 1).alias("row_number"), F.lit("1").alias("group_raw"),
                        (F.col("input_index") + 1).cast("string").alias("ordinal_raw"), "text", "reference_text")
    return base.drop("reference_text"), base.drop("text").withColumnRenamed("reference_text", "text")


