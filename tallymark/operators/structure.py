"""The structural audit of numbered rows: identifiers, order, copies, gaps, character hygiene.

Rows have file_id, input_index (their order in the file), row_number, group_raw,
ordinal_raw, text and, from typed sources, raw_type. Order-dependent steps work by strides
of a file and over one row a stride; nothing needs a window over a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .coverage import missing_runs
from .index import STRIDE, dealt, expected, identifier
from .ranks import ranked

# Codes with their type and severity, in the order in which they are raised.
CODES = {
    "reference_integrity": ("evidence", "high"),
    "suspected_merged_range": ("structural", "high"),
    "invalid_id": ("structural", "high"),
    "out_of_scope": ("structural", "medium"),
    "out_of_order": ("structural", "medium"),
    "invalid_text_type": ("structural", "high"),
    "empty_text": ("structural", "high"),
    "text_hygiene": ("structural", "medium"),
    "duplicate_id": ("structural", "high"),
    "missing_ids": ("structural", "high"),
    "ambiguous_reference": ("evidence", "high"),
    "reference_text_hygiene": ("evidence", "medium"),
    "language_rule_abstain": ("evidence", "info"),
    "numeric_comparison_abstain": ("evidence", "info"),
    "potential_numeric_change": ("comparison", "high"),
    "qualifier_comparison_abstain": ("evidence", "info"),
    "potential_qualifier_change": ("comparison", "high"),
    "negation_comparison_abstain": ("evidence", "info"),
    "potential_negation_change": ("comparison", "high"),
    "lexical_difference": ("comparison", "low"),
    "reference_coverage": ("evidence", "info"),
    "unverified_reference": ("evidence", "info"),
    "language_checks_limited": ("evidence", "info"),
    "semantic_distance": ("comparison", "medium"),
    "semantic_input_truncated": ("comparison", "medium"),
    "context_contradiction": ("comparison", "high"),
    "context_information_change": ("comparison", "high"),
    "context_input_truncated": ("comparison", "medium"),
    "context_uncertain": ("evidence", "info"),
    "context_language_mismatch": ("evidence", "info"),
}
PHASE = {code: k for k, code in enumerate(CODES)}
SEVERITIES = ("critical", "high", "medium", "low", "info")

FINDING = ["file_id", "finding_id", "phase", "input_index", "code", "type", "severity", "row_numbers", "ids", "evidence"]


def finding(rows: DataFrame, code: str, evidence: dict[str, Column], row_numbers: Column | None = None, ids: Column | None = None, at: Column | None = None) -> DataFrame:
    """Findings of one code, one a row; the id is a digest of what they say."""
    kind, severity = CODES[code]
    told = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])) if evidence else F.lit("{}")
    numbers = F.array("row_number") if row_numbers is None else row_numbers
    names = F.filter(F.array("id"), lambda x: x.isNotNull()) if ids is None else ids
    out = rows.select(
        "file_id", F.lit(PHASE[code]).alias("phase"), (F.col("input_index") if at is None else at).cast("long").alias("input_index"),
        F.lit(code).alias("code"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
        numbers.cast("array<long>").alias("row_numbers"), names.cast("array<string>").alias("ids"), told.alias("evidence"),
    )
    return _digested(out)


def _numbered(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("grp", T.strict_integer(F.col("group_raw").cast("string")))
    return out.withColumn("ord", T.strict_integer(F.col("ordinal_raw").cast("string")))


def named(rows: DataFrame) -> DataFrame:
    """Rows with grp, ord and id by their numbers alone, no index asked: valid are those that have both.

    For the other side of a join by id: a row and its reference have the same numbers, so what
    the index says of one it says of both.
    """
    out = _numbered(rows)
    return out.withColumns({"valid": F.col("grp").isNotNull() & F.col("ord").isNotNull(), "id": identifier(F.col("grp"), F.col("ord"))})


def keyed(rows: DataFrame, index: DataFrame, groups: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """Rows with grp, ord, id, position, in_scope and the flags of each row on its own.

    ``groups`` (grp) is the declared scope; without one every valid row is in scope. Rows
    that are too many for the session's partitions meet the index in ``many`` tasks.
    """
    out = _numbered(rows)
    dim = index.select(F.col("grp").alias("__grp"), F.col("n").alias("group_size"), F.col("base").alias("__base"))
    # the side that is dealt out by number sets the number of both
    dim = dealt(dim, many, "__grp")
    out = out.join(dim, F.col("grp") == F.col("__grp"), "left").drop("__grp")
    valid = F.coalesce(F.col("ord").between(1, F.col("group_size")), F.lit(False))
    out = out.withColumn("valid", valid)
    out = out.withColumn("id", F.when(valid, identifier(F.col("grp"), F.col("ord"))))
    out = out.withColumn("position", F.when(valid, F.col("__base") + F.col("ord"))).drop("__base")
    if groups is None:
        return out.withColumn("in_scope", F.col("valid"))
    scope = groups.select(F.col("grp").alias("__in")).distinct()
    out = out.join(scope, F.col("grp") == F.col("__in"), "left")
    return out.withColumn("in_scope", F.col("valid") & F.col("__in").isNotNull()).drop("__in")


def merged_ranges(rows: DataFrame) -> DataFrame:
    """Rows whose ordinal is a range such as 3-5, with its ends."""
    span = T.merged_range(F.col("ordinal_raw").cast("string"))
    return rows.withColumn("range", span).where("range IS NOT NULL")


def out_of_order(rows: DataFrame, many: int | None = None) -> DataFrame:
    """Valid rows whose position is below that of the valid row before them in their file."""
    late = in_order(rows, many).where(F.col("valid") & (F.col("position") < F.col("previous.position")))
    told = {"previous_position": "position", "previous_id": "id", "previous_row": "row_number"}
    return late.select(*rows.columns, *[F.col(f"previous.{c}").alias(name) for name, c in told.items()])


def duplicates(rows: DataFrame) -> DataFrame:
    """Identifiers that several valid rows of a file claim, with their rows and whether texts differ."""
    return (
        rows.where("valid").groupBy("file_id", "grp", "ord", "id")
        .agg(
            F.count("*").alias("occurrences"), F.countDistinct(T.normalised(F.col("text"))).alias("texts"),
            F.array_sort(F.collect_list(F.struct("input_index", "row_number"))).alias("places"),
        )
        .where("occurrences > 1")
        .select("file_id", "grp", "ord", "id", "occurrences", (F.col("texts") > 1).alias("conflicting_text"), "places")
    )


def missing(rows: DataFrame, index: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows (file_id, grp, ord): identifiers of the scope that a file doesn't have."""
    return missing_runs(rows, index, groups).select("file_id", "grp", F.explode(F.sequence("first", "last")).alias("ord"))


def totals(rows: DataFrame, index: DataFrame) -> DataFrame:
    """One row over all keyed rows: coverage, gaps and their runs, copies and rows out of order.

    One window by file tells the order; identifiers are counted within its partitioning,
    and the gap before each is the step from the one before it in its group. Groups meet
    the index once, for what is behind their last identifier and for those without rows.
    """
    flagged = in_order(rows).where("valid").select("file_id", "grp", "ord", F.coalesce(F.col("position") < F.col("previous.position"), F.lit(False)).alias("late"))
    ids = flagged.groupBy("file_id", "grp", "ord").agg(F.count("*").alias("c"), F.count_if("late").alias("late"))
    gap = F.col("ord") - F.coalesce(F.lag("ord").over(Window.partitionBy("file_id", "grp").orderBy("ord")), F.lit(0)) - 1
    per_group = ids.withColumn("gap", gap).groupBy("file_id", "grp").agg(
        F.sum("c").alias("rows"), F.count("*").alias("ids"), F.count_if(F.col("c") > 1).alias("doubled"), F.sum("late").alias("late"), F.sum("gap").alias("gaps"),
        F.count_if(F.col("gap") > 0).alias("runs"), F.max("ord").alias("last"),
    )
    both = index.select("grp", "n").join(per_group, "grp", "left")
    behind = F.col("n") - F.coalesce("last", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = both.agg(
        total("rows").alias("total_rows"), total("n").alias("expected_ids"), total("ids").alias("covered_ids"), (total("gaps") + total(behind)).alias("missing_ids"),
        (total("runs") + F.count_if(behind > 0)).alias("missing_runs"), total("doubled").alias("duplicate_ids"), (total("rows") - total("ids")).alias("duplicate_rows"), total("late").alias("out_of_order_rows"),
    )
    percent = F.when(F.col("expected_ids") > 0, F.col("covered_ids") * 100 / F.col("expected_ids").cast("double")).otherwise(0.0)
    return out.withColumn("coverage_percent", F.round(percent.cast("decimal(20,10)"), 2).cast("double"))


def missing_in_groups(have: DataFrame, index: DataFrame, many: int | None = None) -> DataFrame:
    """Rows (grp, ord) of the index without a counterpart in ``have`` (grp, ord): one anti join, in ``many`` tasks."""
    have = dealt(have.select("grp", "ord").distinct(), many, "grp", "ord")
    return expected(index).select("grp", "ord").join(have, ["grp", "ord"], "left_anti")


def ranges(rows: DataFrame, by: list[str], value: str = "ord") -> DataFrame:
    """Runs of consecutive values by key: (by..., first, last, size). Values must be distinct by key."""
    order = Window.partitionBy(*by).orderBy(value)
    island = (F.col(value) - F.row_number().over(order)).alias("__island")
    runs = rows.select(*by, value, island).groupBy(*by, "__island")
    return runs.agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size")).drop("__island")


RAISED = "array<struct<code: string, evidence: string>>"


def raised(code: str, when: Column, **evidence: Column) -> Column:
    """struct(code, evidence) if the condition holds, null otherwise; for arrays of what a row raises."""
    told = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])) if evidence else F.lit("{}")
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), told.alias("evidence")))


def stride() -> Column:
    """The stride of its file in which a row lies."""
    return F.floor(F.col("input_index") / STRIDE)


def listed(found: list[tuple[str, Column, dict[str, Column]]]) -> tuple[Column, Column]:
    """What is raised of (code, condition, evidence), in their order: array(struct(code, evidence)), and the codes alone."""
    codes = [F.when(F.coalesce(when, F.lit(False)), F.lit(code)) for code, when, _ in found]
    return F.array_compact(F.array(*[raised(code, when, **told) for code, when, told in found])), F.array_compact(F.array(*codes))


def in_order(rows: DataFrame, many: int | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Rows with ``previous``: position, id and number of the valid row before them in their file.

    It is looked for within a stride of the file first; what comes before a stride is the
    last valid row of the strides before it, of which there is one row each. So no task
    holds a whole file. Strides, and files of one row each, are dealt to ``many`` tasks.
    ``claims`` are the same rows at an earlier step, where the ends of strides cost less.
    """
    cut = lambda df: dealt(df.withColumn("__stride", stride()), many, "file_id", "__stride")
    strided = cut(rows)
    here = F.when(F.col("valid"), F.struct("position", "id", "row_number"))
    before = Window.partitionBy("file_id", "__stride").orderBy("input_index").rowsBetween(Window.unboundedPreceding, -1)
    ends = (strided if claims is None else cut(claims)).groupBy("file_id", "__stride").agg(F.max_by(here, F.when(F.col("valid"), F.col("input_index"))).alias("__end"))
    ends = dealt(ends, many, "file_id")
    earlier = Window.partitionBy("file_id").orderBy("__stride").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file_id", "__stride", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    out = strided.withColumn("__within", F.last(here, ignorenulls=True).over(before)).join(carried, ["file_id", "__stride"], "left")
    return out.select(*rows.columns, F.coalesce("__within", "__before").alias("previous"))


def with_copies(rows: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Rows with ``copies``: how many valid rows of their file claim their identifier, 0 without one.

    Counts are made before they are joined, and rows without an identifier are spread over
    all tasks, so neither a hot identifier nor many invalid rows land in one. ``claims`` are
    the same rows at an earlier step, which is cheaper to count.
    """
    claimed = (rows if claims is None else claims).where("valid").groupBy("file_id", F.col("id").alias("__id")).agg(F.count("*").alias("copies"))
    spread = rows.withColumn("__id", F.coalesce("id", F.concat(F.lit("#"), F.col("input_index").cast("string"))))
    out = spread.join(claimed, ["file_id", "__id"], "left")
    return out.select(*rows.columns, F.when(F.col("valid"), F.coalesce("copies", F.lit(0))).otherwise(0).alias("copies"))


def placed(rows: DataFrame) -> DataFrame:
    """Keyed rows with what the others of their file say about them: previous and copies."""
    return with_copies(in_order(rows), rows)


#: Ordinals of a group whose rows are counted together.
BLOCK = 1 << 16


def counted(rows: DataFrame) -> DataFrame:
    """Keyed rows with what the others of their file say about their identifier: copies, fresh and whole.

    ``copies`` as of ``with_copies``; ``fresh`` is true in one row of each identifier; ``whole``
    is true in one row of each block of a group's ordinals of which the file has all. Rows are
    where they met the index, so counting moves none; invalid ones are alone.
    """
    block = F.when(F.col("valid"), F.expr(f"ord div {BLOCK}")).otherwise(-1 - F.col("input_index"))
    rows = rows.withColumn("__block", block)
    ids = Window.partitionBy("grp", "__block", "file_id")
    order = ids.orderBy("ord")
    first, last = F.greatest(F.lit(1), F.col("__block") * BLOCK), F.least("group_size", F.col("__block") * BLOCK + BLOCK - 1)
    out = rows.withColumns({
        "__copies": F.count("*").over(Window.partitionBy("grp", "__block", "file_id", "ord")), "__before": F.lag("ord").over(order),
        "__behind": F.lead("ord").over(order), "__ids": F.dense_rank().over(order),
    })
    valid = F.col("valid")
    return out.withColumns({
        "copies": F.when(valid, F.col("__copies")).otherwise(F.lit(0)), "fresh": valid & ~F.col("ord").eqNullSafe(F.col("__before")),
        "whole": valid & F.col("__behind").isNull() & (F.col("__ids") == last - first + 1),
    }).drop("__block", "__copies", "__before", "__behind", "__ids")


def row_structure(out: DataFrame, language: str = "") -> DataFrame:
    """Keyed rows with raised and codes: all structural findings that are about one row, but its order."""
    out = out.withColumn("__range", T.merged_range(F.col("ordinal_raw").cast("string"))).withColumn("__told", T.meaningful(F.col("text")))
    out = out.withColumn("__issues", T.hygiene(F.col("text"), F.lit(language)))
    odd = F.col("raw_type") if "raw_type" in out.columns else F.lit(None).cast("string")
    c = F.col
    found, codes = listed([
        ("suspected_merged_range", c("__range").isNotNull(), {"first": c("__range.first"), "last": c("__range.last")}),
        ("invalid_id", ~c("valid"), {"grp": c("grp"), "ord": c("ord"), "group_size": c("group_size")}),
        ("out_of_scope", c("valid") & ~c("in_scope"), {"grp": c("grp")}),
        ("invalid_text_type", odd != "string", {"received_type": odd}),
        ("empty_text", ~c("__told"), {}),
        ("text_hygiene", c("__told") & (F.size("__issues") > 0), {"issues": c("__issues")}),
    ])
    return out.withColumns({"raised": found, "codes": codes}).drop("__range", "__told", "__issues")


_LATE = "out_of_order"


def ordered(rows: DataFrame, many: int | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Rows with ``previous``, whose raised and codes tell of those out of order too, in the place of that code."""
    c, out = F.col, in_order(rows, many, claims)
    late = F.coalesce(c("valid") & (c("position") < c("previous.position")), F.lit(False))
    told = {"previous_id": c("previous.id"), "previous_row": c("previous.row_number"), "previous_position": c("previous.position"), "position": c("position")}
    found, codes = listed([(_LATE, late, told)])
    earlier = F.array(*[F.lit(code) for code, phase in PHASE.items() if phase < PHASE[_LATE]])

    def with_it(name: str, code, new: Column) -> Column:
        before, behind = F.filter(name, lambda r: F.array_contains(earlier, code(r))), F.filter(name, lambda r: ~F.array_contains(earlier, code(r)))
        return F.when(late, F.concat(before, new, behind)).otherwise(c(name))

    return out.withColumns({"raised": with_it("raised", lambda r: r["code"], found), "codes": with_it("codes", lambda r: r, codes)})


def row_findings(rows: DataFrame) -> DataFrame:
    """The findings of rows with ``raised``: one explode, whatever the number of codes."""
    spread = rows.select("file_id", "input_index", "row_number", "id", F.explode("raised").alias("r"))
    listed = {"phase": F.create_map(*[F.lit(x) for k, v in PHASE.items() for x in (k, v)]), "type": F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (k, v[0])]),
              "severity": F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (k, v[1])])}
    code = F.col("r.code")
    out = spread.select(
        "file_id", F.col("input_index").cast("long").alias("input_index"), code.alias("code"), *[F.element_at(m, code).alias(k) for k, m in listed.items()],
        F.array(F.col("row_number").cast("long")).alias("row_numbers"), F.filter(F.array("id"), lambda x: x.isNotNull()).alias("ids"), F.col("r.evidence").alias("evidence"),
    )
    return _digested(out)


def _digested(out: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", "file_id", "code", F.array_join(F.col("row_numbers").cast("array<string>"), ","), F.array_join("ids", ","), "evidence"), 256)
    return out.withColumn("finding_id", digest).select(*FINDING)


def group_findings(rows: DataFrame, index: DataFrame, groups: DataFrame | None, complete: bool = True) -> DataFrame:
    """Structural findings about identifiers and groups: copies and, if ``complete``, gaps."""
    copies = duplicates(rows).withColumn("input_index", F.col("places")[0]["input_index"])
    out = finding(
        copies, "duplicate_id", {"occurrences": F.col("occurrences"), "conflicting_text": F.col("conflicting_text")}, F.col("places.row_number"), F.array("id")
    )
    if complete:
        gaps = missing_runs(rows, index, groups).groupBy("file_id", "grp").agg(
            F.sum("size").alias("missing"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges")
        )
        evidence = {"grp": F.col("grp"), "missing": F.col("missing"), "ranges": F.col("ranges")}
        out = out.unionByName(finding(gaps, "missing_ids", evidence, F.array(), F.array(), F.lit(None)))
    return out


def priority(findings: DataFrame, many: int | None = None) -> DataFrame:
    """Findings with their rank (critical first, unknown severities last of all) and their number in that order by file, from ``many`` ranges."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.lit(0))
    rank = F.when(rank == 0, len(SEVERITIES) - 1).otherwise(rank - 1).cast("int")
    order = [F.col("rank"), F.col("phase"), F.col("input_index").asc_nulls_last(), F.col("finding_id")]
    return ranked(findings.withColumn("rank", rank), ["file_id"], order, "place", many)


def queue_breakdown(findings: DataFrame) -> DataFrame:
    """One row a file: all findings, those of priority, wording, low ones, information."""
    return findings.groupBy("file_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("severity").isin("critical", "high", "medium")).alias("priority"),
        F.count_if(F.col("code") == "lexical_difference").alias("wording"), F.count_if(F.col("severity") == "low").alias("low"),
        F.count_if((F.col("severity") == "info") | F.col("severity").isNull()).alias("information"),
    )
