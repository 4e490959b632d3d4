"""The findings as a reader sees them: cases, search text, filters, pages, defects of the reference, gaps in short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .review import INSPECTED, resolution
from .structure import priority

#: Severities that a choice of the filter stands for.
BANDS = {"high": ("critical", "high"), "medium": ("medium",), "low": ("low", "info")}


def group_of(ids: Column, evidence_group: Column, groups: int) -> Column:
    """The group of a finding: of its first identifier, else of its evidence; 0 where neither is a group of the index."""
    first = F.try_element_at(F.split(F.try_element_at(ids, F.lit(1)), ":"), F.lit(1)).try_cast("long")
    number = F.when(F.coalesce(first, F.lit(0)) != 0, first).otherwise(evidence_group.cast("long"))
    return F.when(number.between(1, groups), number).otherwise(F.lit(0).cast("long"))


def cases(findings: DataFrame, groups: int) -> DataFrame:
    """The findings that a person decides on, with their group; findings bring evidence_group."""
    kept = findings.where(F.col("type").isin(*INSPECTED))
    return kept.withColumn("grp", group_of(F.col("ids"), F.col("evidence_group"), groups))


def search_text(findings: DataFrame) -> Column:
    """Everything that a reader may look a finding up by: message, code, title, place, identifiers, rows, groups, marked words."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in findings.columns else F.lit("")
    groups = F.array_distinct(F.transform("ids", lambda x: F.substring_index(x, ":", 1)))
    if "evidence_group" in findings.columns:
        own = F.col("evidence_group").cast("string")
        groups = F.array_distinct(F.concat(groups, F.filter(F.array(own), lambda x: x.isNotNull())))
    rows = F.array_join(F.transform("row_numbers", lambda r: F.concat(r.cast("string"), F.lit(" row "), r.cast("string"))), " ")
    named = F.array_join(F.transform(groups, lambda g: F.concat(g, F.lit(" group "), g)), " ")
    spans = F.array_join("spans", " ") if "spans" in findings.columns else F.lit("")
    return T.search_form(F.concat_ws(" ", have("message"), "code", have("title"), have("place"), F.array_join("ids", " "), rows, named, spans))


def filtered(findings: DataFrame, query: str = "", type_: str = "all", band: str = "all", group: int | None = None, unresolved: bool = False) -> DataFrame:
    """The findings that pass all the reader's choices; findings bring evidence_group and, for ``unresolved``, decision."""
    out = findings
    asked = query.strip()
    if asked:
        form = out.sparkSession.range(1).select(T.search_form(F.lit(asked)).alias("q")).first()["q"]
        out = out.where(T.search_matches(search_text(out), form))
    if type_ != "all":
        out = out.where(F.col("type") == type_)
    if band != "all":
        out = out.where(F.col("severity").isin(*BANDS[band]))
    if group is not None:
        mine = F.exists("ids", lambda x: F.substring_index(x, ":", 1) == str(group))
        out = out.where(mine | F.coalesce(F.col("evidence_group") == group, F.lit(False)))
    if unresolved:
        out = out.where(resolution(F.col("type"), F.col("decision")).startswith("unresolved"))
    return out


def page(findings: DataFrame, number: int, size: int = 20, many: int | None = None) -> DataFrame:
    """The findings of one page of each file, in the order of priority, with the page count."""
    placed = priority(findings, many)
    pages = placed.groupBy("file_id").agg(F.ceil(F.count("*") / F.lit(size)).alias("pages"))
    return placed.where(F.col("place").between((number - 1) * size + 1, number * size)).join(pages, "file_id")


def reference_defects(reference: DataFrame) -> DataFrame:
    """Rows (kind, id, row_number, group_raw, ordinal_raw, occurrences) of keyed reference rows: invalid, empty and repeated ones."""
    columns = ["row_number", "group_raw", "ordinal_raw"]
    invalid = reference.where("NOT valid").select(F.lit("invalid").alias("kind"), F.lit(None).cast("string").alias("id"), *columns, F.lit(1).cast("long").alias("occurrences"))
    empty = reference.where(F.col("valid") & ~T.meaningful(F.col("text"))).select(F.lit("empty").alias("kind"), "id", *columns, F.lit(1).cast("long").alias("occurrences"))
    again = reference.where("valid").groupBy("id").agg(F.count("*").alias("occurrences"), F.min("row_number").alias("row_number")).where("occurrences > 1")
    again = again.select(F.lit("duplicate").alias("kind"), "id", "row_number", F.lit(None).cast("string").alias("group_raw"), F.lit(None).cast("string").alias("ordinal_raw"), "occurrences")
    return invalid.unionByName(empty).unionByName(again)


def preview(missing: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """Of rows (by..., grp, ord) the first identifiers of each key as texts, how many there are, and how many are hidden.

    The first few are chosen by a ranking window, whose limit reaches the map side; no list
    holds more than ``limit``.
    """
    once = missing.select(*by, "grp", "ord").distinct()
    totals = once.groupBy(*by).agg(F.count("*").alias("total"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("grp", "ord"))).where(F.col("n") <= limit)
    shown = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "ord"))), lambda x: F.concat_ws(":", x["grp"].cast("string"), x["ord"].cast("string"))).alias("shown"))
    return totals.join(shown, by).withColumn("hidden", F.greatest(F.col("total") - limit, F.lit(0)))


def groups_and_ids(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many distinct groups and identifiers the valid rows of each key name."""
    once = rows.where("valid").select(*by, "grp", "ord").distinct()
    per_group = once.groupBy(*by, "grp").agg(F.count("*").alias("n"))
    return per_group.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("n").alias("ids"))


def monotonic_progress(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """Events (percent) of operations with the progress to show: it never falls, and is below 100 until the end (done)."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    shown = F.max(F.greatest(F.lit(0), F.least(F.lit(99), F.floor("percent")))).over(so_far)
    return events.withColumn("shown", F.when(F.max("done").over(so_far), 100).otherwise(shown).cast("int"))
