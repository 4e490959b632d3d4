"""Comparison of two revisions of one text: a state for each identifier, differences, decisions bound to evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .index import identifier
from .intervals import marked

STATES = ("ambiguous_duplicate", "invalid_row", "added_id", "removed_id", "identical_raw", "text_change")


def scope_problem(intervals: DataFrame) -> DataFrame:
    """Intervals (grp, first, last) that are no scope: unordered, below 1, null, or overlapping the one before."""
    order = Window.partitionBy("grp").orderBy("first", "last")
    before = F.lag("last").over(order)
    broken = F.coalesce((F.col("grp") < 1) | (F.col("first") < 1) | (F.col("last") < F.col("first")), F.lit(True))
    return intervals.withColumn("reason", F.when(broken, "invalid").when(F.col("first") <= before, "overlapping")).where("reason IS NOT NULL")


def _side(rows: DataFrame) -> DataFrame:
    """Rows with grp, ord and id; an ordinal needs to be positive, no index bounds it."""
    out = rows.withColumn("grp", T.strict_integer(F.col("group_raw").cast("string"))).withColumn("ord", T.strict_integer(F.col("ordinal_raw").cast("string")))
    fine = (F.col("grp") >= 1) & (F.col("ord") > 0)
    out = out.withColumn("id", F.when(fine, identifier(F.col("grp"), F.col("ord"))))
    sound = F.col("id").isNotNull() & F.coalesce(F.col("row_number") > 0, F.lit(False)) & T.meaningful(F.col("text"))
    return out.withColumn("sound", sound)


def ledger(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows with id, sound, and in_scope: inside one of the intervals (grp, first, last), of which a group may have any number."""
    return marked(_side(rows), intervals, ["grp"], "ord", "in_scope")


def compare(candidate: DataFrame, baseline: DataFrame, intervals: DataFrame) -> DataFrame:
    """A record for each identifier in scope of either side, and for each row without an identifier.

    Both sides are grouped first, so the full outer join meets one row a side. States are
    tested in the order of ``STATES``.
    """
    def grouped(rows: DataFrame, name: str) -> DataFrame:
        rows = ledger(rows, intervals).where("id IS NOT NULL AND in_scope")
        return rows.groupBy("id", "grp", "ord").agg(
            F.count("*").alias(f"{name}_n"), F.every(F.col("sound")).alias(f"{name}_sound"), F.max("text").alias(f"{name}_text"),
            F.array_sort(F.collect_list("row_number")).alias(f"{name}_rows"),
        )

    both = grouped(candidate, "candidate").join(grouped(baseline, "baseline"), ["id", "grp", "ord"], "full_outer")
    both = both.fillna(0, ["candidate_n", "baseline_n"])
    unsound = ~F.coalesce("candidate_sound", F.lit(True)) | ~F.coalesce("baseline_sound", F.lit(True))
    state = (
        F.when((F.col("candidate_n") > 1) | (F.col("baseline_n") > 1), STATES[0]).when(unsound, STATES[1])
        .when(F.col("baseline_n") == 0, STATES[2]).when(F.col("candidate_n") == 0, STATES[3])
        .when(F.col("candidate_text") == F.col("baseline_text"), STATES[4]).otherwise(STATES[5])
    )
    both = both.withColumn("state", state).withColumn("record_key", F.col("id"))
    none = F.array().cast("array<long>")
    parts = [both.select("record_key", "id", "grp", "ord", "state", *[F.coalesce(F.col(f"{s}_rows").cast("array<long>"), none).alias(f"{s}_rows") for s in ("candidate", "baseline")],
                         *[F.when(F.col(f"{s}_n") == 1, F.col(f"{s}_text")).alias(f"{s}_text") for s in ("candidate", "baseline")])]
    for name, rows, other in (("candidate", candidate, "baseline"), ("baseline", baseline, "candidate")):
        lost = _side(rows).where("id IS NULL")
        parts.append(
            lost.select(
                F.concat_ws(":", F.lit(name), F.col("file_id").cast("string"), F.col("input_index").cast("string")).alias("record_key"), F.lit(None).cast("string").alias("id"),
                "grp", "ord", F.lit("invalid_row").alias("state"), F.array(F.col("row_number").cast("long")).alias(f"{name}_rows"), none.alias(f"{other}_rows"),
                F.lit(None).cast("string").alias("candidate_text"), F.lit(None).cast("string").alias("baseline_text"),
            )
        )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    changed = F.col("state") == "text_change"
    out = out.withColumn("diff", F.when(changed, T.raw_diff(F.col("baseline_text"), F.col("candidate_text"))))
    hidden = T.hidden_characters(F.col("baseline_text")) != T.hidden_characters(F.col("candidate_text"))
    out = out.withColumn("hidden_control_changed", changed & hidden)
    evidence = F.to_json(F.struct("record_key", "state", "candidate_rows", "baseline_rows", "candidate_text", "baseline_text"))
    return out.withColumn("evidence_fingerprint", F.sha2(evidence, 256))


def nfc_equivalent(records: DataFrame) -> DataFrame:
    """Changed records with nfc_equivalent: whether only the composition of characters differs."""
    from ..functions.udfs import nfc
    from ..plans.shipping import ship

    ship(records.sparkSession)
    changed = records.where("state = 'text_change'")
    return changed.withColumn("nfc_equivalent", nfc("baseline_text") == nfc("candidate_text"))


def coverage(side: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row: rows read, with an identifier and in scope, distinct identifiers seen and not seen."""
    rows = ledger(side, intervals)
    wanted = intervals.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).alias("expected"))
    seen = rows.agg(
        F.count("*").alias("read_rows"), F.count_if(F.col("id").isNotNull() & F.col("in_scope")).alias("in_scope_rows"),
        F.countDistinct(F.when(F.col("in_scope"), F.col("id"))).alias("observed_ids"), F.count_if(F.col("id").isNull()).alias("invalid_rows"),
    )
    return seen.join(wanted, how="cross").withColumn("unobserved_ids", F.col("expected") - F.col("observed_ids")).drop("expected")


def reconcile(decisions: DataFrame, records: DataFrame, context: str) -> DataFrame:
    """Decisions (record_key, evidence_fingerprint, context_fingerprint, ...) with status and stale_reason now.

    A decision is active for the very evidence and context that it was made on; it turns
    active again when both come back.
    """
    now = records.select("record_key", F.col("evidence_fingerprint").alias("__now"))
    out = decisions.drop("status", "stale_reason").join(now, "record_key", "left")
    stale = (
        F.when(F.col("__now").isNull(), "missing_record").when(F.col("evidence_fingerprint") != F.col("__now"), "evidence_changed")
        .when(F.col("context_fingerprint") != context, "context_changed")
    )
    return out.withColumn("stale_reason", stale).withColumn("status", F.when(stale.isNull(), "active").otherwise("stale")).drop("__now")


def redacted(records: DataFrame) -> DataFrame:
    """Records without the baseline's text."""
    return records.withColumn("diff", F.col("diff").dropFields("old_text")).drop("baseline_text").withColumn("reference_text_included", F.lit(False))
