"""What plainer methods find, and how often known defects are found: baselines and benchmark counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def naive_lookup(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows (side, group_raw, ordinal_raw, row_number, reason): what a spreadsheet's lookup by identifier flags.

    Side A compares each row with the last reference of its key, letter by letter; side B
    adds references that no row has. Keys are taken as they are written.
    """
    key = ["group_raw", "ordinal_raw"]
    last = reference.groupBy(*key).agg(F.max_by("text", "row_number").alias("reference"), F.lit(True).alias("found"))
    a = rows.select(*key, "row_number", "text").join(last, key, "left")
    reason = F.when(F.col("found").isNull(), "not_found").when(~F.col("text").eqNullSafe(F.col("reference")), "differs")
    a = a.select(F.lit("A").alias("side"), *key, "row_number", reason.alias("reason")).where("reason IS NOT NULL")
    b = last.join(rows.select(*key).distinct(), key, "left_anti")
    return a.unionByName(b.select(F.lit("B").alias("side"), *key, F.lit(None).cast("long").alias("row_number"), F.lit("absent").alias("reason")))


def defect_recall(injected: DataFrame, findings: DataFrame, relevant: DataFrame) -> DataFrame:
    """Rows (defect, injected, touched, detected, recall) of injected defects (case_id, defect, id, row_number).

    A finding (ids, row_numbers, code) touches a defect by its identifier or its row; it
    detects it if its code is relevant (defect, code). Both ways are equi-joins.
    """
    told = findings.select("code", F.explode_outer("ids").alias("id"), "row_numbers")
    by_id = injected.join(told.select("id", "code").distinct(), "id").select("case_id", "defect", "code")
    rows = findings.select("code", F.explode("row_numbers").alias("row_number")).distinct()
    by_row = injected.join(rows, "row_number").select("case_id", "defect", "code")
    hits = by_id.unionByName(by_row).distinct().join(relevant.withColumn("relevant", F.lit(True)), ["defect", "code"], "left")
    per_case = hits.groupBy("case_id").agg(F.lit(True).alias("touched"), F.coalesce(F.bool_or("relevant"), F.lit(False)).alias("detected"))
    out = injected.join(per_case, "case_id", "left").groupBy("defect").agg(
        F.count("*").alias("injected"), F.count_if(F.coalesce("touched", F.lit(False))).alias("touched"), F.count_if(F.coalesce("detected", F.lit(False))).alias("detected")
    )
    return out.withColumn("recall", F.round(F.col("detected") / F.col("injected"), 3))


def false_alarms(rows: DataFrame, injected: DataFrame) -> DataFrame:
    """Untouched rows (id, row_number, status) and those of them that need review: rows outside every injected defect."""
    touched = injected.select("row_number").where("row_number IS NOT NULL").distinct()
    ids = injected.select("id").where("id IS NOT NULL").distinct()
    rest = rows.join(touched, "row_number", "left_anti").join(ids, "id", "left_anti")
    return rest.agg(F.count("*").alias("untouched"), F.count_if(F.col("status") == "needs_review").alias("false_alarms"))
