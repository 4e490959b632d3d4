"""Sinks: review tables, reports, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LIVE_NOTICE = "Reference text omitted; consult source URL"


def review_table(findings: DataFrame, rows: DataFrame, live: bool = False) -> DataFrame:
    """One line a finding with the texts of the rows that it covers, in row order.

    Findings meet their rows in an equi-join on (file, row number). The reference text of
    a live source is never written.
    """
    spread = findings.select("file_id", "finding_id", F.explode("row_numbers").alias("row_number"))
    texts = spread.join(rows.select("file_id", "row_number", "text", F.col("reference.text").alias("other")), ["file_id", "row_number"])
    covered = texts.groupBy("file_id", "finding_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_number", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("ours"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("other").isNotNull(), F.struct("row_number", "other")))), lambda x: x["other"])).alias("theirs"),
    )
    out = findings.join(covered, ["file_id", "finding_id"], "left")
    none = F.array().cast("array<string>")
    reference = F.lit(LIVE_NOTICE) if live else T.joined_texts(F.coalesce("theirs", none))
    return out.select(
        "file_id", "finding_id", "code", "type", "severity", F.array_join("ids", ";").alias("ids"),
        F.array_join(F.col("row_numbers").cast("array<string>"), ";").alias("row_numbers"),
        T.joined_texts(F.coalesce("ours", none)).alias("candidate_text"), reference.alias("reference_text"),
        T.hidden_control_flags(T.joined_texts(F.coalesce("ours", none))).alias("hidden_controls"), F.lit("false").alias("certificate"),
    )


def csv_lines(table: DataFrame) -> DataFrame:
    """The table's rows as lines (line) of defused, quoted cells."""
    return table.select(F.concat_ws(",", *[T.csv_cell(F.col(c)) for c in table.columns]).alias("line"))


def write_csv(table: DataFrame, path: str) -> None:
    csv_lines(table).write.mode("overwrite").text(path)


def redacted(rows: DataFrame) -> DataFrame:
    """Rows without what a live source's terms forbid to keep: the reference's text and what quotes it."""
    out = rows.withColumn("reference", F.col("reference").dropFields("text"))
    for review in ("numeric_review", "qualifier_review"):
        if review in rows.columns:
            own = F.filter(F.col(f"{review}.reasons"), lambda r: r["role"] == "candidate")
            out = out.withColumn(review, F.struct(F.col(f"{review}.state").alias("state"), F.col(f"{review}.candidate").alias("candidate"), own.alias("reasons")))
    return out.drop("removed")


def report_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)
