"""Tables of a folder as DataFrames, and the stand-ins that the queries build from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import dealt, numbering, tasks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lines_as_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as numbered rows: an order is a group of its own file, lines come by ship date and part."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_returnflag")
    rows = dealt(rows, line_tasks(spark, folder), "l_orderkey")
    return rows.select(
        F.col("l_orderkey").alias("file_id"), (F.row_number().over(order) - 1).cast("long").alias("input_index"),
        F.row_number().over(order).cast("long").alias("row_number"), F.col("l_orderkey").cast("string").alias("group_raw"),
        F.col("l_linenumber").cast("string").alias("ordinal_raw"), F.col("l_returnflag").alias("text"),
    )


def line_tasks(spark: SparkSession, folder: str) -> int | None:
    """How many tasks the order lines are dealt to; the count reads no column."""
    return tasks(table(spark, folder, "lineitem"))


def order_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Counts (grp, n): the highest line number of each order."""
    lines = dealt(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), line_tasks(spark, folder), "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("grp")).agg(F.max("l_linenumber").cast("long").alias("n"))


def order_index(spark: SparkSession, folder: str) -> DataFrame:
    """The numbering of all orders by their highest line numbers."""
    return numbering(order_sizes(spark, folder), line_tasks(spark, folder))


def pairs_by_start(spark: SparkSession, folder: str) -> DataFrame:
    """Documents (doc_id, text, other): each with the first document of those that start alike, if that is another."""
    docs = table(spark, folder, "documents").select("doc_id", "text").where("text IS NOT NULL")
    start = F.substring("text", 1, 20).alias("start")
    first = docs.groupBy(start).agg(F.min("doc_id").alias("first_id"))
    named = docs.select("doc_id", "text", start).join(first, "start").where("doc_id <> first_id")
    other = docs.select(F.col("doc_id").alias("first_id"), F.col("text").alias("other"))
    return named.join(other, "first_id").select("doc_id", "first_id", "text", "other")


def turns_as_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as numbered rows of one file."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.lit("c").alias("file_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("input_index"),
        (F.col("conv_id") * 1000 + F.col("turn") + 1).cast("long").alias("row_number"), (F.col("conv_id") + 1).cast("string").alias("group_raw"),
        (F.col("turn") + 1).cast("string").alias("ordinal_raw"), "text", "role",
    )
