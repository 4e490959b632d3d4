"""The numbering index: how many ordinals each group has, and identifiers in its terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Groups whose running sums are taken together.
STRIDE = 1 << 16
#: Rows that one task of a shuffle by identifier gets; more rows are dealt to more tasks.
ROWS_A_TASK = 1 << 19


def tasks(rows: DataFrame) -> int | None:
    """How many tasks the rows of a table are dealt to by key; None if the session's number of partitions is enough."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-rows.count() // ROWS_A_TASK)
    return wanted if wanted > least else None


def dealt(rows: DataFrame, many: int | None, *by: str) -> DataFrame:
    """The rows by key in so many tasks, so that sorts and sums of one don't grow with the table; as they are for None."""
    return rows if many is None else rows.repartition(many, *by)


def numbering(counts: DataFrame, many: int | None = None) -> DataFrame:
    """Rows (grp, n, base) of counts (grp, n): base is the number of ordinals before the group.

    Groups with a null or non-positive count hold nothing and are left out. The running sum
    has two levels: within strides of the group number, and over one sum a stride, so no
    task sorts all groups. Strides that are too many for the session's partitions go to ``many`` tasks.
    """
    counts = counts.where("grp IS NOT NULL AND n > 0").select(F.col("grp").cast("long"), F.col("n").cast("long"))
    counts = dealt(counts.withColumn("__stride", F.floor(F.col("grp") / STRIDE)), many, "__stride")
    before = Window.orderBy("__stride").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("__stride").agg(F.sum("n").alias("__n"))
    sums = sums.select("__stride", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__stride").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("__within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, "__stride")
    return out.select("grp", "n", (F.col("__before") + F.col("__within")).cast("long").alias("base"))


def expected(index: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows (grp, ord, position): every identifier of the index, or of the given groups (grp)."""
    if groups is not None:
        index = index.join(groups.select("grp").distinct(), "grp", "left_semi")
    ords = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("ord")
    return index.select("grp", "base", ords).select("grp", "ord", (F.col("base") + F.col("ord")).alias("position"))


def identifier(grp: Column, ord_: Column) -> Column:
    return F.concat_ws(":", grp.cast("string"), ord_.cast("string"))
