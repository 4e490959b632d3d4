"""Numbers in a global order within keys, of which none has to fit in one task.

Rows are dealt to ranges of (key, order) and sorted there; their place in the range is kept
with them. A key's rows in one range lie together, so a row's number is its place behind the
first of them, and what the key has in the ranges before. No window holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .index import dealt

#: So many pairs of a key and a range are broadcast; with more keys a window numbers the rows of each pair.
BROADCAST_FIRSTS = 100_000
#: The bits of Spark's increasing ids that number the rows of one partition; those above number the partitions.
_BITS = 33


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str, many: int | None = None) -> DataFrame:
    """The rows with ``name``: their number, from 1, in the order of their key; rows alike in all of it in any order.

    The ranges come from a sample, so the dealt rows are written once and read from there.
    There are ``many`` of them, or the session's number of partitions.
    """
    places = [*[F.col(f"`{c}`").asc_nulls_first() for c in by], *order]
    ranges = rows.repartitionByRange(*places) if many is None else rows.repartitionByRange(many, *places)
    placed = written(ranges.sortWithinPartitions(*places).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    placed = placed.withColumn("__range", F.shiftright("__at", _BITS))
    # a number stands for the key, as keys may be null
    key = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.lit(0)
    firsts = placed.groupBy(key.alias("__of"), F.col("__range").alias("__in")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__of").orderBy("__in")) - F.col("__n")
    firsts = written(firsts.select(F.xxhash64("__of").alias("__hash"), "__of", "__in", "__first", before.alias("__before")), "firsts")
    if firsts.count() <= BROADCAST_FIRSTS:
        within = F.col("__at") - F.col("__first") + 1
    else:
        # of a range only its first key lies in ranges before, too
        firsts = firsts.where("__before > 0")
        placed = dealt(placed, many, *by, "__range").withColumn("__within", F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__at")))
        within = F.col("__within")
    placed = placed.withColumn("__key", key).withColumn("__h", F.xxhash64("__key"))
    same = (F.col("__h") == F.col("__hash")) & (F.col("__range") == F.col("__in")) & F.col("__key").eqNullSafe(F.col("__of"))
    out = placed.join(F.broadcast(firsts), same, "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (within + F.coalesce("__before", F.lit(0))).alias(name))
