"""Points in intervals by equality: intervals cut to cells of a power of two, and the exact test behind.

``marked`` tells for each point whether any interval of its group holds it. Intervals are
merged where they overlap and cut to cells of one width, a row each with what lies in it; a
point meets one cell at most, so points are neither multiplied nor crossed with intervals.
``joined`` gives every pair. An interval is as wide as a cell of its own level or less, so it
lies in two cells at most, and a point looks into one cell of each level that there is. Levels
are four bits apart: a point moves once for each, while what a wider cell adds is tested in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a position within a cell of ``marked``, and of the widest cells of ``joined``.
CELL, WIDEST = 12, 20
#: Levels of ``joined`` lie so many bits apart, so a point looks into few cells: six at most.
STEP = 4
#: Cells up to which they are broadcast (under 64 MB); beyond, they meet points by shuffle.
BROADCAST_CELLS = 500_000


def merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint intervals (by..., first, last) that hold what the given ones hold; those that are null or end before they begin hold nothing."""
    fine = intervals.where("first <= last").select(*by, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    order = Window.partitionBy(*by).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # in two steps by cells of the first position would spare the window by group; scopes are a row an interval
    fresh = F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("long")
    islands = fine.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(order))
    return islands.groupBy(*by, "__island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__island")


def cut(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., cell, parts) of disjoint intervals: what lies in each cell of 2^CELL positions, in order."""
    cell = F.explode(F.sequence(F.shiftright("first", CELL), F.shiftright("last", CELL)))
    rows = intervals.withColumn("cell", cell)
    begin = F.shiftleft("cell", CELL)
    part = F.struct(F.greatest("first", begin).alias("first"), F.least("last", begin + (1 << CELL) - 1).alias("last"))
    # disjoint parts of a cell are at most as many as its positions
    return rows.groupBy(*by, "cell").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def _met(points: DataFrame, cells: DataFrame, keys: list[str], how: str) -> DataFrame:
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    return points.join(F.broadcast(cells) if small else cells, keys, how)


def marked(points: DataFrame, intervals: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """The points with ``name``: whether an interval (by..., first, last) holds the position ``at``; false for nulls."""
    place = cut(merged(intervals, by), by).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("cell").alias("__cell"), F.col("parts").alias("__parts"))
    keyed = points.withColumns({f"__{c}": F.col(c) for c in by} | {"__cell": F.shiftright(F.col(at).cast("long"), CELL)})
    out = _met(keyed, place, [*[f"__{c}" for c in by], "__cell"], "left")
    inside = F.exists("__parts", lambda p: F.col(at).between(p["first"], p["last"]))
    return out.select(*[F.col(f"`{c}`") for c in points.columns], F.coalesce(inside, F.lit(False)).alias(name))


def _level(width: Column) -> Column:
    """The least multiple k of STEP with 2^k >= width, at most WIDEST."""
    bits = F.length(F.bin(width - 1)) * (width > 1).cast("int")
    return F.least(F.ceil(bits / STEP).cast("int") * STEP, F.lit(WIDEST))


def joined(points: DataFrame, intervals: DataFrame, by: list[str], at: str) -> DataFrame:
    """Every pair of a point and an interval (by..., first, last, ...) of its group that holds the position ``at``.

    Columns are those of the points, then those of the intervals that aren't in ``by``.
    """
    fine = intervals.where("first <= last").withColumn("__level", _level(F.col("last") - F.col("first") + 1))
    levels = [r[0] for r in fine.select("__level").distinct().collect()]  # WIDEST / STEP + 1 at most
    if not levels:
        levels = [0]
    shifted = lambda c, k: F.call_function("shiftright", F.col(c).cast("long"), k)
    cells = fine.withColumn("__cell", F.explode(F.sequence(shifted("first", F.col("__level")), shifted("last", F.col("__level")))))
    looks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), shifted(at, F.lit(k)).alias("cell")) for k in sorted(levels)]))
    keyed = points.withColumn("__look", looks).withColumns({"__level": F.col("__look.k"), "__cell": F.col("__look.cell")}).drop("__look")
    out = _met(keyed, cells, [*by, "__level", "__cell"], "inner").where(F.col(at).between(F.col("first"), F.col("last")))
    return out.select(*[F.col(f"`{c}`") for c in points.columns], *[F.col(f"`{c}`") for c in intervals.columns if c not in by])
