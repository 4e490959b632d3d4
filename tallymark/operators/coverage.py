"""Coverage of whole files by bitmaps: which identifiers of a scope each file lacks.

A bitmap has one bit for each of 32,768 consecutive positions of the index, so a file of any
numbering is a row of 4 KB for every such bucket it touches, whatever the number of its rows.
The index is cut to the same buckets, as cells: the part of a group that lies in a bucket. A
bucket meets its cells by equality, and the runs of a cell that no bit covers are read off
the words of the bitmap; words that are full are passed over as one. No identifier that is
expected becomes a row, and files aren't crossed with groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .index import dealt

#: Bits of a bitmap of Spark's bitmap functions, and of the words it is read by.
BITS, WORD = 32_768, 32
#: Groups of an index whose cells are broadcast (at most some 32 MB of them); beyond, buckets are joined by shuffle.
SMALL_INDEX = 1_000_000

_FULL = (1 << WORD) - 1


def bitmaps(rows: DataFrame, when: Column | None = None, many: int | None = None) -> DataFrame:
    """Rows (file_id, bucket, bits, claims): positions of keyed rows by file, and how many rows claim them.

    ``when`` restricts the rows, to valid ones by default; those without a position never count.
    Rows of many tasks have a bit or two in each bucket: ``many`` deals them out by bucket first,
    once for each position, so that bitmaps are made in one place and none is moved.
    """
    kept = rows.where(F.col("position").isNotNull() & (F.col("valid") if when is None else when))
    kept = kept.select("file_id", "grp", "position", F.expr("bitmap_bucket_number(position)").alias("bucket"))
    claims = F.count("*")
    if many is not None:
        kept = dealt(kept.groupBy("file_id", "grp", "position", "bucket").agg(F.count("*").alias("claims")), many, "file_id", "bucket")
        claims = F.sum("claims")
    return kept.groupBy("file_id", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits"), claims.alias("claims"))


def cells(index: DataFrame, groups: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """Rows (bucket, cells): the groups of the index, or of the scope, that lie in each bucket.

    A cell is struct(lo, hi, grp, shift): its first and last bit, and what turns a bit into an ordinal.
    """
    scope = index if groups is None else index.join(groups.select("grp").distinct(), "grp", "left_semi")
    first, last = F.col("base"), F.col("base") + F.col("n") - 1  # from 0
    buckets = F.sequence(F.floor(first / BITS), F.floor(last / BITS))
    cut = scope.where("n > 0").select("grp", "base", first.alias("first"), last.alias("last"), F.explode(buckets).alias("b"))
    begin = F.col("b") * BITS
    cell = F.struct(
        (F.greatest("first", begin) - begin).cast("int").alias("lo"), (F.least("last", begin + BITS - 1) - begin).cast("int").alias("hi"), "grp",
        (begin - F.col("base") + 1).alias("shift"),
    )
    # at most BITS of them, as each holds a bit of its own
    return dealt(cut.withColumn("bucket", F.col("b") + 1), many, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def _words(bits: Column) -> Column:
    """The bitmap as whole numbers of 32 bits, its first byte the highest."""
    word = lambda w: F.conv(F.hex(F.substring(bits, w * 4 + 1, F.lit(4))), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(BITS // WORD - 1)), word)


def _open_runs(words: Column, cell: Column) -> Column:
    """array(struct(grp, first, last, touches)): ordinals of the cell's runs of bits that aren't set, in order."""
    lo, hi = cell["lo"], cell["hi"]

    def unset(p: Column) -> Column:
        # bit p is bit p % 8 of byte p / 8, and the first byte of a word is its highest
        place = F.lit(24) - F.shiftright(p, 3).bitwiseAND(3) * 8 + p.bitwiseAND(7)
        return F.call_function("shiftright", F.get(words, F.shiftright(p, 5)), place).bitwiseAND(1) == 0

    holes = F.filter(F.sequence(F.shiftright(lo, 5), F.shiftright(hi, 5)), lambda w: F.get(words, w) != _FULL)

    def ends(step: int, border: Column) -> Column:
        """Bits that aren't set while the next one on that side is, or lies outside the cell."""
        at_end = lambda p: unset(p) & ((p == border) | ~unset(p + step))
        within = lambda w: F.filter(F.sequence(F.greatest(lo, w * WORD), F.least(hi, w * WORD + WORD - 1)), at_end)
        return F.flatten(F.transform(holes, within))

    ordinal = lambda p: p.cast("long") + cell["shift"]
    # at a border of the bucket, and the group goes on behind it
    touches = lambda a, b: ((a == 0) & (cell["shift"] > 1)) | (b == BITS - 1)
    run = lambda a, b: F.struct(cell["grp"].alias("grp"), ordinal(a).alias("first"), ordinal(b).alias("last"), touches(a, b).alias("touches"))
    return F.zip_with(ends(-1, lo), ends(1, hi), run)


def missing_runs(rows: DataFrame, index: DataFrame, groups: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """Rows (file_id, grp, first, last, size): runs of ordinals of the scope that a file of keyed rows doesn't have.

    Every file of ``rows`` counts, also one without a valid row. Runs that reach the border of a
    bucket are joined with what follows them; only these, two a bucket, meet by group. Bitmaps
    and cells are dealt to ``many`` tasks.
    """
    place = cells(index, groups, many)
    files = rows.select("file_id").distinct()
    # the scope's buckets, at most one for each 32,768 identifiers of the index
    span = place.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    if span.low is None:
        return files.limit(0).select("file_id", *[F.lit(None).cast("long").alias(c) for c in ("grp", "first", "last", "size")])
    wanted = files.select("file_id", F.explode(F.sequence(F.lit(span.low), F.lit(span.high))).alias("bucket"))
    have = bitmaps(rows, many=many).select("file_id", "bucket", "bits")
    if index.count() <= SMALL_INDEX:
        place = F.broadcast(place)
    both = wanted.join(have, ["file_id", "bucket"], "left").join(place, "bucket")
    both = both.withColumn("words", _words(F.coalesce("bits", F.lit(bytes(BITS // 8)))))
    open_ = F.flatten(F.transform("cells", lambda cell: _open_runs(F.col("words"), cell)))
    runs = written(both.select("file_id", F.explode(open_).alias("run")).select("file_id", "run.*"), "runs")
    # what touches no border is whole, and meets nothing
    alone = runs.where("NOT touches").select("file_id", "grp", "first", "last")
    runs = runs.where("touches")
    by = ["file_id", "grp"]
    order = Window.partitionBy(*by).orderBy("first")
    fresh = F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("long")
    runs = runs.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    out = runs.groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")
    return alone.unionByName(out).withColumn("size", F.col("last") - F.col("first") + 1)


def coverage(rows: DataFrame, index: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row a file of keyed rows: identifiers expected, covered, missing, out of scope, and rows that claim one again.

    Rows are read once, and an identifier is either in scope or not. Rows without one are in no bucket.
    """
    # rows without a bit set none
    inside, outside = F.col("valid") & F.col("in_scope"), F.col("valid") & ~F.col("in_scope")
    bit, bucket = F.bitmap_bit_position("position"), F.when(F.col("valid"), F.bitmap_bucket_number("position"))
    every = rows.groupBy("file_id", bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.when(inside, bit)).alias("inside"), F.bitmap_construct_agg(F.when(outside, bit)).alias("outside"),
        F.count("*").alias("rows"), F.count_if("valid").alias("valid"),
    )
    every = every.groupBy("file_id").agg(
        F.sum("rows").alias("total_rows"), F.sum("valid").alias("valid_rows"),
        F.sum(F.bitmap_count("inside")).alias("covered_ids"), F.sum(F.bitmap_count("outside")).alias("out_of_scope_ids"),
    )
    scope = index if groups is None else index.join(groups.select("grp").distinct(), "grp", "left_semi")
    expected = scope.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("expected_ids"))
    out = every.join(F.broadcast(expected), how="cross")  # one row
    percent = F.when(F.col("expected_ids") > 0, (F.col("covered_ids") * 100 / F.col("expected_ids")).cast("decimal(20,10)")).otherwise(0)
    return out.select(
        "file_id", "total_rows", "valid_rows", "expected_ids", "covered_ids", (F.col("expected_ids") - F.col("covered_ids")).alias("missing_ids"),
        "out_of_scope_ids", (F.col("valid_rows") - F.col("covered_ids") - F.col("out_of_scope_ids")).alias("repeated_rows"),
        F.round(percent, 2).cast("double").alias("coverage_percent"),
    )
