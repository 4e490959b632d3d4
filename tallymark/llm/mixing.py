"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source and sources numbered by name in ranges, so that neither the
rows of a source nor the list of all sources lie in one task. Targets fill up to a cap: the
share of the sources that are open sets a level, those over their cap close at it, and the
level is set anew until none closes. A document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy whose probability is the fraction of the rate.

Nulls: a null text has size 0; a null source is a source of its own and comes last; a
null doc_id draws by the empty string. A draw is seeded by id and text, so rows that
share an id draw apart. Rows of a source equal in both are numbered, and the draw of the
k-th is turned on by k times the golden ratio, so that together they come near their
share whatever their number; which of them is the k-th is left open. An empty
table gives no rows. Other columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.operators.ranks import ranked

from .common import beside, checkpointed, columns_of, table

#: Weights that sources take in turn, in the order of their names.
WEIGHTS = (5, 2, 1)
#: Words in the mix over words in the input.
SHARE = 1.5
#: Most times that a source is repeated.
MOST = 2
SEED = "mix-1"
#: What the draws of equal rows differ by; its multiples fill the unit evenly.
TURN = 0.6180339887498949
#: Repeated keys up to which they are broadcast (under 10 MB).
BROADCAST_KEYS = 100_000
#: Targets are broadcast up to so many sources (under 8 MB), and joined beyond.
BROADCAST_SOURCES = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def _size(text: str) -> Column:
    """Words of the text named."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def _numbered(sums: DataFrame) -> DataFrame:
    """``sums`` with ``turn``, the place of each source by code point, null last: by ranges, then within them."""
    ranges = checkpointed(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    # one row a range, as many as partitions
    counts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("turn", F.col("inside") + F.col("before"))


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (source, source_size long, target double), one a source.

    A source is full at ``most`` times its size; what is over goes to the others by
    weight. Each pass closes one source at least and leaves one row on the driver.
    """
    sums = docs.select("source", _size("text").alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    rows = checkpointed(_numbered(sums).select("source", "source_size", weight.alias("w"), cap.alias("cap")))
    total, width = rows.agg(F.sum("source_size"), F.sum("w")).first()
    left = float(total or 0) * share
    closed, level, open_left, open_width = 0, 0.0, left, width or 1.0
    while open_width > 0:
        level = open_left / open_width
        # full where its share of what is left reaches its cap
        full = rows.where(F.lit(open_left) * F.col("w") >= F.col("cap") * F.lit(open_width))
        n, caps, widths = full.agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if n == closed:
            break
        closed, open_left, open_width = n, left - caps, (width or 0.0) - widths
    capped = F.least(F.col("cap"), F.lit(level) * F.col("w")) if open_width > 0 else F.col("cap")
    if open_width > 0:
        capped = F.when(F.lit(open_left) * F.col("w") >= F.col("cap") * F.lit(open_width), F.col("cap")).otherwise(capped)
    return rows.select("source", "source_size", capped.alias("target"))


def _among_equals(rows: DataFrame) -> DataFrame:
    """Rows with ``k``, their number among those that share their ``key``, from 1.

    Most keys have one row. Those of the others are found by counts, and only their rows are
    dealt out and numbered, in ranges, so that not all equal rows meet in one task.
    """
    again = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("again")))
    n = again.count()
    if not n:
        return rows.withColumn("k", F.lit(1))
    told = rows.join(F.broadcast(again) if n <= BROADCAST_KEYS else again, "key", "left")
    once = told.where("again IS NULL").drop("again").withColumn("k", F.lit(1))
    more = told.where("again").drop("again").withColumn("at", F.monotonically_increasing_id())
    return once.unionByName(ranked(more, ["key"], [F.col("at")], "k").drop("at"))


def _planned(docs: DataFrame, seed: str, **how) -> DataFrame:
    """Rows (row, source_size, target, copies): ``docs`` as structs, and what the mix takes of each."""
    aims = checkpointed(targets(docs, **how)).select(F.col("source").alias("name"), "source_size", "target")
    if aims.count() <= BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    id_, text = (F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("")) for c in ("doc_id", "text"))
    seeded = F.md5(F.concat(F.lit(seed + ":"), id_, F.lit(":"), text))
    rows = docs.select(beside(docs).alias("row")).withColumn("seeded", seeded)
    rows = rows.withColumn("key", F.concat("seeded", F.hex(F.xxhash64(F.col("row.source"))), F.col("row.source").isNull().cast("string")))
    joined = _among_equals(rows).join(aims, F.col("row.source").eqNullSafe(F.col("name")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    first = F.conv(F.substring("seeded", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    turned = first + (F.col("k") - 1) * F.lit(TURN)
    draw = turned - F.floor(turned)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select("row", "source_size", "target", copies.alias("copies"))


def plan(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken): what the mix takes of each row."""
    out = _planned(docs.select("doc_id", "text", "source"), seed, **how)
    size = _size("row.text")
    return out.select(F.col("row.doc_id").alias("doc_id"), size.alias("size"), "source_size", "target", (size * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    out = _planned(docs, seed, **how).where("copies > 0")
    out = out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*columns_of("row", docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sums),
filled AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
  FROM weighed),
level AS (
  SELECT arg_max(rest, w_rest) AS rest, max(w_rest) AS w_rest FROM filled WHERE NOT rest * w >= cap * w_rest),
aims AS (
  SELECT source, source_size,
    CASE WHEN f.rest * w >= cap * f.w_rest THEN cap ELSE least(cap, level.rest / level.w_rest * w) END AS target
  FROM filled f LEFT JOIN level ON true),
turned AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
      + (row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), sized.source) - 1) * 0.6180339887498949::DOUBLE AS turn
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source),
drawn AS (SELECT *, turn - floor(turn) AS draw FROM turned)
SELECT doc_id, size, source_size, target,
  size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM drawn
"""
