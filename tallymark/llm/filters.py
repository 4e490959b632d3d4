"""Filter interaction audit: what each filter removes, loses and repeats, in every order of the filters.

A document is the set of filters that it fails, so all documents of a part come down to at
most 2^k counted masks. The step at which an order removes a mask is the min-plus product of
the mask matrix (0 where a filter fails, infinite elsewhere) and the matrix of the filters'
places in the orders (the inverse permutations): the least place of a failing filter. Counts
are then scattered by that step; what fails a later filter is redundant there.

Masks are read off the texts by DataFrame functions. Copies are told without a window over
copies: the least id of each text is one row, and a document is the first of its text if it
meets that row on text and id, a key that no group of copies shares. Counts come first.

A null text is the empty text; a null lang is the part ''. Several label rows of one id count
as one that has what any of them has; a null or other label counts as neither. A null doc_id
has no labels, and is no copy, nor is any text a copy of it. Rows that repeat an id and text
don't make each other copies. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, ready, table

#: The filters, in the order of their bits. The last one needs the whole table.
FILTERS = "ABCDE"
#: Words that a text must have; least percentage of distinct words; most percentage of capitals.
WORDS, DISTINCT, CAPITALS = 100, 80, 10

_WORD = r"[^\x20\x09-\x0D]+"
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_masks(text: Column) -> Column:
    """The bits of the filters that judge a text alone."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < WORDS, 100 * different < DISTINCT * n, 100 * capitals.cast("long") > CAPITALS * F.length(text), text.rlike(r"[#$%&*|]")]
    bits = [F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of each part by the filters they fail, and how many of them are labelled so."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_masks(text).alias("mask")
    )
    # equal rows are one with a count, so none of them is hot further on
    rows = Written(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "filter-rows").df
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copied = F.when(F.col("first").isNull(), F.lit(1 << (len(FILTERS) - 1))).otherwise(0)
    known = known.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", "n", (F.col("mask") + copied).alias("mask"))
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has("quality").alias("good"), has("toxic").alias("bad"))
    keyed = known.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(marks, "doc_id", "left").drop("doc_id")
    keyed = keyed.unionByName(rows.where("doc_id IS NULL").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("bad")))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return keyed.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("bad").alias("toxic"))


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, counts...) of rows (part, mask, n, good, toxic), for all orders of the filters.

    kept: after the step; removed: at it; redundant: failing its filter, removed earlier;
    unique_fails: failing its filter only; good_lost and toxic_lost: of those removed;
    shapley: what its filter removes, summed over all orders.
    """
    ready(masks.sparkSession)
    k = len(filters)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        orders = np.array(list(permutations(range(k))))
        # the place of each filter in each order, its inverse
        places = np.argsort(orders, axis=1)
        names = ["".join(filters[f] for f in order) for order in orders]
        for batch in batches:
            for part, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mask = np.array([m["mask"] for m in listed])
                weights = np.array([[m["n"], m["good"], m["toxic"]] for m in listed], np.int64)
                fails = (mask[:, None] >> np.arange(k)) & 1
                # min-plus: masks x orders; a mask that fails nothing is removed at no step, which is step k
                steps = np.minimum(np.where(fails, 0, k)[:, None, :] + places[None, :, :], k).min(axis=2)
                removed = np.zeros((len(orders), k + 1, 3), np.int64)
                np.add.at(removed, (np.arange(len(orders))[None, :], steps), weights[:, None, :])
                failing = weights[:, 0] @ fails
                alone = weights[:, 0] @ (fails * (fails.sum(axis=1, keepdims=True) == 1))
                gone = removed[:, :k, 0]
                kept = weights[:, 0].sum() - gone.cumsum(axis=1)
                shapley = np.zeros(k, np.int64)
                np.add.at(shapley, orders, gone)
                columns = [kept, gone, failing[orders] - gone, alone[orders], removed[:, :k, 1], removed[:, :k, 2], shapley[orders]]
                rows = len(orders) * k
                arrays = [pa.array([part] * rows, pa.string()), pa.array(np.repeat(names, k).tolist(), pa.string()), pa.array(np.tile(np.arange(1, k + 1), len(orders)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c.ravel(), pa.int64()) for c in columns]], [c.split()[0] for c in _SCHEMA.split(", ")])

    # at most 2^k rows a part
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return parts.mapInArrow(run, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(counted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copied FROM documents),
marks AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN copied THEN 'E' ELSE '' END) AS fails
  FROM texts LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(f) WHERE length(o) < 5 AND NOT contains(o, f)),
steps AS (SELECT o, s AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) AS t(s) WHERE length(o) = 5),
each AS (
  SELECT part, o, step, f,
    sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM each
"""
