"""Labelled samples for the classifiers: bounded, chosen by hash, without the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Rows (place, text, label), at most ``most``: labelled ids outside the held-out fold, one text an id.

    The ids come from the labels table alone, by the order of a hash, so the sample is the
    same at each run and its size, and with it what is broadcast, is fixed. An id with more
    than one text gives the smallest; one labelled more than once counts as 1 if any of its
    labels is 1; null labels and ids are left out. ``place`` orders rows by their texts,
    whatever their ids and however they came: equal places have equal texts.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
        .where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select(F.sha2("text", 256).alias("place"), "text", "label")
