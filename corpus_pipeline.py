"""A pipeline from raw documents to token ids, each stage one operator of tallymark.llm.

Toxic documents go; lines of recurring templates stay in one document only, and documents
that consist of nothing else go; of near duplicates (five-word shingles, Jaccard 0.8) the
smallest id stays; sources are mixed to their target weights, rows repeated as often as the
mix takes them; every row is encoded. All stages but the last return the columns of
documents. Nulls, ties and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, jaccard, mixing, templates, toxicity
from tallymark.llm.common import table, written

#: SQL has no form of the classifier, the line templates or the encoding.
ORACLE_SQL = None

NEAR_WORDS = 5
NEAR_PERCENT = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled ones among them, doesn't call toxic."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that recur across documents; n_chars follows the text."""
    out = templates.dedup(docs, drop_empty=True)
    if "n_chars" not in docs.columns:
        return out
    counted = F.coalesce(F.length("text").cast("long"), F.col("n_chars")).alias("n_chars")
    return out.select(*[counted if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates."""
    return jaccard.dedup(docs, NEAR_WORDS, NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    return bpe.encode(docs, bpe.default_path(), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("lines", without_recurring_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage keeps is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
