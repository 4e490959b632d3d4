"""Queries on canonical JSON: rows as objects, their sorted form and its digest, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import with_canonical
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_PRICE = "regexp_replace({0}::VARCHAR, '\\.0$', '')"
_LINES = "list('{\"n\":' || l_linenumber || ',\"price\":' || " + _PRICE.format("l_extendedprice") + " || ',\"tax\":' || " + _PRICE.format("l_tax") + " || '}' ORDER BY l_linenumber, l_extendedprice, l_tax)"
_ORDER = f"""WITH l AS (SELECT l_orderkey, '[' || array_to_string({_LINES}, ',') || ']' AS lines FROM lineitem GROUP BY 1),
  o AS (SELECT o_orderkey, '{{"customer":' || o_custkey || {{0}} || ',"lines":' || coalesce(lines, 'null') || ',"priority":"' || o_orderpriority || '","total":' || {_PRICE.format("o_totalprice")} || '}}' AS said FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)"""


def _orders(spark, d):
    """Orders as objects, their lines within, and the day on which they were made."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax")))).alias("lines")
    )
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    said = F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), "lines", F.date_format("o_orderdate", "yyyy-MM-dd").alias("generatedAt"), F.col("o_custkey").alias("customer"))
    return orders.select("o_orderkey", said.alias("order"))


@query(_ORDER.replace("{0}", "',\"generatedAt\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"'") + " SELECT o_orderkey, said AS json, sha256(said) AS digest FROM o")
def canonical_orders(spark, d):
    """Orders with their lines as canonical JSON, and its digest."""
    return with_canonical(_orders(spark, d), "order", "json", digest="digest").select("o_orderkey", "json", "digest")


@query(_ORDER.replace("{0}", "''") + " SELECT o_orderkey, sha256(said) AS digest FROM o")
def semantic_digests(spark, d):
    """Digests of what orders say, without the time of making."""
    return with_canonical(_orders(spark, d), "order", "json", semantic=True, digest="digest").select("o_orderkey", "digest")


_KEY = "coalesce(lang, '') || '_text'"
_SAID = "'\"' || " + _KEY + " || '\":' || coalesce(to_json(text)::VARCHAR, 'null')"
_FROM = "'\"source\":' || coalesce(to_json(source)::VARCHAR, 'null')"


@query(f"SELECT doc_id, sha256('{{' || CASE WHEN {_KEY} < 'source' THEN {_SAID} || ',' || {_FROM} ELSE {_FROM} || ',' || {_SAID} END || '}}') AS digest FROM documents")
def canonical_documents(spark, d):
    """Whole texts under the name of their language: objects whose keys are known by row only."""
    said = F.create_map(F.concat(F.coalesce("lang", F.lit("")), F.lit("_text")), F.col("text"), F.lit("source"), F.col("source"))
    return with_canonical(table(spark, d, "documents").select("doc_id", said.alias("said")), "said", "json", digest="digest").select("doc_id", "digest")
