"""A reference service's answers, landed as tables, and what is looked up in them.

Answers are landed by whoever may reach the service; nothing here opens a connection. A
catalog has one row a book, a book one row of bibliographic data, and texts come by group
(book, grp, ord, html, source_url, retrieved_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST_BOOK = 1_000_000_000
#: What every looked-up row claims, and doesn't.
CLAIMS = {"verification_status": "verified", "source_kind": "landed-reference", "retention": "session-only", "publication_ready": "false"}


def listed_books(catalog: DataFrame, language: str) -> DataFrame:
    """Rows (book, title, full_title, description, language) of a catalog (place, id, language, name, short_name, card).

    Books of other languages, without a valid id or without a title are left out; of rows
    that share an id the first counts.
    """
    if not T.is_language(language):
        raise ValueError("the language must be a code such as en or pt-br")
    book = T.bounded_integer(F.col("id"), 1, MOST_BOOK)
    title = T.html_to_text(F.coalesce(F.when(T.trimmed(F.col("short_name")) != "", F.col("short_name")), F.col("name")))
    fine = catalog.select("place", book.alias("book"), title.alias("title"), T.html_to_text(F.col("name")).alias("full_title"),
                          T.html_to_text(F.coalesce("card", F.lit(""))).alias("description"), "language")
    fine = fine.where(F.col("book").isNotNull() & (F.col("language") == language) & (F.coalesce("title", F.lit("")) != ""))
    first = Window.partitionBy("book").orderBy("place")
    return fine.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "place")


def book_metadata(records: DataFrame, book: int, language: str) -> DataFrame:
    """One row of the book's record (id, language, name, author, translator, publisher, edition, year), none if it isn't that book.

    Its digest stands for the whole record; a placeholder counts as not stated.
    """
    given = ["name", "author", "translator", "publisher", "edition"]
    told = [F.nullif(T.known_attribution(T.html_to_text(F.col(c))), F.lit("")).alias(c) for c in given]
    digest = F.sha2(F.to_json(F.struct("id", "language", *given, "year")), 256).alias("record_sha256")
    return records.where((F.col("id") == book) & (F.col("language") == language)).select(F.col("id").alias("book"), "language", *told, "year", digest)


def requested(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted, skipped) of rows (row_number, group_raw, ordinal_raw): one row an identifier, the last one; and rows without a valid one."""
    keyed = rows.select("row_number", "group_raw", "ordinal_raw", T.strict_integer(F.col("group_raw").cast("string")).alias("grp"), T.strict_integer(F.col("ordinal_raw").cast("string")).alias("ord"))
    keyed = keyed.join(index.select("grp", "n"), "grp", "left")
    valid = F.coalesce(F.col("ord").between(1, F.col("n")), F.lit(False))
    wanted = keyed.where(valid).groupBy("grp", "ord").agg(F.max("row_number").alias("row_number"))
    skipped = keyed.where(~valid).select("row_number", "group_raw", "ordinal_raw", F.lit("invalid-id").alias("reason"))
    return wanted, skipped


def sound_groups(texts: DataFrame, most: int) -> DataFrame:
    """Groups of landed texts with ``fault``: what makes an answer unusable as a whole, null if nothing does."""
    number = F.coalesce(F.col("ord").between(1, most), F.lit(False))
    per_id = texts.groupBy("grp", "ord").agg(F.count("*").alias("n"), F.bool_and(number & T.meaningful(F.col("html"))).alias("fine"))
    groups = per_id.groupBy("grp").agg(F.sum("n").alias("rows"), F.max("n").alias("copies"), F.bool_and("fine").alias("fine"))
    fault = F.when(F.col("rows") > most, "too_many_rows").when(F.col("copies") > 1, "repeated_identifier").when(~F.col("fine"), "invalid_identifier_or_text")
    return groups.select("grp", "rows", fault.alias("fault"))


def looked_up(wanted: DataFrame, texts: DataFrame, body: Column) -> DataFrame:
    """Wanted identifiers with their reference: body (text, notes, prefix_removed, anchors_removed, kept_as_sent) and hashes, nulls where none is landed.

    ``body`` reads a landed row; the reading and the row as it was sent have a digest each.
    """
    read = texts.select("grp", "ord", "html", "source_url", "retrieved_at", body.alias("b"))
    read = read.select(
        "grp", "ord", "source_url", "retrieved_at", "b.*", F.sha2("b.text", 256).alias("normalized_sha256"), F.sha2("html", 256).alias("raw_sha256"),
        F.concat_ws(":", F.col("grp").cast("string"), F.col("ord").cast("string")).alias("locator"), *[F.lit(v).alias(k) for k, v in CLAIMS.items()],
    )
    return wanted.join(read, ["grp", "ord"], "left").withColumn("found", F.col("raw_sha256").isNotNull())


def coverage(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a lookup: requested, covered, missing (with whether any is), and what the reading removed."""
    return found.groupBy(*by).agg(
        F.count("*").alias("requested"), F.count_if("found").alias("covered"), F.count_if(~F.col("found")).alias("missing"), F.bool_or(~F.col("found")).alias("partial"),
        F.count_if(F.coalesce("prefix_removed", F.lit(False))).alias("prefix_rows"), F.coalesce(F.sum("anchors_removed"), F.lit(0)).alias("anchors_removed"),
        F.count_if(F.coalesce("kept_as_sent", F.lit(False))).alias("kept_as_sent"),
    )


def display_texts(texts: DataFrame, index: DataFrame, pinned_sha256: str) -> DataFrame:
    """Texts (grp, ord, text) for display only: all of them if their digest is the pinned one and they fill the index, none otherwise.

    The digest covers the lines "grp|ord|text" by group, so that it is formed from one short
    digest a group, whatever the length of the texts.
    """
    line = F.concat_ws("|", F.col("grp").cast("string"), F.col("ord").cast("string"), "text")
    groups = texts.groupBy("grp").agg(F.count("*").alias("rows"), F.countDistinct("ord").alias("ords"), F.max("ord").alias("last"),
                                      F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("sha"))
    shape = groups.join(index.select("grp", "n"), "grp", "full").agg(
        F.bool_and(F.coalesce((F.col("rows") == F.col("n")) & (F.col("ords") == F.col("n")) & (F.col("last") == F.col("n")), F.lit(False))).alias("whole"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "sha"))), lambda x: x["sha"]), "\n"), 256).alias("sha"),
    )
    sound = shape.where(F.col("whole") & (F.col("sha") == pinned_sha256))
    return texts.join(F.broadcast(sound.select(F.lit(1).alias("sound"))), how="cross").drop("sound")  # one row at most
