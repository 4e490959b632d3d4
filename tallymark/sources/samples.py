"""Samples made by rule: a teaching file with known defects, and files for tests of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import TEACHING_PREFIX
from ..operators.index import expected

#: The groups of the teaching file and their numbers of rows.
TEACHING_GROUPS = {1: 7, 112: 4, 113: 5, 114: 6}
SENTENCE = "The sample process does not allow an unchecked action."


def teaching_reference(spark: SparkSession) -> DataFrame:
    """Rows (row_number, grp, ord, text) of the teaching reference, 22 in four groups."""
    sizes = spark.createDataFrame(list(TEACHING_GROUPS.items()), "grp long, n long")
    rows = sizes.select("grp", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("ord"))
    text = F.format_string(f"{TEACHING_PREFIX} %d:%d. {SENTENCE}", "grp", "ord")
    place = F.element_at(F.create_map(*[F.lit(x) for k, g in enumerate(TEACHING_GROUPS) for x in (g, sum(list(TEACHING_GROUPS.values())[:k]))]), F.col("grp").cast("int"))
    return rows.select((place + F.col("ord") + 1).alias("row_number"), "grp", "ord", text.alias("text"))


def teaching_rows(spark: SparkSession) -> DataFrame:
    """Rows (file_id, input_index, row_number, group_raw, ordinal_raw, text): the reference with known defects.

    The third row is gone, the fourth empty; one lost its negation; the first two changed
    places; a copy, a merged range and a group that doesn't exist come last.
    """
    kept = teaching_reference(spark).where("NOT (grp = 1 AND ord = 3)")
    at = F.when((F.col("grp") == 1) & (F.col("ord") <= 2), F.lit(5) - F.col("row_number")).otherwise(F.col("row_number"))
    text = (
        F.when((F.col("grp") == 1) & (F.col("ord") == 4), "")
        .when((F.col("grp") == 112) & (F.col("ord") == 2), F.replace("text", F.lit("does not allow"), F.lit("does allow"))).otherwise(F.col("text"))
    )
    rows = kept.select(at.cast("long").alias("at"), F.col("grp").cast("string").alias("group_raw"), F.col("ord").cast("string").alias("ordinal_raw"), text.alias("text"))
    added = [
        (101, "113", "1", f"{TEACHING_PREFIX}. A duplicated row for the file-review exercise."),
        (102, "114", "2-3", f"{TEACHING_PREFIX}. A merged range requiring manual alignment."),
        (103, "115", "1", f"{TEACHING_PREFIX}. An intentionally invalid chapter identifier."),
    ]
    rows = rows.unionByName(spark.createDataFrame(added, "at long, group_raw string, ordinal_raw string, text string"))
    # 24 rows: one task numbers them
    from pyspark.sql import Window

    place = (F.row_number().over(Window.orderBy("at")) - 1).cast("long")
    return rows.select(F.lit("teaching").alias("file_id"), place.alias("input_index"), (place + 2).alias("row_number"), "group_raw", "ordinal_raw", "text")


def numbered_file(index: DataFrame, text: str = "Sample text {id}. There are {ord} of them and it is not so.") -> DataFrame:
    """Rows (input_index, row_number, group_raw, ordinal_raw, text) for every identifier of an index: a sound file of any size."""
    rows = expected(index)
    body = F.lit(text)
    for name, value in (("{id}", F.concat_ws(":", F.col("grp").cast("string"), F.col("ord").cast("string"))), ("{ord}", F.col("ord").cast("string"))):
        body = F.replace(body, F.lit(name), value)
    return rows.select((F.col("position") - 1).alias("input_index"), (F.col("position") + 1).alias("row_number"), F.col("grp").cast("string").alias("group_raw"),
                       F.col("ord").cast("string").alias("ordinal_raw"), body.alias("text"))


#: What ``with_defects`` does to a row, by the remainder of its hash.
DEFECTS = ("deleted", "emptied", "duplicated", "negation_removed", "number_changed", "words_removed", "invalid_group", "markup_added")


def with_defects(rows: DataFrame, one_in: int = 50, seed: int = 0) -> DataFrame:
    """``rows`` with one defect in about one of so many, told in ``defect`` (null: untouched; deleted rows stay, to be left out).

    Rows are chosen and changed by a hash of their identifier, so each on its own.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "group_raw", "ordinal_raw"), F.lit(one_in * len(DEFECTS)))
    kind = F.when(draw < len(DEFECTS), F.element_at(F.array(*map(F.lit, DEFECTS)), (draw + 1).cast("int")))
    rows = rows.withColumn("defect", kind)
    is_ = lambda name: F.col("defect") == name
    text = (
        F.when(is_("emptied"), "").when(is_("negation_removed"), F.replace("text", F.lit(" not "), F.lit(" ")))
        .when(is_("number_changed"), F.regexp_replace("text", r"\b(\d+) of", "9$1 of")).when(is_("words_removed"), F.substring_index("text", ". ", 1))
        .when(is_("markup_added"), F.concat(F.lit("<b>"), "text", F.lit("</b>"))).otherwise(F.col("text"))
    )
    rows = rows.withColumn("text", text).withColumn("group_raw", F.when(is_("invalid_group"), "0").otherwise(F.col("group_raw")))
    times = F.when(is_("duplicated"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("copy", F.explode(times))
    # a copy stands right behind its row
    return rows.withColumn("input_index", F.col("input_index") * 2 + F.col("copy")).drop("copy")
