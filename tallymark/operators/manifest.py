"""The record of a run: digests of what went in and came out, and whether both belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Columns of a mapped row that its digest covers.
MAPPED = ("row_number", "group_raw", "ordinal_raw", "text")


def rows_digest(rows: DataFrame, by: list[str], columns: tuple[str, ...] = MAPPED, order: str = "input_index", stride: int = 4096) -> DataFrame:
    """One digest of all rows of each key, in their order: digests of strides of rows, then one of those.

    A digest of one joined text would need all rows of a file in one place; here a task
    holds one stride of 64-letter digests, and the last step one digest a stride.
    """
    # digests move as 32 bytes and are read as 64 letters where they are joined
    one = F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    strides = rows.select(*by, F.floor(F.col(order) / stride).alias("stride"), F.col(order).alias("at"), one.alias("sha"))
    joined = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "sha"))), lambda x: F.lower(F.hex(x["sha"]))), ""), 256)
    strides = strides.groupBy(*by, "stride").agg(F.count("*").alias("n"), F.unhex(joined("at")).alias("sha"))
    return strides.groupBy(*by).agg(F.sum("n").alias("rows"), joined("stride").alias("sha256"))


def fingerprints(parts: DataFrame) -> DataFrame:
    """Runs (candidate_rows, reference_rows, candidate_file, reference_file, scope, metadata, output, context) with their seven digests.

    The first two and the output are digests already; file digests count only if they are
    such; the input's covers all that went in.
    """
    sha = lambda c: F.when(F.col(c).rlike("^[a-f0-9]{64}$"), F.col(c))
    told = ["candidate_rows", "reference_rows", "scope", "metadata", "candidate_file", "reference_file"]
    with_files = parts.withColumn("candidate_file", sha("candidate_file")).withColumn("reference_file", sha("reference_file"))
    whole = F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256)
    rest = [c for c in parts.columns if c not in (*told, "output", "context")]
    return with_files.select(
        *rest, F.col("candidate_rows").alias("candidate_rows_sha256"), F.col("reference_rows").alias("reference_rows_sha256"),
        F.col("candidate_file").alias("candidate_file_sha256"), F.col("reference_file").alias("reference_file_sha256"), whole.alias("input_sha256"),
        F.col("output").alias("output_sha256"), F.sha2(F.col("context"), 256).alias("context_sha256"),
    )


def _id(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with ``id``, null where the index knows no such identifier."""
    grp, ord_ = (T.strict_integer(F.col(c).cast("string")) for c in ("group_raw", "ordinal_raw"))
    out = rows.withColumn("grp", grp).withColumn("ord", ord_).join(index.select("grp", "n"), "grp", "left")
    return out.withColumn("id", F.when(F.col("ord").between(1, F.col("n")), F.concat_ws(":", F.col("grp").cast("string"), F.col("ord").cast("string"))))


def positional_check(report: DataFrame, rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (file_id, input_index, problem): places at which a report and the rows that it claims to audit differ.

    Reports have (file_id, input_index, id, text); places meet one to one in a full join.
    """
    mine = _id(rows, index).select("file_id", "input_index", F.col("id").alias("input_id"), F.coalesce("text", F.lit("")).alias("input_text"), F.lit(True).alias("here"))
    both = report.select("file_id", "input_index", "id", "text", F.lit(True).alias("there")).join(mine, ["file_id", "input_index"], "full")
    problem = (
        F.when(F.col("here").isNull(), "report_row_without_input").when(F.col("there").isNull(), "input_row_without_report")
        .when(~F.col("id").eqNullSafe(F.col("input_id")), "identifier_differs").when(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("input_text")), "text_differs")
    )
    return both.select("file_id", "input_index", problem.alias("problem")).where("problem IS NOT NULL")


def linkage_check(report: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """Report rows (file_id, input_index, id, reference_text) whose reference isn't the only input reference of their identifier, word for word."""
    by_id = _id(reference, index).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.first("text").alias("given"))
    linked = report.where("reference_text IS NOT NULL").join(by_id, "id", "left")
    problem = F.when(F.col("n").isNull(), "no_input_reference").when(F.col("n") > 1, "several_input_references").when(~F.col("given").eqNullSafe(F.col("reference_text")), "reference_text_differs")
    return linked.select("file_id", "input_index", "id", problem.alias("problem")).where("problem IS NOT NULL")


def weight_status(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Model files (path, content) against pinned digests (path, sha256): verified, mismatch or declared_not_verified; only verified ones may be used."""
    measured = files.select("path", F.sha2("content", 256).alias("measured"), F.length("content").alias("bytes"))
    out = measured.join(pins.select("path", F.lower("sha256").alias("pinned")), "path", "left")
    pinned = F.col("pinned").rlike("^[a-f0-9]{64}$")
    status = F.when(~F.coalesce(pinned, F.lit(False)), "declared_not_verified").when(F.col("measured") == F.col("pinned"), "verified").otherwise("mismatch")
    return out.withColumn("status", status).withColumn("usable", F.col("status") == "verified")


def partial_results(pairs: DataFrame, results: DataFrame, ended: Column | None = None) -> DataFrame:
    """Pairs (file_id, key) with their results (file_id, key, outcome), of whatever a cancelled or failed run had finished, and counts by file.

    Rows (file_id, eligible, processed, abstained, not_processed, state): ``ended`` is null,
    "cancelled" or "failed"; results of pairs that nobody asked for don't count.
    """
    both = pairs.select("file_id", "key").distinct().join(results.select("file_id", "key", "outcome").dropDuplicates(["file_id", "key"]), ["file_id", "key"], "left")
    counts = both.groupBy("file_id").agg(
        F.count("*").alias("eligible"), F.count("outcome").alias("processed"), F.count_if(F.col("outcome") == "abstain").alias("abstained")
    )
    ended = F.lit(None).cast("string") if ended is None else ended
    state = ended if ended is not None else F.lit(None)
    state = F.coalesce(state, F.when(F.col("processed") == 0, "not_run").when(F.col("processed") < F.col("eligible"), "partial").otherwise("complete"))
    return counts.withColumn("not_processed", F.col("eligible") - F.col("processed")).withColumn("state", state)
