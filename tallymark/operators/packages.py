"""Team packages as files: read, checked against their form, and split into what is taken and what goes to quarantine.

A package is a JSON text; it is read as a variant in the JVM, so its types are told apart as
they were sent, and nothing of it is guessed. Each file gets the first refusal that applies,
in the order of ``REFUSALS``, and only files without one give items. A text that repeats a
key in one object can't be read without a guess, and counts as no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .team import MANAGER, STAGES

FORMAT, VERSION = "tallymark-team", 1
# Limits, kinds and forms of identifiers, and refusals in the order in which they are looked for.
MOST_BYTES, MOST_ITEMS, MOST_MEMBERS = 2 << 20, 20_000, 50
KINDS = ("task", "submission", "review")
FINGERPRINT, PROJECT, MEMBER = r"^[a-f0-9]{64}$", r"^[a-f0-9]{16}$", r"^(manager|m-[a-f0-9]{8})$"
REFUSALS = ("empty_file", "too_large", "not_utf8", "invalid_json", "not_team_file", "version", "kind", "ids", "from", "shape", "too_many")

_MEMBER = "array<struct<id: string, role: string, name: string, supervisorId: string>>"


def _part(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _string(value: Column, path: str) -> Column:
    """The text at a path, null if anything else is there."""
    part = _part(value, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", _part(value, path, "string"))


def _object(value: Column, path: str) -> Column:
    return _part(value, path, "map<string, variant>")


def parsed(files: DataFrame) -> DataFrame:
    """Rows (name, refusal, value, kind, project_id, run_key, sender, created_at) of files (name, content binary), one a file."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    size = F.octet_length("content")
    # what is refused for its size isn't read
    value = F.when(size <= MOST_BYTES, F.try_parse_json(text))
    out = files.select("name", "content", text.alias("text"), value.alias("value"))
    v = F.col("value")
    got = {"kind": _string(v, "$.kind"), "project_id": _string(v, "$.projectId"), "run_key": _string(v, "$.runKey"), "sender": _string(v, "$.from.memberId"), "created_at": _string(v, "$.createdAt")}
    out = out.select("*", _string(v, "$.format").alias("form"), _part(v, "$.version", "variant").alias("ver"), *[c.alias(k) for k, c in got.items()])
    task = F.col("kind") == "task"
    records, items = _object(v, "$.records"), _part(v, "$.items", "array<variant>")
    held = F.when(task, F.size(records)).otherwise(F.size(items))
    whole = F.when(task, records.isNotNull()).otherwise(items.isNotNull() & F.forall(items, lambda x: _object(x, "$").isNotNull()))
    fits = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    number = F.coalesce(F.schema_of_variant("ver").isin("BIGINT", "DOUBLE") | F.schema_of_variant("ver").startswith("DECIMAL"), F.lit(False))
    refusal = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(size > MOST_BYTES, "too_large").when(F.col("text").isNull(), "not_utf8").when(T.trimmed(F.col("text")) == "", "empty_file")
        .when(v.isNull(), "invalid_json").when(_object(v, "$").isNull() | ~F.col("form").eqNullSafe(F.lit(FORMAT)), "not_team_file")
        .when(~number | ~F.coalesce(F.try_variant_get("ver", "$", "double") == VERSION, F.lit(False)), "version").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(~fits("project_id", PROJECT) | ~fits("run_key", FINGERPRINT), "ids").when(~fits("sender", MEMBER), "from")
        .when(F.coalesce(held > MOST_ITEMS, F.lit(False)), "too_many").when(~F.coalesce(whole, F.lit(False)), "shape")
    )
    return out.select("name", refusal.alias("refusal"), "value", *got)


def imported(packages: DataFrame, kind: str, project_id: str, run_key: str) -> DataFrame:
    """Parsed packages with the refusal of an importer who expects that kind, project and run; earlier refusals stay."""
    wrong = F.when(F.col("kind") != kind, "kind").when(F.col("project_id") != project_id, "project").when(F.col("run_key") != run_key, "run_mismatch")
    return packages.withColumn("refusal", F.coalesce("refusal", wrong))


def items(packages: DataFrame) -> DataFrame:
    """The items of submissions and reviews that weren't refused, a row each, as ``team.submissions`` and ``team.merged_review`` take them.

    A fingerprint of another form is null, so it meets no case; times that are none are null.
    """
    # a condition on the refusal would be taken down to the files, and parse each text once for every use in it
    taken = F.when(F.col("refusal").isNull() & (F.col("kind") != "task"), _part(F.col("value"), "$.items", "array<variant>"))
    each = packages.select("name", "kind", "sender", "created_at", F.posexplode_outer(taken).alias("place", "item")).where("place IS NOT NULL")
    i = F.col("item")
    name = _string(i, "$.fingerprint")
    time = lambda c: F.try_to_timestamp(c)
    return each.select(
        "name", "place", F.when(name.rlike(FINGERPRINT), name).alias("fingerprint"), F.when(F.col("kind") == "submission", F.col("sender")).otherwise(_string(i, "$.reviewerId")).alias("reviewer_id"),
        _string(i, "$.decision").alias("decision"), _string(i, "$.note").alias("note"), time(F.col("created_at")).alias("created_at"), time(_string(i, "$.decidedAt")).alias("decided_at"),
        _string(i, "$.verdict").alias("verdict"), _string(i, "$.verdictNote").alias("verdict_note"), time(_string(i, "$.verdictAt")).alias("verdict_at"),
    )


def tasks(packages: DataFrame, run_key: str) -> DataFrame:
    """Parsed packages as their member opens them: refusal (also of sender, members, receiver or records), to_member, to_role."""
    v = F.col("value")
    members = F.slice(F.coalesce(_part(v, "$.members", _MEMBER), F.array().cast(_MEMBER)), 1, MOST_MEMBERS)
    out = packages.withColumn("members", members).withColumn("receiver", _string(v, "$.to.memberId"))
    out = out.withColumn("to", F.try_element_at(F.filter("members", lambda m: m["id"] == F.col("receiver")), F.lit(1)))
    chief = F.when(F.col("to.role") == "supervisor", F.col("receiver"))
    # a reviewer's own cases, or those of a supervisor's reviewers
    allowed = F.filter("members", lambda m: (m["role"] == "reviewer") & ((m["id"] == F.col("receiver")) | F.coalesce(m["supervisorId"] == chief, F.lit(False))))["id"]
    out = out.withColumn("allowed", allowed)

    def sound_member(m: Column) -> Column:
        named = F.coalesce(m["id"].rlike(MEMBER) & (m["id"] != MANAGER) & m["role"].isin("reviewer", "supervisor") & (T.clean_name(m["name"]) != ""), F.lit(False))
        return named & F.when(m["role"] == "supervisor", m["supervisorId"].isNull()).otherwise(F.coalesce(m["supervisorId"].rlike(MEMBER), F.lit(False)))

    def sound_record(k: Column, r: Column) -> Column:
        return k.rlike(FINGERPRINT) & F.coalesce(F.array_contains("allowed", _string(r, "$.reviewerId")) & _string(r, "$.stage").isin(*[s for s in STAGES if s != "unassigned"]), F.lit(False))

    records = _object(v, "$.records")
    refusal = (
        F.when(F.col("kind") != "task", "kind").when(F.col("run_key") != run_key, "run_mismatch").when(F.col("sender") != MANAGER, "from").when(~F.forall("members", sound_member), "members")
        .when(F.col("to").isNull() | ~F.col("to.role").eqNullSafe(_string(v, "$.to.role")), "to")
        .when(F.size(F.map_filter(records, lambda k, r: ~sound_record(k, r))) > 0, "records")
    )
    return out.withColumn("refusal", F.coalesce("refusal", refusal)).select("name", "refusal", "value", F.col("receiver").alias("to_member"), F.col("to.role").alias("to_role"))


def task_records(opened: DataFrame) -> DataFrame:
    """The cases of opened tasks that weren't refused: (name, to_member, fingerprint, reviewer_id, stage, grp, verdict_note)."""
    taken = F.when(F.col("refusal").isNull(), _object(F.col("value"), "$.records"))
    each = opened.select("name", "to_member", F.explode_outer(taken).alias("fingerprint", "r")).where("fingerprint IS NOT NULL")
    r = F.col("r")
    grp = F.when(F.schema_of_variant(_part(r, "$.surah", "variant")) == "BIGINT", _part(r, "$.surah", "long"))
    stage = _string(r, "$.stage")
    return each.select(
        "name", "to_member", "fingerprint", _string(r, "$.reviewerId").alias("reviewer_id"), stage.alias("stage"), F.coalesce(grp, F.lit(0)).alias("grp"),
        F.when(stage == "returned", T.clean_note(F.coalesce(_string(r, "$.verdictNote"), F.lit("")))).alias("verdict_note"),
    )
