"""Team review: permissions, visibility, assignment, messages with their guards, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from ..plans.shared import written
from .index import dealt
from .ranks import ranked
from .structure import SEVERITIES

MANAGER = "manager"
STAGES = ("unassigned", "assigned", "submitted", "approved", "returned")
# What each role may do.
PERMISSIONS = {
    "manager": ("team.edit", "assign", "task.export", "package.import", "view.all", "supervise.direct"),
    "supervisor": ("package.import", "supervise", "review.export", "view.team"),
    "reviewer": ("decide", "submission.export", "view.own"),
}
#: Slots of a team lie in blocks of a power of two; of blocks and turns so many rows are broadcast.
SLOT_BITS = 12
BROADCAST_ROWS = 500_000


def can(role: Column, action: Column) -> Column:
    """Whether a role may perform an action; unknown roles may do nothing."""
    allowed = F.lit(False)
    for name, actions in PERMISSIONS.items():
        allowed = F.when(role == name, action.isin(*actions)).otherwise(allowed)
    return F.coalesce(allowed, F.lit(False))


def severity_rank(severity: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.coalesce(F.when(place > 0, place - 1), F.lit(len(SEVERITIES) - 1)).cast("int")


def visible(records: DataFrame, members: DataFrame, role: str, member: str) -> DataFrame:
    """Records that a member sees: all for a manager, a team's for its supervisor, own ones for a reviewer."""
    if role == MANAGER:
        return records
    if role == "reviewer":
        return records.where(F.col("reviewer_id") == member)
    team = members.where(~F.col("removed") & (F.col("role") == "reviewer") & (F.col("supervisor_id") == member))
    return records.join(team.select(F.col("member_id").alias("reviewer_id")), "reviewer_id", "left_semi")


def may_decide(role: Column, member: Column, reviewer: Column, stage: Column) -> Column:
    """A reviewer's own case is open until it is submitted, and again when it comes back."""
    return F.coalesce((role == "reviewer") & (reviewer == member) & stage.isin("assigned", "returned"), F.lit(False))


def balanced(cases: DataFrame, reviewers: DataFrame, by: list[str], many: int | None = None) -> DataFrame:
    """Cases (by..., fingerprint, severity, grp) dealt to reviewers (by..., reviewer_id, place, load), the least loaded first.

    Dealing one after the other to the least loaded reviewer fills slots (level, reviewer)
    in that order, level by level from each reviewer's load; so the n-th case gets the
    n-th slot. Cases go by severity, group, fingerprint; ties of load by place.

    No slot becomes a row. From one load to the next higher one of the team (a step) the same
    reviewers take turns, so a slot's place in its step tells whose turn it is. Steps are met
    by blocks of slots, turns by their number; cases are dealt to ``many`` tasks. A step has as
    many slots as reviewers at least, so turns are no more than cases and reviewers.
    """
    cases = ranked(cases, by, [severity_rank(F.col("severity")), F.col("grp"), F.col("fingerprint")], "slot", many)
    columns = cases.columns
    reviewers = reviewers.where("load IS NOT NULL").select(*by, "reviewer_id", "place", F.col("load").cast("long").alias("__own"))
    upwards = Window.partitionBy(*by).orderBy("__load")
    steps = reviewers.groupBy(*by, F.col("__own").alias("__load")).agg(F.count("*").alias("__n"))
    steps = steps.select(*by, "__load", F.sum("__n").over(upwards).alias("__open"), F.lead("__load").over(upwards).alias("__next"))
    steps = steps.withColumn("__slots", F.col("__open") * (F.col("__next") - F.col("__load")))
    before = F.sum("__slots").over(upwards.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("__before", F.coalesce(before, F.lit(0))).join(cases.groupBy(*by).agg(F.count("*").alias("__cases")), by)
    # the highest step has no end of its own
    end = F.least(F.col("__before") + F.col("__slots"), F.col("__cases"))
    steps = written(steps.where("__before < __cases").select(*by, "__load", "__open", "__before", end.alias("__end")), "steps")
    block = lambda slot: F.shiftright(slot, SLOT_BITS)
    first, last = block(F.col("__before")), block(F.col("__end") - 1)
    pieces = steps.withColumn("__block", F.explode(F.sequence(first, last)))
    turn = F.row_number().over(Window.partitionBy(*by, "__load").orderBy("place")) - 1
    turns = reviewers.join(steps.select(*by, "__load"), by).where("__own <= __load").select(*by, "__load", turn.cast("long").alias("__turn"), "reviewer_id")

    many_pieces, many_turns = steps.agg(F.sum(last - first + 1), F.sum("__open")).first()

    def met(left: DataFrame, right: DataFrame, on: list[str], n: int | None) -> DataFrame:
        if (n or 0) <= BROADCAST_ROWS:
            return left.join(F.broadcast(right), on)
        return dealt(left, many, *on).join(dealt(right, many, *on), on)

    out = met(cases.withColumn("__block", block(F.col("slot") - 1)), pieces, [*by, "__block"], many_pieces).where("slot > __before AND slot <= __end")
    out = met(out.withColumn("__turn", (F.col("slot") - 1 - F.col("__before")) % F.col("__open")), turns, [*by, "__load", "__turn"], many_turns)
    return out.select(*by, "slot", *[c for c in columns if c not in (*by, "slot")], "reviewer_id")


def by_group(cases: DataFrame, reviewers: DataFrame, holders: DataFrame, by: list[str]) -> DataFrame:
    """A reviewer (by..., grp, reviewer_id, cases) for each group of a team's cases: the largest first, to its holder or else the least loaded.

    ``cases`` are (by..., grp), ``reviewers`` (by..., reviewer_id, place, load), ``holders``
    (by..., grp, reviewer_id); ``by`` names the team. Whom a group goes to depends on all of
    its team before it, so a team is one task, which takes a row a group and keeps its
    reviewers in a heap by load and place; teams run beside each other. Group 0, which stands
    for none, has no holder. A team without reviewers is given nothing.
    """
    sizes = cases.groupBy(*by, "grp").agg(F.count("*").cast("long").alias("n"))
    held = holders.where("grp <> 0").join(reviewers.select(*by, "reviewer_id", "place"), [*by, "reviewer_id"]).groupBy(*by, "grp").agg(F.min(F.struct("place", "reviewer_id")).alias("h"))
    work = sizes.join(held, [*by, "grp"], "left").select(*by, "grp", "n", F.col("h.reviewer_id").alias("held"))
    crew = reviewers.select(*by, "reviewer_id", F.col("place").cast("long").alias("place"), F.col("load").cast("long").alias("load"))
    kept = work.select(*by, "grp").schema.fields
    schema = StructType([*kept, StructField("reviewer_id", StringType()), StructField("cases", LongType())])

    def deal(groups, team):
        import heapq

        import pyarrow as pa

        load = {r["reviewer_id"]: r["load"] for r in team.to_pylist()}
        place = {r["reviewer_id"]: r["place"] for r in team.to_pylist()}
        heap = [(n, place[who], who) for who, n in load.items()]
        heapq.heapify(heap)
        rows = []
        for g in sorted(groups.to_pylist(), key=lambda g: (-g["n"], g["grp"])) if load else []:
            who = g["held"]
            if who is None:
                # entries from before a reviewer was given something are passed over
                while heap[0][0] != load[heap[0][2]]:
                    heapq.heappop(heap)
                who = heap[0][2]
            load[who] += g["n"]
            heapq.heappush(heap, (load[who], place[who], who))
            rows.append({c: g[c] for c in (*by, "grp")} | {"reviewer_id": who, "cases": g["n"]})
        return pa.Table.from_pylist(rows, pa.schema([*[groups.schema.field(c) for c in (*by, "grp")], ("reviewer_id", pa.string()), ("cases", pa.int64())]))

    return work.groupBy(*by).cogroup(crew.groupBy(*by)).applyInArrow(deal, schema)


def assigned(record: DataFrame, members: DataFrame) -> DataFrame:
    """Manual assignments (fingerprint, stage, reviewer_id, to) with their outcome: moved, freed, or why not.

    A case that waits for a verdict or has one doesn't move; one that came back keeps that
    stage if it stays with its reviewer.
    """
    active = members.where(~F.col("removed") & (F.col("role") == "reviewer")).select(F.col("member_id").alias("to"), F.lit(True).alias("known"))
    out = record.join(active, "to", "left")
    locked = F.coalesce(F.col("stage").isin("submitted", "approved"), F.lit(False))
    outcome = F.when(locked, "locked").when(F.col("to").isNull(), "freed").when(F.col("known").isNull(), "not_reviewer").otherwise("moved")
    stays = (F.col("stage") == "returned") & F.col("reviewer_id").eqNullSafe(F.col("to"))
    stage = F.when(outcome == "freed", "unassigned").when(outcome == "moved", F.when(stays, "returned").otherwise("assigned")).otherwise(F.col("stage"))
    return out.withColumn("outcome", outcome).withColumn("new_stage", stage).drop("known")


def membership(requests: DataFrame, members: DataFrame, most: int = 60) -> DataFrame:
    """Requests (request, action, member_id, name, role, supervisor_id) to change the team, with their outcome against the members as they are.

    Names are cleaned; a reviewer's supervisor must be an active one or the manager; a
    supervisor with active reviewers can't be removed.
    """
    active = members.where(~F.col("removed"))
    chiefs = active.where("role = 'supervisor'").select(F.col("member_id").alias("supervisor_id"), F.lit(True).alias("chief"))
    busy = active.where("role = 'reviewer'").groupBy(F.col("supervisor_id").alias("member_id")).agg(F.count("*").alias("team"))
    here = active.select("member_id", F.lit(True).alias("here"), F.col("role").alias("is"))
    names = active.select(F.lower("name").alias("low"), F.lit(True).alias("taken")).distinct()
    total = active.agg(F.count("*").alias("total"))
    out = requests.withColumn("name", T.clean_name(F.col("name"))).withColumn("low", F.lower("name"))
    out = out.join(chiefs, "supervisor_id", "left").join(busy, "member_id", "left").join(here, "member_id", "left").join(names, "low", "left")
    out = out.join(F.broadcast(total), how="cross")  # one row
    add = (
        F.when(F.col("name") == "", "name").when(~F.coalesce(F.col("role").isin("reviewer", "supervisor"), F.lit(False)), "role").when(F.col("taken"), "duplicate_name")
        .when(F.col("total") >= most, "too_many").when((F.col("role") == "reviewer") & (F.col("supervisor_id") != MANAGER) & F.col("chief").isNull(), "no_supervisor").otherwise("added")
    )
    remove = F.when(F.col("here").isNull(), "not_found").when((F.col("is") == "supervisor") & (F.coalesce("team", F.lit(0)) > 0), "has_reviewers").otherwise("removed")
    return out.withColumn("outcome", F.when(F.col("action") == "add", add).otherwise(remove)).drop("low", "chief", "team", "here", "is", "taken", "total")


def task_items(records: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (member_id, fingerprint, stage, reviewer_id, grp, note) of each active member's task: own cases, a supervisor's team's.

    A reviewer's items tell a verdict's note only where the case came back; texts and
    decisions stay behind. Members without cases have no task.
    """
    active = members.where(~F.col("removed"))
    own = active.where("role = 'reviewer'").select("member_id", F.col("member_id").alias("reviewer_id"), F.lit(True).alias("own"))
    team = active.where("role = 'reviewer' AND supervisor_id IS NOT NULL").select(F.col("supervisor_id").alias("member_id"), F.col("member_id").alias("reviewer_id"), F.lit(False).alias("own"))
    team = team.join(active.where("role = 'supervisor'").select("member_id"), "member_id", "left_semi")
    note = F.when(~F.col("own") | (F.col("stage") == "returned"), F.col("verdict_note"))
    return own.unionByName(team).join(records, "reviewer_id").select("member_id", "fingerprint", "stage", "reviewer_id", "grp", note.alias("note"))


def review_items(records: DataFrame, members: DataFrame, supervisor: str) -> DataFrame:
    """A supervisor's verdicts on the cases of the team, as they go to the manager."""
    team = members.where(~F.col("removed") & (F.col("role") == "reviewer") & (F.col("supervisor_id") == supervisor)).select(F.col("member_id").alias("reviewer_id"))
    fine = F.col("verdict").isin("approved", "returned") & (F.col("stage") == F.col("verdict"))
    return records.where(fine).join(team, "reviewer_id", "left_semi").select("fingerprint", "reviewer_id", "decision", "note", "decided_at", "verdict", "verdict_note", "verdict_at")


def merged_review(items: DataFrame, records: DataFrame, members: DataFrame, supervisor: str) -> DataFrame:
    """A review's items with their outcome for the manager: accepted, skipped (an older verdict), or why not. Of a case's items the newest counts."""
    active = members.where(~F.col("removed"))
    team = active.where("role = 'reviewer'").select(F.col("member_id").alias("holder"), F.col("supervisor_id").alias("chief"), F.col("name").alias("reviewer_name"))
    held = records.select("fingerprint", F.col("reviewer_id").alias("holder"), "severity", F.col("verdict_at").alias("known_at"))
    out = latest(items.withColumn("arrival", F.lit(0)), ["fingerprint"]).drop("arrival").join(held, "fingerprint", "left").join(team, "holder", "left")
    decision = F.coalesce(F.col("decision").isin("accept", "reject", "refer"), F.lit(False)) & (T.clean_note(F.col("note")) != "") & F.col("verdict_at").isNotNull()
    problem = verdict_problem(F.col("decision"), F.col("verdict"), F.col("severity"), F.col("verdict_note"))
    outcome = (
        F.when(F.col("holder").isNull() | F.col("chief").isNull() | ~F.col("reviewer_id").eqNullSafe(F.col("holder")), "not_assigned")
        .when(F.col("chief") != supervisor, "not_yours").when(~decision, "invalid_decision").when(problem.isNotNull(), problem)
        .when(F.coalesce(F.col("known_at") > F.col("verdict_at"), F.lit(False)), "skipped").otherwise("accepted")
    )
    return out.withColumn("outcome", outcome).drop("chief", "known_at")


def approved_decisions(records: DataFrame) -> DataFrame:
    """The decisions that count: those with a supervisor's approval, with who decided and approved."""
    fine = (F.col("stage") == "approved") & F.col("decision").isin("accept", "reject", "refer")
    return records.where(fine).select("fingerprint", "decision", "note", F.col("decided_at").alias("saved_at"), "reviewer_name", F.col("verdict_by").alias("approved_by"), F.col("verdict_at").alias("approved_at"))


def exported(records: DataFrame, members: DataFrame) -> DataFrame:
    """What a report tells of each case's review, without texts: stage, names, decision, notes; never a permission to publish."""
    names = members.select(F.col("member_id").alias("reviewer_id"), F.col("name").alias("known_name"))
    return records.join(names, "reviewer_id", "left").select(
        "fingerprint", "stage", F.coalesce("reviewer_name", "known_name").alias("reviewer_name"), "decision", "note", F.col("verdict_by").alias("verdict_by_name"),
        "verdict_note", "verdict_at", F.lit(False).alias("publication_authorized"), F.lit(False).alias("certificate"),
    )


WORKSPACE = "schema string, runKey string, projectId string, role string, members array<struct<id: string, role: string>>, records map<string, struct<stage: string, reviewerId: string>>"


def restored(stores: DataFrame, run_key: str, schema: str, most: int = 4 << 20) -> DataFrame:
    """Rows (store, fingerprint, stage, reviewer_id) of stored workspaces (store, raw) that are well-formed and of this run; others give none."""
    known = stores.where(F.length("raw") <= most).withColumn("w", F.from_json("raw", WORKSPACE))
    fine = (
        (F.col("w.schema") == schema) & (F.col("w.runKey") == run_key) & F.col("w.projectId").rlike("^[A-Za-z0-9-]{8,64}$")
        & F.col("w.role").isin("manager", "supervisor", "reviewer") & F.col("w.members").isNotNull() & F.col("w.records").isNotNull()
    )
    rows = known.where(fine).select("store", F.explode("w.records").alias("fingerprint", "r"))
    return rows.select("store", "fingerprint", "r.stage", F.col("r.reviewerId").alias("reviewer_id"))


def submissions(items: DataFrame, records: DataFrame, members: DataFrame, supervisor: str) -> DataFrame:
    """Submitted items (fingerprint, reviewer_id, decision, note, created_at) with what becomes of them: accepted, skipped, or a rejection.

    Of several items of one case the newest is looked at. Times are of the sender's clock.
    """
    team = members.where(~F.col("removed") & (F.col("role") == "reviewer")).select(F.col("member_id").alias("__who"), "supervisor_id")
    held = records.select("fingerprint", F.col("reviewer_id").alias("__holder"), "stage", "submitted_at")
    newest = Window.partitionBy("fingerprint", "reviewer_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("decision"), F.col("note"))
    out = items.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    out = out.join(team, F.col("reviewer_id") == F.col("__who"), "left").join(held, "fingerprint", "left")
    note = T.clean_note(F.col("note"))
    outcome = (
        F.when(F.col("__who").isNull(), "not_reviewer").when(~F.col("supervisor_id").eqNullSafe(F.lit(supervisor)), "not_yours")
        .when(~F.col("__holder").eqNullSafe(F.col("reviewer_id")), "not_assigned")
        .when(~F.coalesce(F.col("decision").isin("accept", "reject", "refer"), F.lit(False)) | (note == ""), "invalid_decision")
        .when((F.col("stage") == "approved") | F.coalesce(F.col("created_at") <= F.col("submitted_at"), F.lit(False)), "skipped").otherwise("accepted")
    )
    return out.withColumn("outcome", outcome).drop("__who", "__holder", "supervisor_id")


def verdict_problem(decision: Column, verdict: Column, severity: Column, note: Column) -> Column:
    """Why a verdict doesn't stand: a return needs a note, so does closing a grave finding."""
    bare = T.clean_note(note) == ""
    return (
        F.when(~F.coalesce(decision.isin("accept", "reject", "refer"), F.lit(False)), "no_decision").when(~F.coalesce(verdict.isin("approved", "returned"), F.lit(False)), "verdict")
        .when((verdict == "returned") & bare, "note_required")
        .when((verdict == "approved") & (decision == "reject") & severity.isin("high", "critical") & bare, "note_required")
    )


def latest(verdicts: DataFrame, key: list[str], time: str = "verdict_at", arrival: str = "arrival") -> DataFrame:
    """The newest verdict of each case by the sender's clock; among equal times the one that came last."""
    order = Window.partitionBy(*key).orderBy(F.col(time).desc_nulls_last(), F.col(arrival).desc())
    return verdicts.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def stages(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the records of each stage."""
    return records.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])


def roll_up(records: DataFrame, members: DataFrame) -> DataFrame:
    """Each active member's records by stage: a reviewer's own, a supervisor's team's."""
    active = members.where(~F.col("removed")).select("member_id", "name", "role", "supervisor_id")
    own = active.where("role = 'reviewer'").select("member_id", F.col("member_id").alias("reviewer_id"))
    team = members.where("role = 'reviewer'").select(F.col("supervisor_id").alias("member_id"), F.col("member_id").alias("reviewer_id"))
    team = team.join(active.where("role = 'supervisor'").select("member_id"), "member_id", "left_semi")
    counted = own.unionByName(team).join(records, "reviewer_id").groupBy("member_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("stage") == s).alias(s) for s in ("approved", "submitted", "returned", "assigned")]
    )
    return active.join(counted, "member_id", "left").fillna(0)


def released(records: DataFrame, member: str) -> DataFrame:
    """Records that stay when a member is removed: the member's open cases are free again, approved ones keep their record."""
    return records.where(~((F.col("reviewer_id") == member) & (F.col("stage") != "approved")))
