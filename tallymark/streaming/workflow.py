"""The review of each case as a stateful stream that doesn't depend on the order of arrival.

A message waits in its case's state until the watermark has passed its time; a timer then
applies all that is due, oldest first, and the case is told once for it. So messages that come late, but within
the watermark's delay, or come twice, give the same case as a batch over all of them does;
what comes later still is dropped by Spark. A case holds one value (stage, decision, note,
verdict), a list of what waits and a list of its last outcomes, which stays short.

The state has to lie in RocksDB, which is a setting of the session: ``stateful`` gives a
session beside the given one, whose settings stay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.shipping import ship

#: Outcomes that a case remembers.
HISTORY = 12

# What a reviewer may decide, and a supervisor.
DECISIONS, VERDICTS = ("accept", "reject", "refer"), ("approved", "returned")

#: A message: kind is assign, submit (decision, note) or judge (verdict, note); at is the sender's clock.
MESSAGE = "case_id string, message_id string, kind string, at timestamp, decision string, verdict string, note string, severity string"
_WAITING = "kind string, at timestamp, decision string, verdict string, note string, severity string"
_KEPT = ["message_id", *[c.split()[0] for c in _WAITING.split(", ")]]
_AT = _KEPT.index("at")
_VALUE = "stage string, decision string, note string, submitted_at timestamp, verdict string, verdict_note string, verdict_at timestamp, applied long, skipped long, refused long"
CASE = f"case_id string, {_VALUE}, history array<string>"

_FIELDS = [c.split()[0] for c in _VALUE.split(", ")]
_START = {f: None for f in _FIELDS} | {"stage": "unassigned", "applied": 0, "skipped": 0, "refused": 0}


def outcome(case: dict, m) -> str:
    """What becomes of a message (kind, at, decision, verdict, note, severity) to a case: applied, skipped or a refusal."""
    note = (m["note"] or "").strip()
    if m["kind"] == "assign":
        return "applied" if case["stage"] in ("unassigned", "assigned", "returned") else "not_assignable"
    if m["kind"] == "submit":
        if case["stage"] == "unassigned":
            return "not_assigned"
        if m["decision"] not in DECISIONS or not note:
            return "invalid_decision"
        old = case["submitted_at"] is not None and m["at"] <= case["submitted_at"]
        return "skipped" if case["stage"] == "approved" or old else "applied"
    if m["kind"] != "judge":
        return "unknown_kind"
    if case["stage"] not in ("submitted", *VERDICTS) or case["decision"] is None:
        return "no_decision"
    if m["verdict"] not in VERDICTS:
        return "verdict"
    grave = case["decision"] == "reject" and m["severity"] in ("high", "critical")
    if not note and (m["verdict"] == "returned" or grave):
        return "note_required"
    return "skipped" if case["verdict_at"] is not None and case["verdict_at"] > m["at"] else "applied"


def after(case: dict, m) -> tuple[dict, str]:
    """The case after a message, and what became of that."""
    told, note = outcome(case, m), (m["note"] or "").strip()
    counter = told if told in ("applied", "skipped") else "refused"
    case = case | {counter: case[counter] + 1}
    if told == "applied":
        if m["kind"] == "assign":
            case |= {f: None for f in _FIELDS[1:7]} | {"stage": "assigned"}
        elif m["kind"] == "submit":
            case |= {"stage": "submitted", "decision": m["decision"], "note": note, "submitted_at": m["at"]}
        else:
            case |= {"stage": m["verdict"], "verdict": m["verdict"], "verdict_note": note, "verdict_at": m["at"]}
    return case, told


class CaseProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", _VALUE)
        self.waiting = handle.getListState("waiting", f"message_id string, {_WAITING}")
        self.history = handle.getListState("history", "told string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # each call of the state is a trip to the JVM: messages go there together, with one timer for the first of them
        sent = {r["message_id"]: tuple(r[c] for c in _KEPT) for r in rows}
        self.waiting.appendList(list(sent.values()))
        self.handle.registerTimer(_millis(min(m[_AT] for m in sent.values())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # all that the watermark has passed, of whatever timer; of repeats the last one counts
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = {m[0]: tuple(m) for m in self.waiting.get()} if self.waiting.exists() else {}
        due = sorted((m for m in waiting.values() if _millis(m[_AT]) <= until), key=lambda m: (m[_AT], m[0]))
        if not due:
            return
        rest = [m for m in waiting.values() if _millis(m[_AT]) > until]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(_millis(min(m[_AT] for m in rest)))
        else:
            self.waiting.clear()
        case = dict(zip(_FIELDS, self.case.get(), strict=True)) if self.case.exists() else dict(_START)
        told = [x[0] for x in self.history.get()] if self.history.exists() else []
        for m in due:
            case, what = after(case, dict(zip(_KEPT, m, strict=True)))
            told.append(what)
        told = told[-HISTORY:]
        self.case.update(tuple(case[f] for f in _FIELDS))
        self.history.put([(x,) for x in told])
        yield Row(case_id=key[0], **case, history=told)


def _millis(at) -> int:
    """The first whole millisecond at or after a time."""
    import datetime

    at = at if at.tzinfo else at.astimezone()
    return -((datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC) - at) // datetime.timedelta(milliseconds=1))


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose streams keep their state in RocksDB."""
    ship(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def reviewed(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cases (CASE) of messages (MESSAGE): each change of a case on a stream, the last state of each in a batch.

    A stream must come from a ``stateful`` session; a change has more outcomes than the one before.
    """
    ship(messages.sparkSession)
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    messages = messages.select(*names)
    if messages.isStreaming:
        timed = messages.withWatermark("at", delay).groupBy("case_id")
        return timed.transformWithState(CaseProcessor(), CASE, "Update", "EventTime")

    def fold(sent):
        import pyarrow as pa

        seen = {m["message_id"]: m for m in sent.to_pylist()}
        case, told = dict(_START), []
        for m in sorted(seen.values(), key=lambda m: (m["at"], m["message_id"])):
            case, what = after(case, m)
            told = [*told, what][-HISTORY:]
        rows = [{"case_id": m["case_id"]} | case | {"history": told}]
        times = {f: pa.timestamp("us", "UTC") for f in ("submitted_at", "verdict_at")}
        kinds = [("case_id", pa.string()), *[(f, times.get(f, pa.int64() if f in ("applied", "skipped", "refused") else pa.string())) for f in _FIELDS], ("history", pa.list_(pa.string()))]
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    # one case's messages, which are as few as its reviewers sent
    return messages.groupBy("case_id").applyInArrow(fold, CASE)


def last(changes: DataFrame) -> DataFrame:
    """The last change of each case, of a table of what the stream gave."""
    done = F.col("applied") + F.col("skipped") + F.col("refused")
    names = [c.split()[0] for c in _VALUE.split(", ")] + ["history"]
    return changes.groupBy("case_id").agg(F.max_by(F.struct(*names), done).alias("c")).select("case_id", "c.*")
