from __future__ import annotations

import json

from tallymark.operators import packages as P

RUN, PROJECT, HEX = "a" * 64, "b" * 16, "c" * 64
GOOD = {"format": P.FORMAT, "version": 1, "kind": "submission", "projectId": PROJECT, "runKey": RUN, "createdAt": "2024-01-02T03:04:05Z", "from": {"memberId": "m-00000001"}, "items": [{"fingerprint": HEX, "decision": "accept", "note": "n", "decidedAt": "never"}]}
MEMBERS = [{"id": "m-00000001", "role": "supervisor", "name": "S"}, {"id": "m-00000002", "role": "reviewer", "name": "R", "supervisorId": "m-00000001"}, {"id": "m-00000003", "role": "reviewer", "name": "Q", "supervisorId": "manager"}]
TASK = {k: v for k, v in GOOD.items() if k != "items"} | {"kind": "task", "from": {"memberId": "manager"}, "to": {"memberId": "m-00000002", "role": "reviewer"}, "members": MEMBERS,
        "records": {HEX: {"reviewerId": "m-00000002", "stage": "returned", "surah": 3, "verdictNote": " see  me "}}}


def frame(spark, cases):
    rows = [(n, None if c is None else bytearray(c if isinstance(c, bytes) else (c if isinstance(c, str) else json.dumps(c)).encode())) for n, c in cases.items()]
    return spark.createDataFrame(rows, "name string, content binary")


def test_each_refusal(spark):
    cases = {
        "good": (GOOD, None), "task": (TASK, None), "none": (None, "empty_file"), "empty": ("", "empty_file"), "blank": (" \n", "empty_file"), "large": (json.dumps(GOOD) + " " * P.MOST_BYTES, "too_large"),
        "bytes": (b"\xff{}", "not_utf8"), "broken": ("{", "invalid_json"), "twice": ('{"a": 1, "a": 2}', "invalid_json"), "list": ([], "not_team_file"), "text": ('"x"', "not_team_file"), "null": ("null", "not_team_file"), "other": (GOOD | {"format": "x"}, "not_team_file"),
        "version": (GOOD | {"version": 2}, "version"), "text version": (GOOD | {"version": "1"}, "version"), "no version": ({k: v for k, v in GOOD.items() if k != "version"}, "version"), "float version": (GOOD | {"version": 1.0}, None),
        "kind": (GOOD | {"kind": "x"}, "kind"), "kind of kind": (GOOD | {"kind": ["submission"]}, "kind"), "project": (GOOD | {"projectId": "B" * 16}, "ids"), "run": (GOOD | {"runKey": 5}, "ids"), "from": (GOOD | {"from": {"memberId": "m-1"}}, "from"),
        "no from": (GOOD | {"from": None}, "from"), "no items": (GOOD | {"items": None}, "shape"), "items": (GOOD | {"items": {"a": 1}}, "shape"), "item": (GOOD | {"items": [{}, 5]}, "shape"), "item list": (GOOD | {"items": [[]]}, "shape"),
        "records": (TASK | {"records": [1]}, "shape"), "many": (GOOD | {"items": [{}] * (P.MOST_ITEMS + 1)}, "too_many"), "no item": (GOOD | {"items": []}, None),
    }
    got = {r["name"]: r["refusal"] for r in P.parsed(frame(spark, {k: c for k, (c, _) in cases.items()})).select("name", "refusal").collect()}
    assert got == {k: r for k, (_, r) in cases.items()}
    assert {r for _, r in cases.values()} - {None} == set(P.REFUSALS)


def test_items_and_importers(spark):
    other = GOOD | {"kind": "review", "items": [{"fingerprint": "short", "reviewerId": "m-00000002", "verdict": "approved", "verdictAt": "2024-01-02T00:00:00Z", "note": 5}, {"fingerprint": HEX, "decision": ["accept"]}]}
    read = P.parsed(frame(spark, {"s": GOOD, "r": other, "t": TASK, "bad": "{"}))
    rows = {(r["name"], r["place"]): r for r in P.items(read).collect()}
    assert set(rows) == {("s", 0), ("r", 0), ("r", 1)}
    s = rows["s", 0]
    assert (s["fingerprint"], s["reviewer_id"], s["decision"], s["note"], s["created_at"].isoformat(), s["decided_at"]) == (HEX, "m-00000001", "accept", "n", "2024-01-02T03:04:05", None)
    assert rows["r", 0]["fingerprint"] is None and rows["r", 0]["note"] is None and rows["r", 0]["reviewer_id"] == "m-00000002" and rows["r", 0]["verdict_at"] is not None and rows["r", 1]["decision"] is None
    told = lambda *a: {r["name"]: r["refusal"] for r in P.imported(read, *a).select("name", "refusal").collect()}
    assert told("submission", PROJECT, RUN) == {"s": None, "r": "kind", "t": "kind", "bad": "invalid_json"}
    assert told("submission", "0" * 16, RUN)["s"] == "project" and told("submission", PROJECT, "0" * 64)["s"] == "run_mismatch"


def test_tasks(spark):
    team = TASK | {"to": {"memberId": "m-00000001", "role": "supervisor"}}
    cases = {
        "fine": (TASK, None), "team": (team, None), "not mine": (TASK | {"records": {HEX: {"reviewerId": "m-00000003", "stage": "assigned"}}}, "records"), "not the team's": (team | {"records": {HEX: {"reviewerId": "m-00000003", "stage": "assigned"}}}, "records"),
        "stage": (TASK | {"records": {HEX: {"reviewerId": "m-00000002", "stage": "unassigned"}}}, "records"), "key": (TASK | {"records": {"x": {"reviewerId": "m-00000002", "stage": "assigned"}}}, "records"),
        "sender": (TASK | {"from": {"memberId": "m-00000001"}}, "from"), "run": (TASK | {"runKey": "0" * 64}, "run_mismatch"), "kind": (GOOD, "kind"), "member": (TASK | {"members": [*MEMBERS, {"id": "m-00000009", "role": "boss", "name": "x"}]}, "members"),
        "nameless": (TASK | {"members": [*MEMBERS, {"id": "m-00000009", "role": "supervisor", "name": " "}]}, "members"), "to": (TASK | {"to": {"memberId": "m-00000009", "role": "reviewer"}}, "to"), "role": (TASK | {"to": {"memberId": "m-00000002", "role": "supervisor"}}, "to"), "broken": ("{", "invalid_json"),
    }
    opened = P.tasks(P.parsed(frame(spark, {k: c for k, (c, _) in cases.items()})), RUN)
    assert {r["name"]: r["refusal"] for r in opened.select("name", "refusal").collect()} == {k: r for k, (_, r) in cases.items()}
    assert sorted(tuple(r) for r in P.task_records(opened).collect()) == [("fine", "m-00000002", HEX, "m-00000002", "returned", 3, "see  me"), ("team", "m-00000001", HEX, "m-00000002", "returned", 3, "see  me")]
