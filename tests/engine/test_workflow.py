from __future__ import annotations

import datetime
import random

import pytest

from tallymark.streaming import workflow

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def messages(rng, cases=12, each=14):
    out = []
    for c in range(cases):
        for k in range(rng.randint(1, each)):
            kind = rng.choice(["assign", "assign", "submit", "submit", "judge", "other"])
            out.append((
                f"c{c}", f"m{c}-{k}", kind, DAY + datetime.timedelta(minutes=rng.randint(0, 50)), rng.choice(["accept", "reject", "refer", "no", None]), rng.choice(["approved", "returned", None]),
                rng.choice(["fine", " ", None]), rng.choice(["high", "low"]),
            ))
    return out


def told(df):
    return sorted(tuple(r[c.split()[0]] for c in workflow.CASE.split(", ")) for r in df.collect())


def test_a_stream_in_any_order_equals_the_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = messages(rng)
    expect = told(workflow.reviewed(spark.createDataFrame(rows, workflow.MESSAGE)))
    assert {r[1] for r in expect} >= {"unassigned", "assigned", "submitted"} and max(len(r[-1]) for r in expect) <= workflow.HISTORY
    rng.shuffle(rows)
    own = workflow.stateful(spark)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(part, number):
        own.createDataFrame(part, workflow.MESSAGE).coalesce(1).write.mode("append").parquet(source)

        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        stream = workflow.reviewed(own.readStream.schema(workflow.MESSAGE).parquet(source), "2 hours")
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    # stopped and started again between the parts; repeats come later, the last row moves the watermark on
    run(rows[: len(rows) // 2], 0)
    run(rows[len(rows) // 2 :] + rows[:20], 1)
    run([("end", "end", "other", DAY + datetime.timedelta(days=2), None, None, None, None)], 2)
    got = told(workflow.last(own.read.option("basePath", out).parquet(out)))
    assert got == expect


@pytest.mark.parametrize(("stage", "message", "what"), [
    ({}, {"kind": "submit", "decision": "accept", "note": "n"}, "not_assigned"), ({"stage": "assigned"}, {"kind": "submit", "decision": "maybe", "note": "n"}, "invalid_decision"),
    ({"stage": "assigned"}, {"kind": "submit", "decision": "accept", "note": " "}, "invalid_decision"), ({"stage": "approved"}, {"kind": "submit", "decision": "accept", "note": "n"}, "skipped"),
    ({"stage": "assigned", "submitted_at": DAY}, {"kind": "submit", "decision": "accept", "note": "n"}, "skipped"), ({"stage": "assigned"}, {"kind": "judge", "verdict": "approved"}, "no_decision"),
    ({"stage": "submitted", "decision": "reject"}, {"kind": "judge", "verdict": "approved", "severity": "high"}, "note_required"),
    ({"stage": "submitted", "decision": "accept"}, {"kind": "judge", "verdict": "approved", "severity": "high"}, "applied"), ({"stage": "submitted", "decision": "accept"}, {"kind": "judge", "verdict": "returned"}, "note_required"),
    ({"stage": "submitted", "decision": "accept"}, {"kind": "judge", "verdict": None}, "verdict"), ({"stage": "approved"}, {"kind": "assign"}, "not_assignable"),
    ({"stage": "returned", "decision": "accept", "verdict_at": DAY + datetime.timedelta(1)}, {"kind": "judge", "verdict": "approved"}, "skipped"),
])
def test_outcomes(stage, message, what):
    full = {"kind": None, "at": DAY, "decision": None, "verdict": None, "note": None, "severity": None} | message
    assert workflow.outcome(workflow._START | stage, full) == what
