from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import intervals, ranks, revision


@pytest.fixture(params=[0, 500_000])
def sized(request, monkeypatch):
    monkeypatch.setattr(intervals, "BROADCAST_CELLS", request.param)


def test_points_in_intervals_equal_brute_force(spark, sized):
    rng = random.Random(8)
    spans = [(rng.randint(1, 3), a, a + rng.choice([0, 1, 7, 100, 5000, 3_000_000])) for a in [rng.randint(1, 60_000) for _ in range(200)]]
    spans += [(1, 9, 8), (None, 1, 10), (2, None, 5), (3, 4096, 4096), (3, 4095, 8192)]
    points = [(rng.randint(1, 4), rng.randint(0, 70_000), k) for k in range(600)] + [(None, 5, 1000), (1, None, 1001), (1, 60_000, 1002), (1, 60_000, 1002)]
    df = spark.createDataFrame(points, "grp long, ord long, cell long")
    scope = spark.createDataFrame(spans, "grp long, first long, last long").withColumn("note", F.concat_ws("-", "first", "last"))
    held = lambda g, p: [s for s in spans if s[0] is not None and s[0] == g and p is not None and s[1] is not None and s[1] <= p <= s[2]]
    got = intervals.marked(df, scope, ["grp"], "ord", "inside")
    assert got.columns == ["grp", "ord", "cell", "inside"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*p, bool(held(p[0], p[1])))) for p in points)
    pairs = sorted((r["cell"], r["first"], r["last"]) for r in intervals.joined(df, scope, ["grp"], "ord").collect())
    assert pairs == sorted((p[2], s[1], s[2]) for p in points for s in held(p[0], p[1]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.joined(df, scope.limit(0), ["grp"], "ord").collect() == []
    assert not any(r["inside"] for r in intervals.marked(df, scope.limit(0), ["grp"], "ord", "inside").collect())


def test_scope_of_revisions_with_many_intervals(spark):
    rows = spark.createDataFrame([("1", str(k), k, "t") for k in range(1, 400)], "group_raw string, ordinal_raw string, row_number long, text string")
    scope = spark.createDataFrame([(1, 3 * k, 3 * k + 1) for k in range(1, 100)], "grp long, first long, last long")
    got = {int(r["ordinal_raw"]) for r in revision.ledger(rows, scope).where("in_scope").collect()}
    assert got == {x for k in range(1, 100) for x in (3 * k, 3 * k + 1)}


def test_ranks_equal_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, id long")
    got = ranks.ranked(df, ["k"], [F.col("v").desc(), F.col("id")], "n")
    assert got.columns == ["k", "v", "id", "n"]
    by_key = {}
    for r in sorted(rows, key=lambda r: (-r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    assert {tuple(r) for r in got.collect()} == {(*r, n) for listed in by_key.values() for n, r in enumerate(listed, 1)}
    assert ranks.ranked(df, [], [F.col("v"), F.col("id")], "n").where("n = 3000").first()["v"] == max(r[1] for r in rows)
    assert ranks.ranked(df.limit(0), ["k"], [F.col("v")], "n").collect() == []
