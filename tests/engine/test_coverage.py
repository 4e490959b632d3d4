from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tallymark.operators import audit, coverage, index, structure


def runs_of(values):
    out, values = [], sorted(values)
    for v in values:
        if out and out[-1][1] == v - 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return out


def keyed_rows(spark, rows, sizes, groups=None):
    counts = spark.createDataFrame(sizes, "grp long, n long")
    n = len(rows)
    columns = {"file_id": [r[0] for r in rows], "input_index": range(n), "row_number": range(1, n + 1), "group_raw": [str(r[1]) for r in rows], "ordinal_raw": [str(r[2]) for r in rows], "text": ["text"] * n}
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    df = spark.createDataFrame(pa.table({k: pa.array(list(v), t) for (k, v), t in zip(columns.items(), kinds, strict=True)}))
    numbered = index.numbering(counts)
    scope = None if groups is None else spark.createDataFrame([(g,) for g in groups], "grp long")
    return structure.keyed(df, numbered, scope), numbered, scope


def plain(rows, sizes, groups=None):
    sizes = dict(sizes)
    scope = set(sizes) if groups is None else set(groups) & set(sizes)
    out = set()
    for f in {r[0] for r in rows}:
        have = {(g, o) for name, g, o in rows if name == f}
        for g in scope:
            for a, b in runs_of(o for o in range(1, sizes[g] + 1) if (g, o) not in have):
                out.add((f, g, a, b, b - a + 1))
    return out


CASES = {
    "small groups": [(g, 1 + g % 7) for g in range(1, 400)],
    "a group over many buckets": [(1, 5), (2, 100_000), (3, 32_768), (4, 1), (5, 40_000)],
    "borders": [(1, 32_768), (2, 32_767), (3, 1), (4, 32_769)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("groups", [None, [2, 3, 5, 77, 1000]])
def test_missing_runs_equal_brute_force(spark, name, groups):
    rng, sizes = random.Random(name), CASES[name]
    rows = []
    for f, share in (("full", 1.0), ("half", 0.5), ("few", 0.001), ("none", 0.0)):
        rows += [(f, g, o) for g, n in sizes for o in range(1, n + 1) if rng.random() < share]
        rows += [(f, 1, 0), (f, 10**6, 1), *[(f, 2, 3)] * 3]
    if name != "small groups":
        # a gap over a bucket's border, and a file that ends in one
        rows = [r for r in rows if not (r[0] == "full" and r[1] == sizes[1][0] and 32_700 <= r[2] <= 66_000)]
    keyed, numbered, scope = keyed_rows(spark, rows, sizes, groups)
    valid = [r for r in rows if 1 <= r[2] <= dict(sizes).get(r[1], 0)] + [(f, -1, -1) for f in ("full", "half", "few", "none")]
    got = [tuple(r) for r in coverage.missing_runs(keyed, numbered, scope).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(valid, sizes, groups)
    counts = {r["file_id"]: r for r in coverage.coverage(keyed, numbered, scope).collect()}
    inside = set(dict(sizes)) if groups is None else set(groups) & set(dict(sizes))
    for f, r in counts.items():
        mine = [v for v in valid if v[0] == f and v[1] > 0]
        ids = {v[1:] for v in mine}
        within = {v for v in ids if v[0] in inside}
        assert (r["valid_rows"], r["covered_ids"], r["out_of_scope_ids"], r["repeated_rows"]) == (len(mine), len(within), len(ids - within), len(mine) - len(ids))
        assert r["expected_ids"] == sum(n for g, n in sizes if g in inside) and r["missing_ids"] == r["expected_ids"] - len(within)


def test_no_rows_and_no_scope(spark):
    keyed, numbered, _ = keyed_rows(spark, [], [(1, 3)])
    assert coverage.missing_runs(keyed, numbered).collect() == [] and coverage.coverage(keyed, numbered).collect() == []
    keyed, numbered, scope = keyed_rows(spark, [("f", 1, 1)], [(1, 3)], [9])
    assert coverage.missing_runs(keyed, numbered, scope).collect() == []
    assert coverage.missing_runs(keyed, numbered.limit(0)).collect() == []
    one = coverage.coverage(keyed, numbered, scope).first()
    assert (one["expected_ids"], one["covered_ids"], one["out_of_scope_ids"], one["coverage_percent"]) == (0, 0, 1, 0.0)


def test_large_indexes_are_joined_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(coverage, "SMALL_INDEX", 0)
    sizes = CASES["small groups"]
    rows = [("a", 5, 1), ("b", 9, 2)]
    keyed, numbered, _ = keyed_rows(spark, rows, sizes)
    out = coverage.missing_runs(keyed, numbered)
    assert {tuple(r) for r in out.collect()} == plain(rows, sizes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_complete_audit_names_gaps_by_file(spark):
    rows = [("a", 1, 1), ("a", 1, 3), ("b", 2, 1), ("b", 2, 1)]
    listed = [(f, i, i + 1, str(g), str(o), "text") for i, (f, g, o) in enumerate(rows)]
    df = spark.createDataFrame(listed, "file_id string, input_index long, row_number long, group_raw string, ordinal_raw string, text string")
    report = audit.audit(df, index.numbering(spark.createDataFrame([(1, 3), (2, 2)], "grp long, n long")))
    gaps = {(r["file_id"], r["evidence"]) for r in report.findings.where("code = 'missing_ids'").collect()}
    assert gaps == {
        ("a", '{"grp":1,"missing":1,"ranges":[{"first":2,"last":2}]}'), ("a", '{"grp":2,"missing":2,"ranges":[{"first":1,"last":2}]}'),
        ("b", '{"grp":1,"missing":3,"ranges":[{"first":1,"last":3}]}'), ("b", '{"grp":2,"missing":1,"ranges":[{"first":2,"last":2}]}'),
    }
    summary = {r["file_id"]: (r["expected_ids"], r["covered_ids"], r["missing_ids"], r["structurally_complete"]) for r in report.summary.collect()}
    assert summary == {"a": (5, 2, 3, False), "b": (5, 1, 4, False)}
    report.unpersist()
