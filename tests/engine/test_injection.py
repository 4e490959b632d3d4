from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymark.operators import audit, index, injection

SCHEMA = "file_id string, position long, grp long, ord long, n long, text string, variants map<string,string>"


def sound(spark, files=("a", "b"), groups=150, size=20):
    """Two files of the same numbers: every third text has a negation, every third a number."""
    rows = []
    for f in files:
        for g in range(1, groups + 1):
            for o in range(1, size + 1):
                at = (g - 1) * size + o
                if at % 3 == 0:
                    text, other = f"Gate {at} is not open to carriers.", {"negation_removed": f"Gate {at} is open to carriers."}
                elif at % 3 == 1:
                    text, other = f"Gate {at} has 5 locks and a bell.", {"number_changed": f"Gate {at} has 4 locks and a bell."}
                else:
                    text, other = f"Gate {at} opens early.", None
                rows.append((f, at, g, o, size, text, other))
    return spark.createDataFrame(rows, SCHEMA), index.numbering(spark.createDataFrame([(g, size) for g in range(1, groups + 1)], "grp long, n long"))


def as_rows(rows):
    return rows.select("file_id", (F.col("position") - 1).alias("input_index"), (F.col("position") + 1).alias("row_number"), F.col("grp").cast("string").alias("group_raw"), F.col("ord").cast("string").alias("ordinal_raw"), "text")


@pytest.fixture(scope="module")
def trial(spark):
    rows, sizes = sound(spark)
    cases = injection.chosen(rows, 3, seed=1).persist()
    return rows, sizes, cases, injection.injected(rows, cases).persist()


def test_choice_is_without_replacement_and_apart(spark, trial):
    rows, _, cases, _ = trial
    got = cases.select("file_id", "position", "defect", "ord", "n").collect()
    kinds = {*injection.STRUCTURAL, "negation_removed", "number_changed"}
    assert {(r["file_id"], r["defect"]) for r in got} == {(f, k) for f in "ab" for k in kinds}
    assert len(got) == 2 * 3 * len(kinds) and all(r["ord"] < r["n"] for r in got)
    for f in "ab":
        at = sorted(r["position"] for r in got if r["file_id"] == f)
        assert min(b - a for a, b in zip(at, at[1:], strict=False)) >= 5
    again = injection.chosen(rows.repartition(7), 3, seed=1).select("file_id", "position", "defect", "ord", "n").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert sorted(map(tuple, injection.chosen(rows, 3, seed=2).select("file_id", "position", "defect", "ord", "n").collect())) != sorted(map(tuple, got))
    assert injection.chosen(rows.limit(0), 3).isEmpty()


def test_files_with_defects_equal_brute_force(spark, trial):
    rows, _, cases, made = trial
    files = {}
    for r in sorted(rows.collect(), key=lambda r: (r["file_id"], r["position"])):
        files.setdefault(r["file_id"], []).append((r["position"], str(r["grp"]), str(r["ord"]), r["text"]))
    for f, lines in files.items():
        known = {r["position"]: r for r in cases.where(F.col("file_id") == f).collect()}
        out, k = [], 0
        while k < len(lines):
            at, grp, ord_, text = lines[k]
            case = known.get(at)
            kind = case["defect"] if case else None
            follow = lines[k + 1] if k + 1 < len(lines) else None
            if kind == "duplicate_row":
                out += [(grp, ord_, text)] * 2
            elif kind == "swapped_rows":
                out += [follow[1:], (grp, ord_, text)]
                k += 1
            elif kind == "merged_rows":
                out.append((grp, f"{ord_}-{follow[2]}", f"{text} {follow[3]}"))
                k += 1
            elif kind == "invalid_id":
                out.append(("0", ord_, text))
            elif kind == "emptied_text":
                out.append((grp, ord_, ""))
            elif kind in injection.TEXTUAL:
                out.append((grp, ord_, case["variants"][kind]))
            elif kind is None:
                out.append((grp, ord_, text))
            k += 1
        got = made.where(F.col("file_id") == f).orderBy("input_index").collect()
        assert [(r["group_raw"], r["ordinal_raw"], r["text"]) for r in got] == out
        assert [r["input_index"] for r in got] == list(range(len(out))) and all(r["row_number"] == r["input_index"] + 2 for r in got)


def test_audit_tells_the_defects(spark, trial):
    rows, sizes, cases, made = trial
    reference = as_rows(rows.where("file_id = 'a'"))
    report = audit.audit(made.drop("case_id"), sizes, reference, candidate_language="en", reference_language="en", verified=True)
    relevant = injection.RELEVANT | {"number_changed": ("potential_numeric_change",)}
    out = injection.recall(cases, made, report.findings, reference, codes=(*injection.ROW_CODES, "potential_numeric_change"), relevant=relevant)
    got = {r["defect"]: r for r in out.collect()}
    assert set(got) == {*injection.STRUCTURAL, "negation_removed", "number_changed"}
    assert all(r["injected"] == 6 and r["touched"] == 6 and r["detected"] == 6 and r["recall"] == 1.0 for r in got.values())
    blind = {k for k, r in got.items() if r["naive_a"] == 0}
    assert blind == {"missing_row", "duplicate_row", "swapped_rows"} and got["missing_row"]["naive_b"] == 6 and got["swapped_rows"]["naive_b"] == 0
    audited = report.rows.select("file_id", "row_number", "id", "status").join(made.select("file_id", "row_number", "case_id"), ["file_id", "row_number"])
    seen = injection.alarms(cases, audited).first()
    assert seen["false_alarms"] == 0 and seen["untouched"] == rows.count() - 6 * (len(got) + 2)
    report.unpersist()


def test_no_cases_leave_the_file_as_it_is(spark):
    rows, _ = sound(spark, ("a",), 3, 4)
    same = injection.injected(rows, injection.chosen(rows, 0)).drop("case_id")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, as_rows(rows).collect()))


def test_files_meet_few_cases_by_broadcast(spark, monkeypatch):
    """Whole files, and the whole reference, were dealt out to meet a handful of cases."""
    cases = spark.createDataFrame([("f", 2, "missing_row", 1, 2)], "file_id string, position long, defect string, grp long, ord long")
    rows = spark.createDataFrame([("f", 2, "1", "1", "a", None, "1:1", "abstain"), ("f", 3, "1", "3", "c", "c1", "1:3", "needs_review")], "file_id string, row_number long, group_raw string, ordinal_raw string, text string, case_id string, id string, status string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(injection, "FEW", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = [plan(injection.alarms(cases, rows)), plan(injection.naive(cases, rows, rows))]
        monkeypatch.setattr(injection, "FEW", 1)
        near = [plan(injection.alarms(cases, rows)), plan(injection.naive(cases, rows, rows))]
        assert not any("BroadcastHashJoin" in p for p in dealt) and all("BroadcastHashJoin" in p for p in near)
        assert [tuple(r) for r in injection.alarms(cases, rows).collect()] == [(1, 0)]
        assert {tuple(r) for r in injection.naive(cases, rows, rows.where("row_number = 2")).collect()} == {("c1", True, True), ("missing_row:f:2", False, True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
