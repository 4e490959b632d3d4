from __future__ import annotations

import io
import random
from collections import Counter
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from tallymark.functions import text as T
from tallymark.functions import udfs
from tallymark.operators import review, revision, semantic, structure, team
from tallymark.sources import delimited, files, workbook, xml
from tallymark.sources.matrix import Malformed, rows_from_matrix
from tallymark.streaming import cases


def test_islands_round_trip(spark):
    values = sorted(random.Random(1).sample(range(300), 120))
    got = structure.ranges(spark.createDataFrame([("k", v) for v in values], "k string, ord long"), ["k"]).collect()
    assert sorted(v for r in got for v in range(r["first"], r["last"] + 1)) == values and all(r["size"] == r["last"] - r["first"] + 1 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_balanced_deal_equals_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    reviewers = [(1, f"r{i}", i, rng.randint(0, 6)) for i in range(rng.randint(1, 5))]
    todo = [(1, f"{rng.randint(0, 99):02}{i}", rng.choice(structure.SEVERITIES), rng.randint(0, 3)) for i in range(rng.randint(1, 25))]
    load = {r[1]: r[3] for r in reviewers}
    expect = {}
    for _, name, severity, grp in sorted(todo, key=lambda c: (structure.SEVERITIES.index(c[2]), c[3], c[1])):
        who = min(load, key=load.get)
        load[who] += 1
        expect[name] = who
    got = team.balanced(
        spark.createDataFrame(todo, "run long, fingerprint string, severity string, grp long"), spark.createDataFrame(reviewers, "run long, reviewer_id string, place long, load long"), ["run"]
    )
    assert {r.fingerprint: r.reviewer_id for r in got.collect()} == expect


def test_group_deal_keeps_groups_and_holders(spark):
    todo = spark.createDataFrame([("t", g) for g in (1, 1, 1, 2, 2, 3, 0)] + [("u", 5), ("u", 6), ("none", 1)], "team string, grp long")
    crew = spark.createDataFrame([("t", "a", 0, 0), ("t", "b", 1, 0), ("u", "c", 0, 3), ("u", "d", 1, 3), ("idle", "e", 0, 0)], "team string, reviewer_id string, place int, load long")
    held = spark.createDataFrame([("t", 3, "a"), ("t", 0, "b"), ("u", 6, "d"), ("u", 5, "gone")], "team string, grp long, reviewer_id string")
    got = {(r.team, r.grp): (r.reviewer_id, r.cases) for r in team.by_group(todo, crew, held, ["team"]).collect()}
    assert got == {("t", 1): ("a", 3), ("t", 2): ("b", 2), ("t", 0): ("b", 1), ("t", 3): ("a", 1), ("u", 5): ("c", 1), ("u", 6): ("d", 1)}


def test_group_deal_equals_a_plain_fold(spark):
    rng = random.Random(6)
    todo = [(t, g) for t in range(4) for g in range(40) for _ in range(rng.randint(1, 9))]
    crew = [(t, f"r{t}-{k}", k, rng.randint(0, 4)) for t in range(4) for k in range(5)]
    held = [(t, g, f"r{t}-{rng.randrange(5)}") for t in range(4) for g in range(0, 40, 3)]
    expect = {}
    for t in range(4):
        load = {who: n for team_, who, _, n in crew if team_ == t}
        sizes = Counter(g for team_, g in todo if team_ == t)
        holder = {g: who for team_, g, who in held if team_ == t and g}
        for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
            who = holder.get(g) or min(load, key=lambda w: (load[w], int(w.split("-")[1])))
            load[who] += sizes[g]
            expect[t, g] = who
    frames = [spark.createDataFrame(x, s) for x, s in ((todo, "team long, grp long"), (crew, "team long, reviewer_id string, place int, load long"), (held, "team long, grp long, reviewer_id string"))]
    assert {(r.team, r.grp): r.reviewer_id for r in team.by_group(*frames, ["team"]).collect()} == expect


def test_permissions_and_verdicts(spark):
    rows = [("manager", "assign", True), ("reviewer", "assign", False), ("supervisor", "supervise", True), ("ghost", "decide", False), (None, "decide", False)]
    got = spark.createDataFrame(rows, "role string, action string, ok boolean").withColumn("can", team.can(F.col("role"), F.col("action"))).collect()
    assert all(r.ok == r.can for r in got)
    rows = [("accept", "approved", "high", "", None), ("reject", "approved", "high", "", "note_required"), ("accept", "returned", "low", " ", "note_required"), (None, "approved", "low", "x", "no_decision"), ("accept", "odd", "low", "x", "verdict")]
    frame = spark.createDataFrame(rows, "decision string, verdict string, severity string, note string, expect string")
    assert all(r.expect == r.p for r in frame.withColumn("p", team.verdict_problem(*[F.col(c) for c in ("decision", "verdict", "severity", "note")])).collect())


def test_revision_decisions_can_come_back(spark):
    columns = "file_id string, input_index long, row_number long, group_raw string, ordinal_raw string, text string"
    make = lambda *t: spark.createDataFrame([("f", i, i + 1, "1", str(i + 1), x) for i, x in enumerate(t)], columns)
    scope = spark.createDataFrame([(1, 1, 9)], "grp long, first long, last long")
    old, new = revision.compare(make("a", "b"), make("a", "b"), scope), revision.compare(make("a", "c"), make("a", "b"), scope)
    decided = old.select("record_key", "evidence_fingerprint", F.lit("x").alias("context_fingerprint"))
    state = lambda df: {r.record_key: (r.status, r.stale_reason) for r in df.collect()}
    stale = revision.reconcile(decided, new, "x")
    assert state(stale) == {"1:1": ("active", None), "1:2": ("stale", "evidence_changed")}
    assert state(revision.reconcile(stale, old, "x"))["1:2"] == ("active", None)
    assert state(revision.reconcile(decided, old, "y"))["1:1"] == ("stale", "context_changed")
    assert "baseline_text" not in revision.redacted(new).columns
    assert revision.nfc_equivalent(revision.compare(make("\u00e9"), make("e\u0301"), scope)).first().nfc_equivalent


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("aab😀", max_size=8), st.text("aab😀", max_size=8)), min_size=1, max_size=10))
def test_raw_diff_rebuilds(spark, pairs):
    frame = spark.createDataFrame(pairs, "a string, b string").withColumn("d", T.raw_diff(F.col("a"), F.col("b")))
    for r in frame.collect():
        p = r.d.prefix
        assert r.a[:p] == r.b[:p] and r.a[p:].startswith(r.d.old_text) and r.b[p:].startswith(r.d.new_text)
        assert r.a[p + len(r.d.old_text) :] == r.b[p + len(r.d.new_text) :]


def test_both_ways_is_symmetric(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(50):
        a, b = ([x / sum(v) for x in v] for v in ([rng.random() for _ in range(3)] for _ in range(2)))
        rows.append((*a, *b))
    columns = [f"{d}{k}" for d in "fr" for k in semantic.LABELS]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    side = lambda d: F.struct(*[F.col(f"{d}{k}").alias(k) for k in semantic.LABELS])
    out = frame.select(semantic.both_ways(side("f"), side("r")).alias("x"), semantic.both_ways(side("r"), side("f")).alias("y")).collect()
    assert all(r.x == r.y and r.x is not None for r in out)
    broken = frame.select(semantic.both_ways(F.struct(*[F.lit(0.9).alias(k) for k in semantic.LABELS]), side("f")).alias("x"))
    assert broken.first().x is None


def test_context_results_replace_and_never_clear(spark):
    from tallymark.operators import audit

    from .test_audit import rows, sizes

    ours, theirs = rows(spark, [(1, 1, "a good day"), (1, 2, "one word"), (1, 3, "слово")]), rows(spark, [(1, 1, "a bad day"), (1, 2, "one more word"), (1, 3, "other")])
    report = audit.audit(ours, sizes(spark, 3), theirs, candidate_language="en", reference_language="en", verified=True)
    d = lambda c, e: (float(c), float(e), round(1.0 - c - e, 6))
    kind = "struct<contradiction: double, entailment: double, neutral: double>"
    results = spark.createDataFrame([("f", 1, 0, d(0.9, 0.05), d(0.1, 0.2), False), ("f", 1, 1, d(0, 1), d(0, 1), False), ("f", 2, 2, d(0.0, 0.9), d(0.0, 0.9), False), ("f", 3, 3, d(0, 1), d(0, 1), False)],
                                    f"file_id string, row_number long, seq int, forward {kind}, reverse {kind}, truncated boolean")
    done, found = semantic.with_context(report.rows, report.findings, results, "en")
    state = {r.row_number: r.context_status for r in done.collect()}
    assert state == {1: "risk", 2: "no_signal", 3: "abstain"}
    again = semantic.with_context(report.rows, found, results, "en")[1]
    for f in (found, again):
        assert sorted(r.code for r in f.where("code LIKE 'context%'").collect()) == ["context_contradiction", "context_language_mismatch"]
    assert {r.row_number: r.status for r in done.collect()}[1] == "needs_review"


def test_decision_store(spark):
    k = ["a" * 64, "b" * 64, "zz"]
    mk = lambda rows: spark.createDataFrame(rows, "fingerprint string, decision string, note string, saved_at string")
    current = mk([(k[0], "accept", "x", "2026-01-02"), (k[2], "accept", "x", "2026-01-02"), (k[1], "accept", " ", "2026-01-02")])
    assert [r.fingerprint for r in review.valid_decisions(current).collect()] == [k[0]]
    merged = review.merged_store(mk([(k[0], "accept", "new", "1")]), mk([(k[0], "reject", "old", "2"), (k[1], "refer", "old", "2")]))
    assert {r.fingerprint: r.note for r in merged.collect()} == {k[0]: "new", k[1]: "old"}


def test_stream_fold_equals_plain_fold(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randint(0, 9)}", rng.choice(["assign", "submit", "approve", "return"]), rng.randint(0, 50)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "case_id string, kind string, s long").select("case_id", "kind", F.timestamp_seconds("s").alias("at"))
    got = {r.case_id: (r.stage, r.applied, r.refused) for r in cases.case_states(frame).collect()}
    for case in got:
        mine = sorted((s, k) for c, k, s in rows if c == case)
        stage, _, applied, refused = cases.moved("unassigned", None, [(k, s) for s, k in mine])
        assert got[case] == (stage, applied, refused)


# --- sources --------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text('ab,"\n\r; x', max_size=6), min_size=2, max_size=2), min_size=1, max_size=5))
def test_quoted_cells_round_trip(records):
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in records)
    assert delimited.parse(text, ",") == records


@pytest.mark.parametrize(
    ("text", "code"),
    [('a,b"c', "quote_in_bare_cell"), ('"a"b,c', "text_after_quote"), ('"a,b', "unclosed_quote"), ("x,y\n1,2", "columns_not_recognised"), ("chapter,chapter,verse,text\n1,1,1,x", "ambiguous_header"),
     ("chapter,verse,text\n1,1", "ragged_row"), ("chapter,verse,text\n", "no_data_rows"), ("\n\n", "empty_file"), ("chapter,verse,text,verse_id\n1,1,x,2:1", "identifier_conflict")],
)
def test_malformed_text(text, code):
    with pytest.raises(Malformed) as e:
        files.parse_file("x.csv", text.encode())
    assert e.value.code == code


@pytest.mark.parametrize("text", ["chapter;verse;text\n1;2;a, b", "chapter\tverse\ttext\n1\t2\ta, b", "chapter|verse|text\n1|2|a, b", "﻿chapter,verse,text\r\n1,2,\"a, b\"", "\n\nid,text\n1:2,\"a, b\"", "1,2,\"a, b\""])
def test_layouts_give_the_same_row(text):
    rows, _ = files.parse_file("x.txt", text.encode())
    assert [(r["group_raw"], r["ordinal_raw"], r["text"]) for r in rows] == [("1", "2", "a, b")]


def test_incidental_id_column_is_ignored():
    rows, warnings = rows_from_matrix([["id", "chapter", "verse", "text"], ["17", "1", "2", "x"]])
    assert rows[0]["ordinal_raw"] == "2" and warnings == ["incidental_id_column_ignored"]


def test_xml_inherits_groups_and_refuses_entities():
    m = xml.matrix('<q><chapter number="4"><verse number="1">one <i>two</i></verse></chapter><aya sura="5" aya="2" text="t"/></q>')
    assert m[1:] == [["4", "1", "one two"], ["5", "2", "t"]]
    for bad, code in (("<!DOCTYPE a><a/>", "entities_refused"), ("<a>", "invalid_xml"), ("<a/>", "no_passages")):
        with pytest.raises(Malformed) as e:
            xml.matrix(bad)
        assert e.value.code == code


def book(cells: str, extra: dict[str, bytes] | None = None) -> bytes:
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>chapter</t></si><si><t>verse</t></si><si><r><t>te</t></r><r><t>xt</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData>{cells}</sheetData></worksheet>')
        for name, content in (extra or {}).items():
            z.writestr(name, content)
    return out.getvalue()


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'


def test_workbook_cells_keep_their_types():
    content = book(HEAD + '<row r="3"><c r="A3"><v>1</v></c><c r="B3"><v>2</v></c><c r="C3" t="inlineStr"><is><t>hi</t></is></c></row><row r="4"><c r="A4"><v>1</v></c><c r="B4"><v>3</v></c><c r="C4"><v>7</v></c></row>')
    rows, _ = files.parse_file("a.xlsx", content)
    assert [(r["ordinal_raw"], r["text"], r["raw_type"], r["row_number"]) for r in rows] == [("2", "hi", "string", 3), ("3", None, "number", 4)]
    assert workbook.sheets(content) == ["One"]


def test_hostile_archives():
    good = book(HEAD)
    with pytest.raises(Malformed):
        workbook.matrix(book(HEAD, {"../evil": b"x"}))
    with pytest.raises(Malformed) as e:
        workbook.matrix(book(HEAD, {"big": b"\0" * (51 << 20)}))
    assert e.value.code == "archive_budget"
    broken = bytearray(good)
    at = good.index(b"PK\x03\x04") + 60
    broken[at] ^= 0xFF
    with pytest.raises(Malformed):
        workbook.matrix(bytes(broken))
    with pytest.raises(Malformed):
        workbook.matrix(b"PK nothing")


# --- text ---------------------------------------------------------------------------------------


def test_canonical_json():
    assert udfs.canonical({"b": 1.0, "a": [None, "é", True]}) == '{"a":[null,"é",true],"b":1}'
    assert udfs.canonical({"savedAt": 1, "x": 2}, semantic=True) == '{"x":2}'
    with pytest.raises(ValueError):
        udfs.canonical(float("nan"))


def test_sql_functions(spark):
    udfs.register(spark)
    row = spark.sql("SELECT canonical_json('{\"b\":1,\"a\":2}') j, utf16_offset('😀a', 1) o, token_values('Ａb ’x') t, decode_entities('a&#65;&amp;&#xD800;') e, nfc('é') n").first()
    assert (row.j, row.o, row.e, row.n) == ('{"a":2,"b":1}', 2, "aA&", "é") and list(row.t) == ["ab", "x"]


def test_search_matches_whole_numbers(spark):
    rows = [("group 2 row 1", "group 2", True), ("group 20", "group 2", False), ("x112:3", "112:3", True), ("1112:3", "112:3", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("any", "", True)]
    for text, needle, expect in rows:
        assert spark.createDataFrame([(text,)], "t string").select(T.search_matches(F.col("t"), needle).alias("m")).first().m == expect


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_one_row(spark):
    assert __spark_entry__.entry(spark).count() == 1
