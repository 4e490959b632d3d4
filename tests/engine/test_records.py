from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tallymark.functions import passages, qualifiers, quantity
from tallymark.functions import text as T
from tallymark.operators import audit, baseline, findings, index, manifest, review
from tallymark.plans import queries
from tallymark.sources import reference, samples
from tallymark.streaming import cases

# Fixed expectations of the readings: two texts, a language, the state and the reasons.
READINGS = [
    (1, "There are 5 men", "There are 7 men", "en", "difference", ""),
    (2, "1000 m long", "1 km long", "en", "equivalent", ""),
    (3, "twenty-one days", "21 days", "en", "equivalent", ""),
    (4, "three hundred and five", "305 in all", "en", "equivalent", ""),
    (5, "a hundred men", "100 men", "en", "equivalent", ""),
    (6, "about 5 kg", "6 kg", "en", "abstain", "approximate_quantity_not_exact"),
    (7, "at least 5", "5", "en", "abstain", "bounded_quantity_not_exact"),
    (8, "1,000 men", "men", "en", "abstain", "western_comma_locale_ambiguous"),
    (9, "5 Km", "5 km", "en", "abstain", "unit_symbol_case_ambiguous"),
    (10, "ثلاثة رجال", "٣ رجال", "ar", "equivalent", ""),
    (11, "half a day", "a day", "en", "abstain", "written_cardinal_composition_ambiguous"),
    (12, "no number", "none here", "en", "none", ""),
    (13, "5 pounds", "6 pounds", "en", "abstain", "unit_conversion_not_supported"),
    (14, "1e5 men", "men", "en", "abstain", "scientific_notation_not_supported"),
    (15, "3 men", "3 women", "en", "unchanged", ""),
]

QUALIFIED = [
    (1, "all must go", "some must go", "en", "difference", ""),
    (2, "it is not permitted", "it is forbidden", "en", "equivalent", ""),
    (3, "May comes", "it comes", "en", "abstain", "capitalized_May_month_or_modality_ambiguous"),
    (4, "not all go", "all go", "en", "abstain", "negated_marker_scope_not_supported"),
    (5, "before noon", "after noon", "en", "difference", ""),
    (6, "plain", "text", "en", "none", ""),
    (7, "all", "some", "fr", "unsupported", ""),
    (8, "same all", "same all", "en", "unchanged", ""),
    (9, "in all", "no marker here", "en", "abstain", "idiomatic_all_not_supported"),
    (10, "must have gone", "went", "en", "abstain", "epistemic_modal_construction_not_supported"),
    (11, "every man", "each man", "en", "equivalent", ""),
]


@pytest.mark.parametrize("case", READINGS)
def test_readings_of_quantities(case):
    _, text, other, language, state, reasons = case
    got = quantity.compare(text, other, language)
    assert (got["state"], ",".join(dict.fromkeys(r["reason"] for r in got["reasons"]))) == (state, reasons)


@pytest.mark.parametrize("case", QUALIFIED)
def test_readings_of_qualifiers(case):
    _, text, other, language, state, reasons = case
    got = qualifiers.compare(text, other, language)
    assert (got["state"], ",".join(dict.fromkeys(r["reason"] for r in got["reasons"]))) == (state, reasons)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strict_forms(spark):
    raw = {"7": 7, "٧": 7, " ۱۲ ": 12, "007": 7, "1.5": None, "-3": None, "": None, "abc": None, "9007199254740991": 9007199254740991, "9007199254740992": None, "9" * 20: None}
    rows = spark.createDataFrame([(k, v) for k, v in raw.items()], "raw string, expect long").withColumn("got", T.strict_integer(F.col("raw"))).collect()
    assert all(r.expect == r.got for r in rows)
    assert one(spark, T.merged_range(F.lit("3-5"))).asDict() == {"first": 3, "last": 5} and one(spark, T.merged_range(F.lit("a-b"))) is None
    assert one(spark, T.hidden_control_flags(F.lit("a\u202eb\u200bc\u202e"))) == "bidi_control=U+202E:2;zero_width=U+200B:1"
    assert one(spark, T.bounded_integer(F.lit("12"), 1, 20)) == 12 and one(spark, T.bounded_integer(F.lit("21"), 1, 20)) is None and one(spark, T.bounded_integer(F.lit("1e1"), 1, 20)) is None
    assert one(spark, T.known_attribution(F.lit("Author not known"))) == "" and one(spark, T.known_attribution(F.lit(" Ann "))) == "Ann"
    assert one(spark, T.stem(F.lit("والكتاب"))) == "كتاب" and one(spark, T.stem(F.lit("في"))) == "في"


PASSAGES = [
    ("(1:3) See 10<sup>5</sup> here<sup>1</sup>", "See 10^5 here", 1), ("3. Text<sup>1</sup><div class='footnotes'>a note</div>", "Text", 1), ("3.", "3.", 0),
    ("<p>5 m<sup>2</sup> and <b>x</b>y</p>", "5 m^2 and xy", 0), ("a&#65;&amp;&#xD800; &foo; &lt", "aA& &foo; &lt", 0), ("<script>x<1</script>vis<!-- c -->ible", "vis ible", 0),
    ("5<a class='noteref'><sup>3</sup></a> end", "5 end", 1), ("<sup>1</sup>", "1", 0), ("x <sup>open", "x open", 0), ("", "", 0), ("3.5 units", "3.5 units", 0),
]


@pytest.mark.parametrize("case", PASSAGES)
def test_passages(case):
    html, text, anchors = case
    got = passages.read_passage(html, 1, 3)
    assert (got["text"], got["anchors_removed"]) == (text, anchors)


def test_long_passages_take_linear_time():
    began = time.time()
    passages.read_passage("a<sup>x</sup>" * 40_000, 1, 1)
    passages.read_passage("<" * 100_000 + "&" * 100_000, 1, 1)
    assert time.time() - began < 20


def test_teaching_file_finds_its_defects(spark):
    """The golden file: 24 rows with known defects in 4 groups of 22 identifiers."""
    sizes = index.numbering(spark.createDataFrame([*samples.TEACHING_GROUPS.items()], "grp long, n long"))
    given = samples.teaching_reference(spark).select(
        F.lit("teaching").alias("file_id"), (F.col("row_number") - 2).alias("input_index"), "row_number", F.col("grp").cast("string").alias("group_raw"), F.col("ord").cast("string").alias("ordinal_raw"), "text"
    )
    rows = samples.teaching_rows(spark)
    assert rows.count() == 24
    report = audit.audit(rows, sizes, given, candidate_language="en", reference_language="en", verified=True)
    got = {r["code"]: r["count"] for r in report.findings.groupBy("code").count().collect()}
    expect = {"duplicate_id": 1, "empty_text": 1, "invalid_id": 2, "missing_ids": 1, "out_of_order": 2, "suspected_merged_range": 1, "potential_negation_change": 1}
    assert {k: got.get(k) for k in expect} == expect
    report.unpersist()


def test_generated_defects_are_what_they_say(spark):
    sizes = index.numbering(spark.createDataFrame([(g, 40) for g in range(1, 30)], "grp long, n long"))
    sound = samples.numbered_file(sizes)
    made = samples.with_defects(sound, one_in=5)
    assert sound.count() == 29 * 40
    kinds = {r["defect"] for r in made.select("defect").distinct().collect()}
    assert kinds == {None, *samples.DEFECTS}
    assert made.where("defect = 'emptied' AND text <> ''").isEmpty() and made.where("defect = 'negation_removed' AND text LIKE '% not %'").isEmpty()
    flagged = baseline.naive_lookup(made.where("defect IS NULL OR defect <> 'deleted'").withColumn("row_number", F.col("input_index")), sound.withColumn("row_number", F.col("input_index")))
    gone = {r["reason"] for r in flagged.select("reason").distinct().collect()}
    assert gone == {"not_found", "differs", "absent"}


def test_empty_inputs_of_the_new_operators(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    sizes = index.numbering(none("grp long, n long"))
    wanted, skipped = reference.requested(none("row_number long, group_raw string, ordinal_raw string"), sizes)
    assert wanted.isEmpty() and skipped.isEmpty()
    assert findings.preview(none("file_id long, grp long, ord long"), ["file_id"]).isEmpty()
    assert manifest.rows_digest(none("file_id long, input_index long, row_number long, group_raw string, ordinal_raw string, text string"), ["file_id"]).isEmpty()
    assert review.parsed_store(spark.createDataFrame([("a", None), ("b", " "), ("c", "[1]")], "store string, raw string")).collect()[0]["store"] == "c"
    assert reference.display_texts(none("grp long, ord long, text string"), sizes, "x").isEmpty()


def test_display_needs_the_pinned_digest(spark):
    texts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "grp long, ord long, text string")
    sizes = index.numbering(spark.createDataFrame([(1, 2)], "grp long, n long"))
    assert reference.display_texts(texts, sizes, "0" * 64).isEmpty()


def test_upserts_keep_the_latest_row(spark, tmp_path):
    write = cases.upsert(str(tmp_path / "t"), ["id"], "at", buckets=3)
    batch = lambda *rows: spark.createDataFrame(rows, "id long, at long, v string")
    write(batch((1, 1, "a"), (2, 1, "b")), 0)
    write(batch((1, 2, "c"), (3, 1, "d"), (2, 0, "old")), 1)
    write(batch((1, 2, "c"), (3, 1, "d"), (2, 0, "old")), 1)  # comes again
    write(batch((4, 1, "e")), 2)
    got = {r.id: r.v for r in cases.upserted(spark, str(tmp_path / "t")).collect()}
    assert got == {1: "c", 2: "b", 3: "d", 4: "e"}


def test_every_query_of_the_library_has_sql_or_a_reason():
    assert set(queries.QUERIES) - set(queries.SQL) <= {"stage_machine", "stream_case_state"}


@pytest.mark.parametrize("stride", [1, 3, 1000])
def test_order_by_strides_equals_one_pass(spark, monkeypatch, stride):
    """The valid row before, whatever strides of a file it lies in; invalid rows in between don't count."""
    from tallymark.operators import structure

    monkeypatch.setattr(structure, "STRIDE", stride)
    rng = random.Random(stride)
    rows = [(f"f{i % 2}", i, i + 1, rng.choice(["1", "2", "x"]), str(rng.randint(1, 6)), "t") for i in range(60)]
    frame = spark.createDataFrame(rows, "file_id string, input_index long, row_number long, group_raw string, ordinal_raw string, text string")
    sizes = index.numbering(spark.createDataFrame([(1, 5), (2, 6)], "grp long, n long"))
    last, expect, seen = {}, set(), {}
    for file, i, _, g, o, _ in rows:
        if g != "x" and int(o) <= {"1": 5, "2": 6}[g]:
            position = {"1": 0, "2": 5}[g] + int(o)
            if file in last and position < last[file]:
                expect.add(i)
            last[file] = position
            seen[file, g, o] = seen.get((file, g, o), 0) + 1
    placed = structure.placed(structure.keyed(frame, sizes))
    assert {r.input_index for r in structure.out_of_order(structure.keyed(frame, sizes)).collect()} == expect
    assert all(r.copies == (seen[r.file_id, r.group_raw, r.ordinal_raw] if r.valid else 0) for r in placed.collect())
