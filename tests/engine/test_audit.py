from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.functions import qualifiers, quantity
from tallymark.operators import audit, compare, index, structure

ROW = "file_id string, input_index long, row_number long, group_raw string, ordinal_raw string, text string, raw_type string"


def rows(spark, items, file="f"):
    """Rows of (group, ordinal, text[, raw type]) in file order."""
    return spark.createDataFrame([(file, i, i + 1, *(None if x is None else str(x) for x in r[:2]), r[2], r[3] if len(r) > 3 else "string") for i, r in enumerate(items)], ROW)


def sizes(spark, *counts):
    return index.numbering(spark.createDataFrame(list(enumerate(counts, 1)), "grp long, n long"))


def codes(report):
    return sorted(r.code for r in report.findings.select("code").collect())


def one(report):
    return report.summary.first().asDict()


def pair(spark, candidate, reference, language="en", **how):
    how = {"candidate_language": language, "reference_language": language, "verified": True} | how
    return audit.audit(rows(spark, [(1, 1, candidate)]), sizes(spark, 1), rows(spark, [(1, 1, reference)]), **how)


def test_gaps_are_ranges(spark):
    report = audit.audit(rows(spark, [(1, n, "text") for n in (1, 4, 5, 7)]), sizes(spark, 7))
    gap = json.loads(report.findings.where("code = 'missing_ids'").first().evidence)
    assert gap == {"grp": 1, "missing": 3, "ranges": [{"first": 2, "last": 3}, {"first": 6, "last": 6}]}
    assert one(report)["coverage_percent"] == 57.14 and not one(report)["structurally_complete"] and one(report)["certification"] == "none"


def test_copies_are_all_flagged_and_count_once(spark):
    report = audit.audit(rows(spark, [(1, 1, "one"), (1, 1, "other"), (1, 2, "two")]), sizes(spark, 2))
    found = report.findings.where("code = 'duplicate_id'").first()
    assert list(found.row_numbers) == [1, 2] and json.loads(found.evidence) == {"occurrences": 2, "conflicting_text": True}
    assert one(report)["covered_ids"] == 2 and one(report)["duplicate_rows"] == 1
    assert {r.comparison_reason for r in report.rows.where("row_number < 3").collect()} == {"duplicate_candidate"}


def test_order_looks_at_the_valid_row_before(spark):
    report = audit.audit(rows(spark, [(1, 1, "a"), (1, 3, "c"), (9, 1, "odd"), (1, 2, "b"), (1, 2, "b")]), sizes(spark, 3))
    found = report.findings.where("code = 'out_of_order'").collect()
    assert [list(f.row_numbers) for f in found] == [[4]] and json.loads(found[0].evidence)["previous_id"] == "1:3"


def test_identifiers_at_the_bounds(spark):
    items = [(0, 1, "x"), (2, 0, "x"), (2, "-1", "x"), (2, "1.5", "x"), (3, 1, "x"), (2, 5, "x"), (None, None, "x"), (2, "٤", "x")]
    report = audit.audit(rows(spark, items), sizes(spark, 3, 4))
    assert codes(report).count("invalid_id") == 7 and one(report)["covered_ids"] == 1


def test_ranges_empties_types_and_scope(spark):
    items = [(1, "1-2", "x"), (1, 1, " ​ "), (1, 2, None, "number"), (2, 1, "fine")]
    scope = spark.createDataFrame([(1,)], "grp long")
    report = audit.audit(rows(spark, items), sizes(spark, 3, 1), groups=scope)
    found = codes(report)
    for code, n in {"suspected_merged_range": 1, "invalid_id": 1, "empty_text": 2, "invalid_text_type": 1, "out_of_scope": 1}.items():
        assert found.count(code) == n, code
    assert one(report)["covered_ids"] == 2 and one(report)["expected_ids"] == 3


def test_provided_rows_claim_no_completeness(spark):
    report = audit.audit(rows(spark, [(1, 2, "x")]), sizes(spark, 9), complete=False)
    assert "missing_ids" not in codes(report) and one(report)["coverage_percent"] == 100


def test_empty_inputs(spark):
    report = audit.audit(rows(spark, []), sizes(spark, 2), rows(spark, []))
    assert report.rows.collect() == [] and report.findings.collect() == [] and report.summary.collect() == []


def test_reference_is_none_one_or_many(spark):
    reference = rows(spark, [(1, 1, "same"), (1, 2, "a"), (1, 2, "b"), (1, 3, " ")])
    report = audit.audit(rows(spark, [(1, 1, "same"), (1, 2, "a"), (1, 3, "c"), (1, 4, "d")]), sizes(spark, 4), reference, candidate_language="en", reference_language="en", verified=True)
    got = {r.row_number: (r.comparison_reason, r.status) for r in report.rows.collect()}
    assert got == {1: (None, "no_signal"), 2: ("ambiguous_reference", "abstain"), 3: ("empty_reference", "abstain"), 4: ("missing_reference", "abstain")}
    assert report.rows.count() == 4 and {"ambiguous_reference", "reference_integrity", "reference_coverage"} <= set(codes(report))


def test_unverified_never_clears(spark):
    report = pair(spark, "same", "same", verified=False)
    assert report.rows.first().status == "abstain" and "unverified_reference" in codes(report)


def test_a_row_can_lower_trust_but_not_raise_it(spark):
    reference = rows(spark, [(1, 1, "same"), (1, 2, "same")])
    from pyspark.sql import functions as F

    lowered = reference.withColumn("verification_status", F.when(F.col("row_number") == 1, "unverified").otherwise("verified"))
    ours = rows(spark, [(1, 1, "same"), (1, 2, "same")])
    for verified, expect in ((True, ["abstain", "no_signal"]), (False, ["abstain", "abstain"])):
        report = audit.audit(ours, sizes(spark, 2), lowered, candidate_language="en", reference_language="en", verified=verified)
        assert [r.status for r in report.rows.orderBy("row_number").collect()] == expect


def test_languages(spark):
    assert pair(spark, "same", "same", "fr").rows.first().status == "abstain"
    other = pair(spark, "same", "same", candidate_language="en", reference_language="ar")
    assert other.rows.first().comparison_reason == "language_mismatch"


@pytest.mark.parametrize(
    ("candidate", "reference", "code"),
    [
        ("There are 5 men here", "There are 7 men here", "potential_numeric_change"), ("he may go out now", "he must go out now", "potential_qualifier_change"),
        ("he did not go home", "he did go home", "potential_negation_change"), ("never no more of it", "no more of it", "negation_comparison_abstain"),
        ("about 5 kg of it", "5 kg of it", "numeric_comparison_abstain"), ("wholly other words are here", "nothing alike in that line", "lexical_difference"),
        ("<b>bold</b> words", "bold words", "text_hygiene"), ("bold words", "<b>bold</b> words", "reference_text_hygiene"),
    ],
)
def test_rules(spark, candidate, reference, code):
    assert code in codes(pair(spark, candidate, reference))


def test_clean_pairs_raise_nothing(spark):
    assert codes(pair(spark, "twenty-one days passed", "21 days passed")) in ([], ["lexical_difference"])
    assert pair(spark, "same words", "same words").rows.first().status == "no_signal"


def test_priority_is_stable(spark):
    report = audit.audit(rows(spark, [(1, 3, "a"), (1, 2, "<i>b</i>"), (9, 9, "c")]), sizes(spark, 3))
    ranked = [r.severity for r in structure.priority(report.findings).orderBy("place").collect()]
    assert ranked == sorted(ranked, key=structure.SEVERITIES.index)


# --- readings ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "language", "state", "reason"),
    [
        ("nine hundred and ninety-nine", "999", "en", "equivalent", None), ("two thousand and five", "2005", "en", "equivalent", None), ("1.5 km", "1500 m", "en", "equivalent", None),
        ("50 percent", "50%", "en", "equivalent", None), ("٣٫٥ متر", "3.5 متر", "ar", "equivalent", None), ("ثلاثة", "٣", "ar", "equivalent", None), ("1٬000", "1000", "en", "equivalent", None),
        ("5 men", "6 men", "en", "difference", None), ("12A", "13", "en", "abstain", "adjacent_identifier_or_compound_syntax"), ("5/6", "5", "en", "abstain", "fraction_range_date_or_time_not_supported"),
        ("10:30", "10", "en", "abstain", "fraction_range_date_or_time_not_supported"), ("nineteen hundred", "1900", "en", "abstain", "written_cardinal_composition_ambiguous"),
        ("ثلاثة عشر", "١٣", "ar", "abstain", "arabic_compound_cardinal_not_supported"), ("12٬34", "x", "en", "abstain", "invalid_arabic_grouping"), ("५", "5", "en", "abstain", "unicode_numeral_alphabet_not_supported"),
        ("1" * 43, "x", "en", "abstain", "numeric_literal_exceeds_bound"), ("5 m^2", "5 m", "en", "abstain", "compound_or_power_unit_not_supported"), ("5 and 6", "x", "en", "abstain", "separate_numeric_conjunction_ambiguous"),
        ("5 ^ 2", "5", "en", "abstain", "numeric_power_not_supported"), ("trois", "4", "fr", "difference", None),
    ],
)
def test_quantities(a, b, language, state, reason):
    got = quantity.compare(a, b, language)
    assert got["state"] == state
    if reason:
        assert reason in {r["reason"] for r in got["reasons"]}


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("all but one", "quantifier_exception_scope_not_supported"), ("nearly all", "approximate_quantifier_scope_not_supported"), ("day after day", "idiomatic_order_marker_not_supported"),
        ("he did not say that all go", "nonadjacent_negation_scope_not_supported"), ("must not go", "following_negation_scope_not_supported"), ("all and every", "multiple_markers_require_scope_binding"),
    ],
)
def test_qualifier_doubts(text, reason):
    assert reason in {r["reason"] for r in qualifiers.inventory(text)[1]}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc 12.,-/:%kgm٣½ ثلاثة\n and of", max_size=60))
def test_spans_give_back_their_text(text):
    for language in ("en", "ar"):
        for part in (*quantity.inventory(text, language), *qualifiers.inventory(text)):
            assert all(text[x["start"] : x["end"]] == x["text"] for x in part)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=20, unique=True))
def test_equal_inventories_under_permutation(numbers):
    a, b = (" men, ".join(map(str, x)) + " men" for x in (numbers, numbers[::-1]))
    assert quantity.compare(a, b, "en")["state"] in ("equivalent", "unchanged", "none", "abstain")


def test_lexical_needs_words(spark):
    pairs = spark.createDataFrame([("a b", "c d"), ("a b c", "d e f"), (None, "x y z"), ("", "")], "text string, other string")
    assert [r.lexical_difference for r in compare.lexical(pairs).collect()][:2] == [False, True]
