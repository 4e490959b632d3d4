from __future__ import annotations


def test_workbooks_keep_the_limit_of_rows(spark, tmp_path):
    """A brand with more parts than a workbook may have rows: one more workbook, no part lost, one row of headings in all."""
    from tallymark.plans import record_queries as q

    n = 20_003
    part = spark.range(n).selectExpr("id AS p_partkey", "'plate' AS p_name", "CASE WHEN id < 2 THEN 'Brand#2' ELSE 'Brand#1' END AS p_brand", "cast(id % 50 AS int) AS p_size")
    part.write.parquet(str(tmp_path / "part.parquet"))
    assert {tuple(r) for r in q.workbook_cells(spark, str(tmp_path)).collect()} == {("Brand#1", 3 * (n - 2) + 3), ("Brand#2", 9)}
    rows = q.workbook_round_trip(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted((k + 1, str(k % 50), "plate") for k in range(n))


def test_qualifiers_of_a_long_text_take_linear_time():
    """Many markers and no negation before them: each looked back over the whole text."""
    import time

    from tallymark.functions import qualifiers

    text = "all must go before noon " * 10_000
    start = time.process_time()
    markers, reasons = qualifiers.inventory(text + "not")
    assert time.process_time() - start < 10
    assert len(markers) == 30_000 and not any(r["reason"].startswith("nonadjacent") for r in reasons)
    # the first negation counts from the second token behind it on
    assert [r["reason"] for r in qualifiers.inventory("not so all")[1]] == ["nonadjacent_negation_scope_not_supported"]
    assert [r["reason"] for r in qualifiers.inventory("not all")[1]] == ["negated_marker_scope_not_supported"]


def test_tokens_of_ascii_text_are_those_of_any_text():
    """Text of ASCII only has a pattern of its own; behind a foreign letter the general one reads the same."""
    import random

    from tallymark.functions import qualifiers, quantity

    rng = random.Random(1)
    for _ in range(2_000):
        text = "".join(rng.choice("aB1 0.,+-eE'%_/\t\x1c\x0b^<five") for _ in range(rng.randint(0, 30)))
        for module in (quantity, qualifiers):
            general = [t for t in module.tokenise("é " + text)][1:]
            assert [(t.text, t.value, t.start, t.end) for t in module.tokenise(text)] == [(t.text, t.value, t.start - 2, t.end - 2) for t in general]


def test_cheap_tests_of_characters_tell_what_the_patterns_tell(spark):
    from pyspark.sql import functions as F

    from tallymark.functions import text as T

    texts = ["", " \t\u3000", "\u200b", "\u200b \ufeff", " x ", "\n", "a<b>c", "a & b", "&amp;", "soft\u00adhyphen", "caf\u00e9", "p\u0430y", "see \u0633\u0644\u0627\u0645", "a\u200eb", "\u034f", "it\u2019s not"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", T.meaningful(F.col("t")).alias("m"), T.hygiene(F.col("t"), F.lit("en"))["kind"].alias("k"), T.negation_count(T.token_values(F.col("t")), "en").alias("n")).collect()
    kinds = {"a<b>c": ["markup"], "&amp;": ["markup"], "soft\u00adhyphen": ["hidden_controls"], "p\u0430y": ["mixed_script_word"], "see \u0633\u0644\u0627\u0645": ["foreign_script"], "a\u200eb": ["directional_marks"]}
    for r in got:
        assert r.m == bool(r.t.replace("\u200b", "").replace("\ufeff", "").replace("\u200e", "").strip()), repr(r.t)
        assert r.t in ("\u034f", "\u200b", "\u200b \ufeff") or r.k == kinds.get(r.t, []), repr(r.t)
        assert r.n == ("not" in r.t)


class _State:
    """A state that counts what goes to and from it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    put = update

    def appendList(self, values):  # noqa: N802
        self.update([*(self.value or []), *values])

    def clear(self):
        self.update(None)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_a_case_goes_to_its_state_once_for_all_its_messages():
    """Each message was a call to the state, and each time a timer that read all that waited."""
    import datetime
    from types import SimpleNamespace

    from pyspark.sql import Row

    from tallymark.streaming import workflow

    at = lambda k: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=k)
    rows = [Row(case_id="c", message_id=f"m{k}", kind="assign", at=at(k), decision=None, verdict=None, note=None, severity=None) for k in range(500)]
    p = workflow.CaseProcessor()
    p.handle = p.case = _State()
    p.waiting, p.history, p.handle = _State(), _State(), _State()
    list(p.handleInputRows(("c",), iter(rows + rows[:9]), None))
    assert p.waiting.calls == 1 and p.handle.timers == [workflow._millis(at(0))]
    now = lambda k: SimpleNamespace(getCurrentWatermarkInMs=lambda: workflow._millis(at(k)))
    expired = lambda k: SimpleNamespace(getExpiryTimeInMs=lambda: workflow._millis(at(k)))
    (first,) = p.handleExpiredTimer(("c",), now(399), expired(0))
    assert first.applied == 400 and p.handle.timers[-1] == workflow._millis(at(400)) and len(p.waiting.value) == 100
    (second,) = p.handleExpiredTimer(("c",), now(600), expired(400))
    assert second.applied == 500 and p.waiting.value is None


def test_points_look_into_few_cells(spark):
    """Intervals of any width lie in six levels, not 21."""
    from pyspark.sql import functions as F

    from tallymark.operators import intervals

    got = {r.w: r.k for r in spark.range(1, 3_000).select(F.col("id").alias("w"), intervals._level(F.col("id")).alias("k")).collect()}
    assert set(got.values()) == {0, 4, 8, 12} and all(2**k >= w for w, k in got.items())


def test_phrases_are_read_as_their_entry_says(spark):
    """A phrase in parts of words, in whole words, or letter by letter: "mit licensed" names no MIT license."""
    from tallymark.operators import review

    texts = ["under the MIT license.", "mit licensed work", "a permit license", "MIT\n license", "the copyright notice", "copyright-notice", "COPYRIGHT NOTICES", "none"]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")
    shape = "entry string, place int, boundary boolean, keyword string, steps array<int>, reading string"
    read = lambda how: spark.createDataFrame([("licence", 0, True, "copyright notice", [1], how and "letters"), ("mit", 1, False, "mit license", [1], how and "words")], shape)
    got = lambda entries: {r.question_id for r in review.best_entry(asked, entries).where("matched").collect()}
    assert got(read(True)) == {0, 3, 4, 6}
    assert got(read(None)) == got(read(None).drop("reading")) == {0, 1, 2, 3, 4, 5, 6}


def test_keyword_retrieval_takes_whole_words(spark, tmp_path):
    """One text with "mit licensed" was taken for the license, which the SQL doesn't."""
    from tallymark.plans import review_queries as q

    docs = spark.createDataFrame([(0, "sttz mit licensed under"), (1, "The MIT-License"), (2, "copyright  notice"), (3, "Copyright notice"), (4, None)], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in q.keyword_retrieval(spark, str(tmp_path)).collect()} == {(0, "fallback"), (1, "mit"), (2, "fallback"), (3, "licence")}


def test_an_audit_without_a_reference_joins_none(spark):
    """It is that against a reference without rows, but meets none, deals out no rows and keeps only what is read again."""
    from tallymark.operators import audit as A
    from tallymark.operators import index

    shape = "file_id string, input_index long, row_number long, group_raw string, ordinal_raw string, text string"
    lines = [("f", "1", "1", "it is not so"), ("f", "1", "3", "b"), ("f", "1", "2", "c"), ("f", "1", "2", "d"), ("f", "x", "1", "e"), ("f", "2", "1", ""), ("f", "2", "2-3", "<b>g</b>"), ("e", "9", "1", "h")]
    rows = spark.createDataFrame([(f, k, k + 1, *rest) for k, (f, *rest) in enumerate(lines)], shape)
    sizes = index.numbering(spark.createDataFrame([(1, 4), (2, 3)], "grp long, n long"))
    bare, empty = (A.audit(rows, sizes, given, candidate_language="en") for given in (None, rows.limit(0)))
    assert set(bare.rows.dtypes) == set(empty.rows.dtypes)
    told = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert told(bare.rows) == told(empty.rows)
    assert told(bare.findings) == told(empty.findings)
    plan = bare.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "references" not in plan.replace("AS references", "")
    assert bare._kept.columns == list(A.Audit.KEPT)


def test_plain_identifiers_are_read_as_all_others(spark):
    from pyspark.sql import functions as F

    from tallymark.functions import text as T

    known = {"7": 7, "007": 7, "0": 0, "": None, " ": None, " 12 ": 12, "١٢": 12, "999999999999999": 999999999999999, "0" * 20 + "5": 5, "9007199254740991": 9007199254740991,
             "9007199254740992": None, "+5": None, "-5": None, "5.0": None, "5e3": None, "1a": None, "5L": None, None: None}
    rows = spark.createDataFrame([(t,) for t in known], "t string")
    assert {r.t: r.n for r in rows.select("t", T.strict_integer(F.col("t")).alias("n")).collect()} == known
    spans = {"3-5": (3, 5), "3 — 5": (3, 5), "٣–٥": (3, 5), "35": None, "-": None, "a-5": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in spans], "t string")
    assert {r.t: r.s and tuple(r.s) for r in rows.select("t", T.merged_range(F.col("t")).alias("s")).collect()} == spans


def test_many_rows_meet_the_index_in_more_tasks(spark, tmp_path, monkeypatch):
    """However large the table was, its rows met the index in as many tasks as the session has partitions."""
    from tallymark.operators import index, structure
    from tallymark.plans import structure_queries as q
    from tallymark.plans import tables

    lines = spark.range(900).selectExpr("id div 3 + 1 AS l_orderkey", "cast(id % 3 + 1 AS int) AS l_linenumber", "date'2024-01-01' AS l_shipdate", "id AS l_partkey", "'A' AS l_returnflag")
    lines.unionByName(lines.where("l_orderkey = 5")).write.parquet(str(tmp_path / "lineitem.parquet"))
    told = lambda: {tuple(r) for r in q.duplicate_groups(spark, str(tmp_path)).collect()}
    assert tables.line_tasks(spark, str(tmp_path)) is None and told() == {(5, k, 2, False) for k in (1, 2, 3)}
    monkeypatch.setattr(index, "ROWS_A_TASK", 100)
    assert tables.line_tasks(spark, str(tmp_path)) == 10 and told() == {(5, k, 2, False) for k in (1, 2, 3)}
    rows = tables.lines_as_rows(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 10
    keyed = structure.keyed(rows, index.numbering(tables.order_sizes(spark, str(tmp_path))), many=10)
    assert "hashpartitioning(__grp" in keyed._jdf.queryExecution().executedPlan().toString()


def _same_in_more_tasks(spark, folder, monkeypatch, query):
    """The query's rows, which have to be the same when its lines are dealt to more tasks than the session has."""
    from tallymark.operators import index

    lines = spark.range(900).selectExpr("id div 3 + 1 AS l_orderkey", "cast(id % 3 + 1 AS int) AS l_linenumber", "date'2024-01-01' AS l_shipdate", "-id AS l_partkey", "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'R' END AS l_returnflag", "'F' AS l_linestatus")
    lines.where("l_orderkey % 7 > 0 OR l_linenumber <> 2").unionByName(lines.where("l_orderkey = 5")).write.parquet(str(folder / "lineitem.parquet"))
    spark.range(1, 301).selectExpr("id AS o_orderkey", "CASE WHEN id % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus").write.parquet(str(folder / "orders.parquet"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = query(spark, str(folder))
    told = sorted(tuple(r) for r in before.collect())
    assert told and "REPARTITION_BY_NUM" not in plan(before)
    monkeypatch.setattr(index, "ROWS_A_TASK", 100)
    after = query(spark, str(folder))
    assert sorted(tuple(r) for r in after.collect()) == told
    return told, plan(after)


def test_files_and_index_meet_in_more_tasks(spark, tmp_path, monkeypatch):
    """Bitmaps, their cells and the rows before them were dealt to the session's partitions, however many there were."""
    from tallymark.operators import coverage
    from tallymark.plans import file_queries as q

    made = []
    cells = coverage.cells
    monkeypatch.setattr(coverage, "cells", lambda index, groups=None, many=None: made.append(many) or cells(index, groups, many))
    told, _ = _same_in_more_tasks(spark, tmp_path, monkeypatch, q.missing_by_file)
    assert made[0] is None and made[-1] >= 9
    assert ("A", 1, 2, 2, 1) in told and ("R", 1, 1, 1, 1) in told


def test_files_are_counted_in_one_pass(spark, tmp_path, monkeypatch):
    """Rows in scope, outside and all of them were counted one after the other, each from the table on."""
    from tallymark.plans import file_queries as q

    told, _ = _same_in_more_tasks(spark, tmp_path, monkeypatch, q.coverage_by_file)
    assert sum(r[1] for r in told) == 900 - 42 + 3
    plan = q.coverage_by_file(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS file_id#") == 1


def test_order_queries_meet_in_more_tasks(spark, tmp_path, monkeypatch):
    from tallymark.plans import record_queries, structure_queries

    for k, query in enumerate((structure_queries.out_of_order, structure_queries.missing_ranges, record_queries.missing_preview, record_queries.naive_lookup, record_queries.generated_file)):
        with monkeypatch.context() as m:
            (tmp_path / str(k)).mkdir()
            _, plan = _same_in_more_tasks(spark, tmp_path / str(k), m, query)
            assert ", 9), REPARTITION_BY_NUM" in plan, query.__name__


def test_dealing_makes_no_row_of_a_slot(spark):
    """Every level up to the highest load was a row for each reviewer below it, and one task held all of a team."""
    from tallymark.operators import team

    high = 3_000_000_000
    todo = spark.range(10).selectExpr("'t' AS team", "concat('c', id) AS fingerprint", "'high' AS severity", "0L AS grp")
    crew = spark.createDataFrame([("t", "a", 0, high), ("t", "b", 1, 0), ("t", "c", 2, 3), ("t", "gone", 3, None), ("u", "d", 0, 0)], "team string, reviewer_id string, place int, load long")
    got = team.balanced(todo, crew, ["team"])
    assert got.columns == ["team", "slot", "fingerprint", "severity", "grp", "reviewer_id"]
    assert [r.reviewer_id for r in got.orderBy("slot").collect()] == ["b", "b", "b", "b", "c", "b", "c", "b", "c", "b"]


def test_dealing_in_many_tasks_equals_a_heap(spark, monkeypatch):
    """Uneven loads, cases in more tasks than the session has, blocks of two slots; rows broadcast and not."""
    import heapq
    import random

    from tallymark.operators import ranks, structure, team

    rng = random.Random(4)
    crew = [(t, f"r{t}-{k:02}", k, rng.choice([0, 0, 5, rng.randint(0, 40)])) for t in range(3) for k in range(12)] + [(None, "none", 0, 0)]
    todo = [(rng.choice([0, 0, 0, 1, 2, 7, None]), f"{k:04}", rng.choice(structure.SEVERITIES), rng.randint(0, 3)) for k in range(1500)]
    expect = {}
    for t in range(3):
        heap = [(load, place, who) for team_, who, place, load in crew if team_ == t]
        heapq.heapify(heap)
        for _, name, _, _ in sorted((c for c in todo if c[0] == t), key=lambda c: (structure.SEVERITIES.index(c[2]), c[3], c[1])):
            load, place, who = heap[0]
            heapq.heapreplace(heap, (load + 1, place, who))
            expect[name] = who
    monkeypatch.setattr(team, "SLOT_BITS", 1)
    cases = spark.createDataFrame(todo, "team int, fingerprint string, severity string, grp long")
    members = spark.createDataFrame(crew, "team int, reviewer_id string, place int, load int")
    for most in (500_000, 0):
        monkeypatch.setattr(team, "BROADCAST_ROWS", most)
        monkeypatch.setattr(ranks, "BROADCAST_FIRSTS", most)
        got = team.balanced(cases, members, ["team"], 9)
        rows = got.collect()
        assert len(rows) == len(expect) and {r.fingerprint: r.reviewer_id for r in rows} == expect


def test_ranks_in_many_ranges_equal_sorting(spark, monkeypatch):
    """Ranges were as many as the session's partitions, and ranges of a key met again in one task."""
    import random

    from pyspark.sql import functions as F

    from tallymark.operators import ranks

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), k) for k in range(3000)] + [(f"k{k}", 0, k) for k in range(300)]
    expect, numbers = set(), {}
    for r in sorted(rows, key=lambda r: (-r[1], r[2])):
        numbers[r[0]] = numbers.get(r[0], 0) + 1
        expect.add((*r, numbers[r[0]]))
    df = spark.createDataFrame(rows, "k string, v long, id long")
    kept = []
    written = ranks.written
    monkeypatch.setattr(ranks, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    for most in (100_000, 0):
        monkeypatch.setattr(ranks, "BROADCAST_FIRSTS", most)
        got = ranks.ranked(df, ["k"], [F.col("v").desc(), F.col("id")], "n", 11)
        assert ("Window" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
        told = got.collect()
        assert len(told) == len(rows) and {tuple(r) for r in told} == expect
        sizes = [r["n"] for r in kept[-2].groupBy(F.shiftright("__at", 33)).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 11 and max(sizes) < 900


def test_queries_by_ranks_use_more_tasks(spark, tmp_path, monkeypatch):
    """The deal of the orders and their priority give the same rows from more tasks than the session has."""
    from tallymark.operators import index, structure, team
    from tallymark.plans import review_queries as q

    priority = "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-LOW', '5-LOW'), cast(id * 7 % 5 + 1 AS int)) AS o_orderpriority"
    spark.range(900).selectExpr("id AS o_orderkey", "id * id % 60 AS o_custkey", "'F' AS o_orderstatus", priority).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(60).selectExpr("id AS c_custkey", "cast(id % 3 AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(20).selectExpr("id AS s_suppkey", "cast(id % 3 AS int) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    asked = []
    for module in (structure, team):
        ranked = module.ranked
        monkeypatch.setattr(module, "ranked", lambda rows, by, order, name, many=None, _ranked=ranked: asked.append(many) or _ranked(rows, by, order, name, many))
    for query in (q.assign_balanced, q.priority_queue):
        with monkeypatch.context() as m:
            told = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
            m.setattr(index, "ROWS_A_TASK", 100)
            assert len(told) == 900 and sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == told
        assert asked[-2:] == [None, 9], query.__name__


def test_readings_look_at_numbers_and_markers_only(monkeypatch):
    """Of a long text only what lies around its numbers and markers becomes tokens, and what is read is that of the whole."""
    import random

    from tallymark.functions import qualifiers, quantity, spots

    seen = []
    for module in (quantity, qualifiers):
        monkeypatch.setattr(module, "token_value", lambda t, value=quantity.token_value: seen.append(t) or value(t))
    text = "about 5 kg " + "lorem ipsum, d\u00e9j\u00e0 vu; " * 5_000 + "it must not be, two thousand"
    amounts, _ = quantity.inventory(text, "en")
    markers, reasons = qualifiers.inventory(text)
    assert [a["text"] for a in amounts] == ["5 kg", "two thousand"] and [m["text"] for m in markers] == ["must"] and reasons
    assert len(seen) < 500
    rng = random.Random(3)
    words = "one two-thousand 5 1.5 \u0663 kg m/s about at_least don't don\u2019t not may May must all but x'no 'not \uff4fne \u212a an\u00e9one one\u00e9 \u2014 ( phone often".replace("_", " ").split(" ")
    for _ in range(300):
        made = "".join(rng.choice(words) + rng.choice((" ", ", ", "\u00a0", "\x1c", " word" * rng.randint(1, 60) + " ")) for _ in range(rng.randint(1, 12)))
        for language in ("en", "fr", "ar"):
            pair = made, made.replace("one", "two").replace("may", "must")
            near = quantity.compare(*pair, language), qualifiers.compare(*pair, language)
            with monkeypatch.context() as whole:
                whole.setattr(spots, "lowered", lambda text: None)
                quantity.stretches.cache_clear()
                assert near == (quantity.compare(*pair, language), qualifiers.compare(*pair, language)), made
            quantity.stretches.cache_clear()


def test_a_letter_that_depends_on_its_place_is_lowered_by_token(spark):
    from pyspark.sql import functions as F

    from tallymark.functions import text as T

    texts = ["\u039f\u0394\u039f\u03a3.\u0391 B", "\u0130stanbul K\u00d6LN", "DON\u2019T Stop", "\u0627\u0644\u0633\u0651\u0644\u0627\u0645 OK"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_values(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [["\u03bf\u03b4\u03bf\u03c2", "\u03b1", "b"], ["i\u0307stanbul", "k\u00f6ln"], ["don't", "stop"], ["\u0627\u0644\u0633\u0644\u0627\u0645", "ok"]]


_SHAPE = "file_id string, input_index long, row_number long, group_raw string, ordinal_raw string, text string"


def _odd_rows(spark, seed, n, spread):
    import random

    rng, texts = random.Random(seed), ["he did not go", "he did go", "there are 5 kg", "<b>x</b>", " ", None, "all must go", "wholly other words here"]
    rows = []
    for file in ("e", "f"):
        for i in range(n):
            at = (1 + i * 9 // n, str(1 + i % 9)) if rng.random() < 0.7 else (rng.randint(1, 10), rng.choice(["1", "2", "9", "2-3", None]))
            rows.append((file, i * spread, i * spread + 1, str(at[0]), at[1], rng.choice(texts)))
    return spark.createDataFrame(rows, _SHAPE)


def test_statuses_need_no_evidence_and_one_branch(spark):
    """Who reads statuses pays for no evidence, and rows go through one chain of steps, not two."""
    from tallymark.operators import audit as A
    from tallymark.operators import index

    sizes = index.numbering(spark.createDataFrame([(g, 9) for g in range(1, 10)], "grp long, n long"))
    report = A.audit(_odd_rows(spark, 1, 40, 1), sizes, _odd_rows(spark, 2, 40, 1).where("file_id = 'f'"), complete=False, candidate_language="en", reference_language="en", verified=True)
    plan = report.rows.groupBy("file_id", "status").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "Union" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_summary_counts_what_the_findings_are(spark, monkeypatch):
    """Its counts are those of rows and findings, in one pass that keeps no rows; strides and blocks of groups are short here."""
    from collections import Counter

    from tallymark.operators import audit as A
    from tallymark.operators import index, structure

    monkeypatch.setattr(structure, "BLOCK", 4)
    monkeypatch.setattr(structure, "STRIDE", 3)
    sizes = index.numbering(spark.createDataFrame([(g, 9 if g % 2 else 2) for g in range(1, 10)], "grp long, n long"))
    sound = spark.createDataFrame([("e", 900 + k, 901 + k, "7", str(1 + k), "x y") for k in range(9)], _SHAPE)
    reference = _odd_rows(spark, 2, 60, 1).where("file_id = 'f'")
    scope = spark.createDataFrame([(g,) for g in (1, 2, 3, 7)], "grp long")
    for given, groups, complete in ((None, None, True), (None, scope, True), (reference, None, True), (reference, None, False)):
        report = A.audit(_odd_rows(spark, 1, 80, 2).unionByName(sound), sizes, given, groups, complete, candidate_language="en", reference_language="en", verified=True, many=None if given is None else 5)
        summary = {r.file_id: r for r in report.summary.collect()}
        assert "_kept" not in report.__dict__
        rows, found = report.rows.collect(), report.findings.collect()
        for file, r in summary.items():
            mine, own = [x for x in rows if x.file_id == file], [x for x in found if x.file_id == file]
            codes, kinds, states = Counter(x.code for x in own), Counter(x.type for x in own), Counter(x.status for x in mine)
            assert (r.findings, r.structural_findings, r.comparison_findings) == (len(own), kinds["structural"], kinds["comparison"])
            assert all(r[f"n_{code}"] == codes[code] for code in A._COUNTED) and r.duplicate_ids == codes["duplicate_id"]
            assert (r.needs_review_rows, r.abstain_rows, r.no_signal_rows) == (states["needs_review"], states["abstain"], states["no_signal"])
            assert (r.covered_ids, r.valid_rows) == (len({x.id for x in mine if x.in_scope}), sum(x.valid for x in mine))
            assert r.duplicate_rows == r.valid_rows - len({x.id for x in mine if x.valid})
        assert summary["e"].n_out_of_order > 0 and (given is None) == (summary["e"].n_lexical_difference == 0)
        report.unpersist()


def test_a_complete_audit_moves_rows_twice(spark, tmp_path, monkeypatch):
    """To the index and to their place in the file; it was read in many branches and kept whole."""
    from tallymark.operators import index
    from tallymark.plans import file_queries as q

    rows = [(k // 5, 1 + k % 5 - (k % 50 == 3), "ARN"[k % 3], "O") for k in range(2_000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(index, "ROWS_A_TASK", 100)
    out = q.complete_audit(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and plan.count("Relation [") <= 6
    for r in out.collect():
        have = [(g, n) for g, n, flag, _ in rows if flag == r.file_id]
        assert (r.total_rows, r.covered_ids, r.duplicate_rows) == (len(have), len(set(have)), len(have) - len(set(have)))
        assert r.missing_ids == r.expected_ids - r.covered_ids and not r.structurally_complete
