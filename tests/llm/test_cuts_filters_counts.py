from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm import filters, fim, token_counts

from .fixtures import documents, folder, frame


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    out = documents(23, 50)
    top = max(r["doc_id"] for r in out if r["doc_id"] is not None)
    for k, text in enumerate(["holds <S> a mark", "<P>", "a < b <M", "<", "😀" * 40, "x\n" * 50, "THE LOUD ONE " * 40, "same " * 120, "a" * 200_000, " " * 3000, "é<|endoftext|>  y  z"]):
        out.append(out[0] | {"doc_id": top + 1 + k, "text": text})
    out.append(out[-1] | {"doc_id": top + 50, "lang": None})
    out.append(out[-1] | {"doc_id": top + 51, "lang": "de"})
    return out


# --- fill in middle


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=5000), st.randoms())
def test_skip_list_reaches_every_rank(points, rng):
    listed = fim.SkipList(np.array(points, np.int64))
    before = np.r_[0, np.cumsum(points)].astype(int)
    for rank in {0, len(points), *[rng.randint(0, len(points)) for _ in range(30)]}:
        assert listed.seek(rank) == before[rank]


def test_a_rank_takes_few_nodes():
    listed = fim.SkipList(np.ones(1_000_000, np.int64))
    assert len(listed.lanes) == 4 and len(listed.lanes[-1][0]) <= fim.FAN
    for unit_widths, point_widths in listed.lanes:
        assert unit_widths.sum() == point_widths.sum() == 1_000_000
    assert listed.seek(777_777) == 777_777


def plain_fim(doc_id, text, units=None):
    text = text or ""
    parts = list(text) if units is None else []
    if units is not None and text:
        starts = [m.start() for m in regex.finditer(units, text)]
        ends = [0, *starts[1:], len(text)]
        parts = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    n = len(parts)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fim_query_equals_plain_version(spark, rows, tmp_path):
    got = Counter(tuple(r) for r in fim.query(spark, folder(tmp_path, rows)).collect())
    expect = Counter()
    for r in rows:
        n, form, prefix, middle, output = plain_fim(r["doc_id"], r["text"])
        expect[(r["doc_id"], n, form, prefix, middle, sha(output), sha(r["text"] or ""))] += 1
    assert got == expect
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_fim_by_words_keeps_all_columns(spark, rows):
    docs = frame(spark, rows)
    out = fim.transform(docs, units=r"\S+")
    assert out.columns == [*docs.columns, "fim"]
    for r in out.withColumn("again", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect():
        assert tuple(r["fim"]) == plain_fim(r["doc_id"], r["text"], r"\S+")
        assert r["again"] == (r["text"] or "") and r["size"] == -1
    replaced = fim.transform(docs.withColumn("fim", F.lit(1)), keep=["doc_id", "fim"])
    assert replaced.columns == ["doc_id", "fim"] and replaced.schema["fim"].dataType.fieldNames()[0] == "n"


def test_fim_other_rates_and_marks(spark, rows):
    marks = ("[pre]", "[suf]", "[mid]")
    out = fim.transform(frame(spark, rows), keep=["doc_id", "text"], cut=100, suffix_first=100, marks=marks)
    got = out.withColumn("again", fim.restored(F.col("fim.output"), F.col("fim.form"), marks)).collect()
    assert all(r["again"] == (r["text"] or "") for r in got)
    assert all(r["fim"]["form"] == ("spm" if r["text"] else "plain") for r in got)
    assert out.limit(0).collect() == [] and fim.transform(frame(spark, [])).collect() == []


# --- filters


def plain_audit(rows, labels):
    good, toxic = ({x["doc_id"] for x in labels if x["doc_id"] is not None and x[c] == 1} for c in ("quality", "toxic"))
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(r["doc_id"], first.get(r["text"] or "", r["doc_id"]))
    failed = []
    for r in rows:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (r["doc_id"] is not None and r["doc_id"] > first[text])
        failed.append((r["lang"] or "", set(fails), r["doc_id"] in good, r["doc_id"] in toxic))
    out, total = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {f[0] for f in failed}:
            left = [f for f in failed if f[0] == part]
            for step, name in enumerate(order, 1):
                hit = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                every = [f for f in failed if f[0] == part and name in f[1]]
                out[part, "".join(order), step] = (
                    len(left), len(hit), len(every) - len(hit), sum(f[1] == {name} for f in every), sum(f[2] for f in hit), sum(f[3] for f in hit),
                )
                total[part, name] += len(hit)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters_equal_plain_version(spark, rows, tmp_path):
    rng = random.Random(3)
    rows = [r | {"lang": rng.choice(["de", "en", None, ""])} for r in rows]
    rows += [rows[0]] * 40  # repeats of one id and text are no copies
    labels = [{"doc_id": r["doc_id"], "quality": rng.choice([0, 1, None]), "toxic": rng.choice([0, 1, None]), "text": "x"} for r in rows[::2]]
    labels += [labels[0] | {"quality": 1}, {"doc_id": None, "quality": 1, "toxic": 1, "text": None}, {"doc_id": 10**9, "quality": 1, "toxic": 1, "text": None}]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filters.query(spark, folder(tmp_path, rows, labels=labels)).collect()}
    assert got == plain_audit(rows, labels)
    assert len(got) == 3 * 600


def test_filters_of_nothing_and_of_fewer_filters(spark, tmp_path):
    assert filters.query(spark, folder(tmp_path, [])).collect() == []
    masks = spark.createDataFrame([("p", 3, 10, 2, 1), ("p", 0, 5, 1, 0), ("p", 2, 4, 4, 4)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in filters.interactions(masks, "XY").collect()}
    assert got == {("XY", 1): (9, 10, 0, 0, 2, 1, 10), ("XY", 2): (5, 4, 10, 4, 4, 4, 18), ("YX", 1): (5, 14, 0, 4, 6, 5, 18), ("YX", 2): (5, 0, 10, 0, 0, 0, 10)}


# --- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_path())


def expected_counts(rows, library):
    out = Counter()
    for r in rows:
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        out[r["doc_id"], len(text.encode()), n, n > 512] += 1
    return out


def test_counts_equal_the_library(spark, rows, library, tmp_path):
    assert Counter(tuple(r) for r in token_counts.query(spark, folder(tmp_path, rows)).collect()) == expected_counts(rows, library)


@pytest.mark.parametrize("few", [0, 10**6])
def test_stored_counts_are_joined_and_only_misses_encoded(spark, rows, library, monkeypatch, tmp_path, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    monkeypatch.setattr(token_counts, "HOT_ROWS", 2)
    path, cache = token_counts.default_path(), token_counts.Cache(spark, str(tmp_path / "cache"))
    rows = rows + [rows[0] | {"doc_id": 5000 + k} for k in range(30)]  # a hot group of copies
    docs = frame(spark, rows)
    half = frame(spark, rows[:20])
    token_counts.fill(half, path, cache)
    stored = cache.read().collect()
    assert len(stored) == len({r["text"] or "" for r in rows[:20]})
    # what is stored is taken, right or wrong
    wrong = [(r["version"], r["digest"], 10**6) for r in stored if r["digest"] == hashlib.sha256(rows[1]["text"].encode()).digest()]
    cache.append(spark.createDataFrame(wrong, "version string, digest binary, n_tokens long"))
    got = Counter(tuple(r) for r in token_counts.count(docs, path, cache).collect())
    expect = Counter()
    for k, c in expected_counts(rows, library).items():
        hit = any(r["doc_id"] == k[0] and r["text"] == rows[1]["text"] for r in rows)
        expect[(k[0], k[1], 10**6, True) if hit else k] += c
    assert got == expect
    added = len(list((tmp_path / "cache").glob("segment=*")))
    again = token_counts.count(docs, path, cache)
    assert len(list((tmp_path / "cache").glob("segment=*"))) == added, "nothing is encoded twice"
    assert Counter(tuple(r) for r in again.collect()) == expect
    cache.compact()
    assert len(list((tmp_path / "cache").glob("segment=*"))) == 1
    assert Counter(tuple(r) for r in token_counts.count(docs, path, cache).collect()) == expect


def test_a_run_that_broke_off_and_another_version(spark, rows, library, tmp_path):
    path, cache = token_counts.default_path(), token_counts.Cache(spark, str(tmp_path / "cache"))
    (tmp_path / "cache" / "segment=broken" / "_temporary" / "0").mkdir(parents=True)
    docs = frame(spark, rows[:10])
    mark = token_counts.fill(docs, path, cache)
    cache.append(cache.read().withColumn("version", F.lit("another")).withColumn("n_tokens", F.lit(7).cast("long")))
    assert token_counts.version("{}") != mark
    assert Counter(tuple(r) for r in token_counts.count(docs, path, cache, limit=512).collect()) == expected_counts(rows[:10], library)


def test_counts_of_nothing(spark):
    assert token_counts.count(frame(spark, []), token_counts.default_path(), token_counts.Cache(spark)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "'s", "123", "<|endoftext|>", "é", "!", "日本"]), min_size=50, max_size=400))
def test_parts_have_the_tokens_of_the_whole(library, pieces):
    text = "".join(pieces)
    before, token_counts.PART = token_counts.PART, 40
    try:
        cut = list(token_counts.parts(text))
    finally:
        token_counts.PART = before
    assert "".join(cut) == text
    whole = library.encode(text, add_special_tokens=False).ids
    assert [i for p in cut for i in library.encode(p, add_special_tokens=False).ids] == whole
