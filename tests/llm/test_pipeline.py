from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from tallymark.llm import bpe, mixing, toxicity
from tallymark.llm.common import components

from .fixtures import documents, folder, frame
from .test_models_and_vectors import corpus
from .test_text_operators import brute_components, brute_dropped, collect


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    docs, labels = corpus(200)
    shared = documents(11, 40)
    for r in shared:
        r["doc_id"] = None if r["doc_id"] is None else r["doc_id"] + 1000
    return folder(tmp_path_factory.mktemp("pipeline"), docs + shared, [], labels)


def test_stages_keep_their_columns_and_run_agrees(spark, store):
    docs = spark.read.parquet(f"{store}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, store)
        assert after.columns == columns, name
        kept = collect(after)
        check(spark, store, name, collect(before), kept)
        before = frame_of(spark, docs, kept)
    last = Counter((r["doc_id"], r["ids_sha256"]) for r in collect(corpus_pipeline.STAGES[-1][1](spark, before, store)))
    assert last == Counter((r["doc_id"], r["ids_sha256"]) for r in collect(corpus_pipeline.run(spark, store)))
    coder = bpe.Coder(bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read()))
    expect = Counter((r["doc_id"], hashlib.sha256(" ".join(map(str, coder.encode(r["text"]))).encode()).hexdigest()) for r in collect(before))
    assert last == expect


def frame_of(spark, like, rows):
    return spark.createDataFrame([tuple(r[c] for c in like.columns) for r in rows], like.schema)


def check(spark, store, name, before, after):
    """Each stage against a plain version of its rule, on its own input."""
    if name == "toxicity":
        docs = spark.read.parquet(f"{store}/documents.parquet")
        scored = collect(toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{store}/labels.parquet"))))
        assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in scored if not r["predicted"])
        assert 0 < len(after) < len(before)
    elif name == "lines":
        gone = brute_dropped(before)
        expect = Counter()
        for r in before:
            text = r["text"]
            if text is not None and r["doc_id"] is not None:
                lines = text.split("\n")
                kept = [line for pos, line in enumerate(lines) if (r["doc_id"], pos) not in gone]
                text = "\n".join(kept)
                if len(kept) < len(lines) and not text.strip():
                    continue
            expect[r["doc_id"], text] += 1
        assert Counter((r["doc_id"], r["text"]) for r in after) == expect
        assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
    elif name == "near_duplicates":
        expect = brute_components(before, 5, 80)
        assert {r["doc_id"] for r in after if r["doc_id"] is not None} == {d for d, _, c in expect if d is not None and d == c}
    elif name == "mixing":
        plan = collect(mixing.plan(frame_like(spark, before)))
        copies = Counter()
        for r in plan:
            copies[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
        got = Counter(r["doc_id"] for r in after if (r["text"] or "").split())
        assert got == +copies


def frame_like(spark, rows):
    return frame(spark, rows)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(1, 2), (2, 1), (3, 3), (None, 4), (900, 5)]
    got = {r["id"]: r["component"] for r in collect(components(spark.createDataFrame(edges, "a long, b long")))}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [*range(5, 40), 900]} == {5}
    assert got[2] == 1 and 3 not in got and 4 not in got


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
