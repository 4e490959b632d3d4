from __future__ import annotations

import pytest

from tallymark.streaming import cases
from tallymark.streaming.store import Conflict, FindingsStore


@pytest.fixture
def made(spark, tmp_path):
    store = FindingsStore(spark, str(tmp_path / "store"))
    return store, lambda rows: spark.createDataFrame(rows, "file_id string, layer string, n long"), lambda rows: spark.createDataFrame(rows, "file_id string, layer string")


def held(store, at=None):
    return sorted((r["file_id"], r["layer"], r["n"]) for r in store.read(at).collect())


def test_a_run_replaces_its_files_and_layers(made):
    store, findings, runs = made
    with pytest.raises(ValueError):
        store.read()
    store.commit(findings([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)]), runs([("a", "x"), ("a", "y"), ("b", "x")]))
    assert store.commit(findings([("a", "x", 5), ("c", "x", 6)]), runs([("a", "x"), ("b", "x")])) == 1
    # b ran without findings, c wasn't run
    assert held(store) == [("a", "x", 5), ("a", "y", 3)]
    assert held(store, 0) == [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)]


def test_what_breaks_off_before_its_manifest_is_not_read(made, monkeypatch):
    store, findings, runs = made
    store.commit(findings([("a", "x", 1)]), runs([("a", "x")]))
    with monkeypatch.context() as m:
        def broken(*_):
            raise OSError("lost")

        m.setattr(store, "_publish", broken)
        with pytest.raises(OSError):
            store.commit(findings([("a", "x", 2)]), runs([("a", "x")]))
    assert held(store) == [("a", "x", 1)]
    store.commit(findings([("a", "x", 3)]), runs([("a", "x")]))
    assert held(store) == [("a", "x", 3)]
    assert len(store.vacuum()) == 1, "what no manifest names goes"
    assert held(store) == [("a", "x", 3)]


def test_two_writers_can_not_take_one_number(made, monkeypatch):
    store, findings, runs = made
    store.commit(findings([("a", "x", 1)]), runs([("a", "x")]))
    late = FindingsStore(store.spark, store.path)
    monkeypatch.setattr(late, "_manifests", lambda: [0])
    store.commit(findings([("a", "x", 2)]), runs([("a", "x")]))
    with pytest.raises(Conflict):
        late.commit(findings([("a", "x", 3)]), runs([("a", "x")]))
    assert held(store) == [("a", "x", 2)]


def test_batches_sent_again_compaction_and_removal(made, tmp_path):
    store, findings, runs = made
    for k in range(3):
        assert store.commit(findings([("a", "x", k), (f"f{k}", "x", k)]), runs([("a", "x"), (f"f{k}", "x")]), batch=f"s-{k}") == k
    assert store.commit(findings([("a", "x", 99)]), runs([("a", "x")]), batch="s-1") == 1
    expect = [("a", "x", 2), ("f0", "x", 0), ("f1", "x", 1), ("f2", "x", 2)]
    assert held(store) == expect
    assert store.compact() == 3 and held(store) == expect and held(store, 0) == [("a", "x", 0), ("f0", "x", 0)]
    assert len(store.commits()) == 1
    store.commit(findings([("a", "x", 99)]), runs([("a", "x")]), batch="s-2")
    assert held(store) == expect, "a batch is known after compaction too"
    assert len(store.vacuum()) == 3 and held(store) == expect
    assert len(list((tmp_path / "store" / "commits").iterdir())) == 1 and len(list((tmp_path / "store" / "manifests").glob("[0-9]*.json"))) == 1


def test_upsert_passes_over_a_version_that_is_not_finished(spark, tmp_path):
    target = str(tmp_path / "cases")
    write = cases.upsert(target, ["k"], "v", buckets=2)
    write(spark.createDataFrame([(1, 1), (2, 1)], "k long, v long"), 0)
    write(spark.createDataFrame([(1, 2)], "k long, v long"), 1)
    for bucket in (tmp_path / "cases").iterdir():
        (bucket / "v7").mkdir()  # a write that broke off
    assert {tuple(r) for r in cases.upserted(spark, target).collect()} == {(1, 2), (2, 1)}
