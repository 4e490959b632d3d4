from __future__ import annotations

import json

import pytest

from tallymark.sources import landed


def answer(*texts):
    return json.dumps([{"ayah_number": n, "translation_text": t} for n, t in texts])


@pytest.fixture
def store(spark, tmp_path):
    landed.register(spark)
    path = str(tmp_path / "answers")
    rows = [(1, g, answer((1, f"a{g}"), (2, f"b{g}"))) for g in range(1, 21)] + [(2, 1, answer((1, "x"))), (2, 2, "{}"), (2, 3, "[]"), (2, 4, "nope"), (2, 5, answer((1, "x"), (1, "y"))), (2, 6, answer((0, "x"))), (2, 7, answer((1, " "))), (2, 8, None)]
    schema = "book long, grp long, answer string"
    spark.createDataFrame(rows, schema).write.format(landed.FORMAT).mode("append").save(path)
    spark.createDataFrame([(1, 3, answer((1, "new")))], schema).write.format(landed.FORMAT).mode("append").save(path)
    return path


def test_answers_and_errors(spark, store):
    rows = spark.read.format(landed.FORMAT).load(store).collect()
    texts = {(r["drop"], r["book"], r["grp"], r["ord"]): r["html"] for r in rows if r["error"] is None}
    assert texts == {(0, 1, g, n): f"{'ab'[n - 1]}{g}" for g in range(1, 21) for n in (1, 2)} | {(0, 2, 1, 1): "x", (1, 1, 3, 1): "new"}
    assert {r["grp"]: r["error"] for r in rows if r["error"]} == {
        2: "no_texts", 3: "no_texts", 4: "not_json", 5: "invalid_identifier_or_text", 6: "invalid_identifier_or_text", 7: "invalid_identifier_or_text", 8: "not_json",
    }
    last = landed.newest(spark.read.format(landed.FORMAT).load(store)).where("book = 1 AND grp = 3").collect()
    assert [r["html"] for r in last] == ["new"]
    assert [tuple(r)[:3] for r in landed.changed(spark.read.format(landed.FORMAT).load(store)).collect()] == [(1, 3, 1)]


def test_filters_are_taken_and_other_files_stay_shut(spark, store, tmp_path):
    own = landed.pushing(spark)
    assert own.conf.get("spark.sql.python.filterPushdown.enabled") == "true" != spark.conf.get("spark.sql.python.filterPushdown.enabled")
    # a file that isn't needed is gone
    for f in (tmp_path / "answers" / "drop=0").glob("book=1-group=7-*"):
        f.unlink()
    read = own.read.format(landed.PUSHING).load(store).where("book = 1 AND grp >= 9 AND grp IN (9, 11, 30) AND ord > 1")
    assert {(r["grp"], r["ord"]) for r in read.collect()} == {(9, 2), (11, 2)}
    taken = landed._PushingReader(store)
    left = list(taken.pushFilters([landed.EqualTo(("book",), 2), landed.LessThan(("grp",), 3), landed.EqualTo(("html",), "x")]))
    assert [f.attribute for f in left] == [("html",)]
    assert [(f["book"], f["grp"]) for p in taken.partitions() for f in p.files] == [(2, 1), (2, 2)]
    with pytest.raises(Exception, match="group=7"):
        spark.read.format(landed.FORMAT).load(store).where("grp = 9").collect()


def test_unfinished_drops_are_not_read(spark, store, tmp_path):
    folder = tmp_path / "answers" / "drop=2"
    folder.mkdir()
    (folder / "book=9-group=9-x.json").write_text(answer((1, "lost")))
    (folder / "_manifest.unfinished").write_text("[]")
    assert spark.read.format(landed.FORMAT).load(store).where("drop > 1").count() == 0
    spark.createDataFrame([(3, 1, answer((1, "later")))], "book long, grp long, answer string").write.format(landed.FORMAT).mode("append").save(store)
    assert [tuple(r)[:5] for r in spark.read.format(landed.FORMAT).load(store).where("drop > 1").collect()] == [(3, 3, 1, 1, "later")]


def test_a_stream_goes_on_at_its_offset(spark, store, tmp_path):
    seen = []

    def run():
        def write(batch, epoch):
            seen.append(sorted({r["drop"] for r in batch.collect()}))

        stream = spark.readStream.format(landed.FORMAT).load(store).writeStream.option("checkpointLocation", str(tmp_path / "log"))
        stream.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    run()
    assert [d for b in seen for d in b] == [0, 1]
    spark.createDataFrame([(3, 1, answer((1, "later")))], "book long, grp long, answer string").write.format(landed.FORMAT).mode("append").save(store)
    run()
    assert [d for b in seen for d in b] == [0, 1, 2], "what was read before isn't read again"
