from __future__ import annotations

import random

import pytest

from tallymark.sources import delimited, files, pieces
from tallymark.sources.matrix import Malformed

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(params=[120, 1 << 20])
def sized(spark, request):
    """Ranges of so many bytes."""
    before = {k: spark.conf.get(k) for k in KEYS}
    spark.conf.set(KEYS[0], str(request.param))
    spark.conf.set(KEYS[1], "1")
    spark.ranges = request.param
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def made(rng):
    """A file of odd cells; some break a rule."""
    cells = ["a", "", "12", "long " * 6, 'say ""so""', "x\ny", "x\r\ny", "\n\n", ",", "é😀", '""', "\r"]
    end = rng.choice(["\n", "\r\n", "\r"])
    out = []
    for _ in range(rng.randint(0, 12)):
        record = []
        for _ in range(3):
            c = rng.choice(cells)
            record.append(f'"{c}"' if set(c) & set('",\n\r') or rng.random() < 0.2 else c)
        out.append(",".join(record))
    text = end.join(out) + (end if rng.random() < 0.7 else "")
    fault = rng.random()
    if text and fault < 0.45:
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(['"', 'q"q', '"x']) + text[at:]
    return text


def one_task(text):
    try:
        return delimited.parse(text, ","), None
    except Malformed as e:
        return None, (e.code, int(e.detail))


def test_records_and_faults_equal_the_one_task_parser(sized, tmp_path):
    rng = random.Random(17)
    texts = {f"f{k}.csv": made(rng) for k in range(30 if sized.ranges < 1000 else 120)}
    texts |= {"bom.csv": "﻿a,b\n1,2\n", "blank.csv": "\n\n", "cr.csv": "a\rb\r\rc", "open.csv": 'a,"b\n' + "c\n" * 40, "wide.csv": '"' + "w\n" * 60 + '",1\nz,2'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.csv").write_bytes(b"a,b\n" * 9 + b"\xff\xfe,1\n")
    read = pieces.read_records(sized, str(tmp_path), ",")
    got: dict = {}
    for r in read.records.collect():
        got.setdefault(r["file_id"].rsplit("/", 1)[1], []).append((r["record"], r["cells"]))
    faults = {r["file_id"].rsplit("/", 1)[1]: (r["error"], r["record"]) for r in read.faults.collect()}
    assert faults.pop("bad.csv") == ("not_utf8", None)
    kinds = set()
    for name, text in texts.items():
        records, fault = one_task(text)
        if not text:
            assert faults[name] == ("empty_file", None)
        elif fault:
            kinds.add(fault[0])
            assert faults[name] == fault and name not in got, (name, text)
        else:
            assert name not in faults, (name, text, faults[name])
            assert sorted(got.get(name, [])) == list(enumerate(records, 1)), (name, text)
    assert sized.ranges < 1000 or kinds == {"quote_in_bare_cell", "text_after_quote", "unclosed_quote"}


def test_rows_equal_those_of_whole_files(sized, tmp_path):
    rng = random.Random(5)
    head = "chapter,verse,translation\n"

    def body(n, sign=","):
        return "".join(f'{1 + k // 9}{sign}{1 + k % 9}{sign}"text{sign} {rng.randint(0, 99)}\nmore"\n' for k in range(n))

    texts = {
        "plain.csv": head + body(30), "blank.csv": "\n \n" + head + body(4) + "\n,,\n" + body(3), "tabs.tsv": head.replace(",", "\t") + body(9, "\t"), "semi.csv": head.replace(",", ";") + body(9, ";"),
        "bare.csv": "1,1,one\n1,2,two\n2,1-3,three\n", "ids.csv": "id,text\n" + "".join(f"{g}:{o},t\n" for g in range(1, 4) for o in range(1, 5)),
        "ragged.csv": head + body(8) + "1,2\n" + body(5) + "1\n", "ragged_and_open.csv": head + "1,2\n" + body(3) + '1,2,"x\n', "conflict.csv": "id,chapter,text\n1:1,1,a\n1:2,2,b\n", "twice.csv": "text,translation,verse,chapter\na,b,1,1\n",
        "unknown.csv": "p,q,r\nx,y,z\n", "only_head.csv": head, "nothing.csv": " \n\n", "none.csv": "", "notes.txt": head + body(2),
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    columns = ["error", "warnings", "input_index", "row_number", "group_raw", "ordinal_raw", "text", "raw_type"]

    def told(df):
        return sorted(((r["file_id"].rsplit("/", 1)[1], *[r[c] for c in columns]) for r in df.collect()), key=repr)

    expect = told(files.read_files(sized, str(tmp_path)))
    assert told(pieces.read_rows(sized, str(tmp_path), strict=True)) == expect
    assert {r[1] for r in expect} == {None, "ragged_row", "unclosed_quote", "identifier_conflict", "ambiguous_header", "columns_not_recognised", "no_data_rows", "empty_file"}


def test_limits_and_mappings(spark, tmp_path):
    (tmp_path / "many.csv").write_text("chapter,verse,translation\n" + "1,1,x\n" * 20_001)
    (tmp_path / "named.csv").write_text("a,b,c\n1,2,x\n")
    out = pieces.read_rows(spark, str(tmp_path / "many.csv"))
    assert out.count() == 20_001 and out.selectExpr("max(input_index) = 20000 AND count(DISTINCT input_index) = 20001 AS ok").first()["ok"]
    assert [r["error"] for r in pieces.read_rows(spark, str(tmp_path / "many.csv"), strict=True).collect()] == ["too_many_rows"]
    mapping = {"group": "a", "ordinal": 1, "text": "c"}
    assert [(r["group_raw"], r["ordinal_raw"], r["text"]) for r in pieces.read_rows(spark, str(tmp_path / "named.csv"), mapping).collect()] == [("1", "2", "x")]


def test_a_folder_of_parts_is_read_as_one_file(sized, tmp_path):
    """Parts that are cut between lines, also within a cell: records, numbers and faults are those of all of them in a row."""
    texts = {"whole": 'a,"b\nc"\n1,"' + "long\n" * 60 + '"\n' + "x,y\n" * 30, "broken": "a,b\n" * 40 + 'c,d"\n' + 'e,"f" \n' * 9, "open": "a;b\n" * 20 + 'c;"d\n' * 3, "none": ""}
    for name, text in texts.items():
        lines = text.split("\n")[:-1]
        (tmp_path / name).mkdir()
        for k in range(7):
            # the last parts' numbers have more digits, and some parts are empty
            part = lines[k * len(lines) // 6 : (k + 1) * len(lines) // 6]
            (tmp_path / name / f"part-{99_997 + k:05}-0a.c000.txt").write_text("".join(t + "\n" for t in part))
    for delimiter in (",", None):
        read = pieces.read_records(sized, str(tmp_path), delimiter, parts=True)
        got: dict = {}
        for r in read.records.collect():
            got.setdefault(r.file_id.rsplit("/", 1)[1], []).append((r.record, r.cells))
        faults = {r.file_id.rsplit("/", 1)[1]: (r.error, r.record) for r in read.faults.collect()}
        expect = list(enumerate(delimited.parse(texts["whole"], ","), 1))
        assert {k: sorted(v) for k, v in got.items()} == {"whole": expect}
        assert faults == {"broken": ("quote_in_bare_cell", 41), "open": ("quote_in_bare_cell" if delimiter else "text_after_quote", 21), "none": ("empty_file", None)}
    (tmp_path / "whole" / "part-99998-0b.c000.txt").write_text("again\n")
    with pytest.raises(ValueError, match="two parts"):
        pieces.read_records(sized, str(tmp_path), ",", parts=True)


def test_a_language_is_written_in_parts(spark, tmp_path, monkeypatch):
    """All documents of a language went through one task, however many they were."""
    from tallymark.plans import file_queries as q

    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some \"text\"\n', repeat('x', 50)) AS text", "CASE WHEN id < 300 THEN 'en' ELSE 'de' END AS lang")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(q, "PART_BYTES", 2_000)
    made = []
    monkeypatch.setattr(q, "new_path", lambda s, name: made.append(str(tmp_path / name)) or made[0])
    assert {tuple(r) for r in q.delimited_faults(spark, str(tmp_path)).collect()} == {("en", "quote_in_bare_cell", 97), ("de", "text_after_quote", 88)}
    import glob

    assert len(glob.glob(f"{made[0]}/lang=en/part-*")) >= 8
