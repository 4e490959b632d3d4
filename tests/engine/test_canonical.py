from __future__ import annotations

import hashlib
import json
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymark.functions import canonical, udfs

#: Numbers and how JavaScript writes them.
NUMBERS = {
    0.0: "0", -0.0: "0", 1.0: "1", -1.5: "-1.5", 0.1: "0.1", 1e-6: "0.000001", 1e-7: "1e-7", -1.5e-9: "-1.5e-9", 123456.789: "123456.789", 1e15: "1000000000000000", 1e20: "100000000000000000000",
    1e21: "1e+21", 1.2345e22: "1.2345e+22", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 0.30000000000000004: "0.30000000000000004", 123456789012345680000.0: "123456789012345680000",
    2.5e-5: "0.000025", 1 / 3: "0.3333333333333333", 2e-3: "0.002", 9007199254740993.0: "9007199254740992", 1.0e23: "1e+23", 2.2250738585072014e-308: "2.2250738585072014e-308",
}


def said(spark, rows, schema, semantic=False):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, v {schema}")
    return [r["said"] for r in canonical.with_canonical(df, "v", "said", semantic).orderBy("k").collect()]


def test_numbers_are_written_as_in_javascript(spark):
    assert said(spark, list(NUMBERS), "double") == list(NUMBERS.values())
    assert [udfs.number(x) for x in NUMBERS] == list(NUMBERS.values())
    rng = random.Random(3)
    some = [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)) if abs(x) < float("inf")]
    some += [round(rng.uniform(-1e6, 1e6), rng.randint(0, 9)) for _ in range(2000)] + [rng.uniform(0, 1) * 10.0 ** rng.randint(-12, 24) for _ in range(2000)]
    assert said(spark, some, "double") == [udfs.number(x) for x in some]


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf")])
def test_numbers_that_are_not_finite_are_refused(spark, bad):
    with pytest.raises(PySparkException):
        said(spark, [bad], "double")
    with pytest.raises(ValueError):
        udfs.number(bad)


def test_texts_are_escaped(spark):
    texts = ["", 'a"b\\c', "".join(map(chr, range(33))), "é \x7f😀", "\\n", None]
    want = [json.dumps(t, ensure_ascii=False) if t is not None else "null" for t in texts]
    assert said(spark, texts, "string") == want


def test_nested_values_equal_the_function_on_texts(spark):
    schema = "struct<z: int, a: array<struct<y: double, b: string>>, m: map<string, map<string, boolean>>, savedAt: string, n: array<array<bigint>>, s: struct<createdAt: string, x: date>>"
    import datetime

    day = datetime.date(2024, 2, 29)
    rows = [
        (1, [(1e-7, "q"), None, (None, None)], {"￮": {"b": True, "a": None}, "😀": None, "": {}, "savedAt": {"x": False}}, "now", [[1, None], [], None], ("then", day)),
        (None, [], {}, None, None, (None, None)),
        (2, None, None, "now", [[2**60]], None),
        None,
    ]

    def plain(r):
        if r is None:
            return None
        return {"z": r[0], "a": None if r[1] is None else [x and {"y": x[0], "b": x[1]} for x in r[1]], "m": r[2], "savedAt": r[3], "n": r[4], "s": r[5] and {"createdAt": r[5][0], "x": r[5][1] and str(r[5][1])}}

    for semantic in (False, True):
        want = [udfs.canonical(plain(r), semantic) for r in rows]
        assert said(spark, rows, schema, semantic) == want
    assert "savedAt" not in want[0] and "createdAt" not in want[0]
    # the astral key comes before the last of the basic plane, by UTF-16 units
    assert want[0].index("😀") < want[0].index("￮")


def test_digest_names_and_refusals(spark):
    df = spark.createDataFrame([(1, "x")], "`a.b` int, said string").withColumn("v", F.struct(F.lit(2).alias("b"), F.lit("é").alias("a.c")))
    row = canonical.with_canonical(df, "v", "json", digest="sha").first()
    assert row["json"] == '{"a.c":"é","b":2}' and row["sha"] == hashlib.sha256(row["json"].encode()).hexdigest()
    assert canonical.with_canonical(df, "a.b", "json").first()["json"] == "1"
    assert canonical.with_canonical(df.limit(0), "v", "json").isEmpty()
    for bad in (F.lit(b"x"), F.struct(F.lit(1).alias("a"), F.lit(2).alias("a")), F.create_map(F.lit(1), F.lit(2))):
        with pytest.raises(TypeError):
            canonical.with_canonical(df.withColumn("w", bad), "w", "json")
