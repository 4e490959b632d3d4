"""Canonical JSON of typed columns in the JVM: sorted keys, no spaces, numbers and escapes as in JavaScript, and digests of it.

The form follows the schema, so it is one expression of built-in functions: no Python sees
a row. ``functions.udfs.canonical_json`` does the same for JSON texts of unknown form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .udfs import VOLATILE

#: Levels that a value may have, and short escapes; other control characters are written by number.
DEEPEST = 60
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_ESCAPES = {chr(k): _SHORT.get(chr(k), f"\\u{k:04x}") for k in range(32)}
_LEAST_NORMAL = 2.2250738585072014e-308


def units(text: Column) -> Column:
    """A key that sorts texts by UTF-16 code units, as JavaScript does; bytes of UTF-8 sort astral characters last."""
    return F.hex(F.encode(text, "UTF-16BE"))


def string(text: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controlled = out
    for raw, escaped in _ESCAPES.items():
        controlled = F.replace(controlled, F.lit(raw), F.lit(escaped))
    out = F.when(text.rlike(r"[\x00-\x1f]"), controlled).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def number(value: Column) -> Column:
    """A double as JavaScript writes it: the fewest digits that read back, an exponent from 1e21 and below 1e-6. Others are an error."""
    plain = F.abs(value)

    def least(places) -> Column:
        tries = [F.when(F.format_string(f"%.{p}e", plain).try_cast("double") == plain, F.format_string(f"%.{p}e", plain)) for p in places]
        return F.coalesce(*tries)

    # a normal double with at most 15 digits reads back from 15; numbers below those need the search from one digit on
    said = F.when(plain < _LEAST_NORMAL, least(range(17))).otherwise(least((14, 15, 16)))
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(said, "e", 1), r"\.", ""), "0+$", "")
    point = F.substring_index(said, "e", -1).cast("int") + 1  # digits before the point
    count = F.length(digits)
    zeros = lambda n: F.repeat(F.lit("0"), n)
    head, tail = F.substring(digits, 1, 1), F.expr("''")
    tail = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count - 1))).otherwise(tail)
    power = F.concat(F.when(point > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(point - 1).cast("string"))
    shown = (
        F.when(point.between(count, 21), F.concat(digits, zeros(point - count)))
        .when(point.between(1, 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, count)))
        .when(point.between(-5, 0), F.concat(F.lit("0."), zeros(-point), digits)).otherwise(F.concat(head, tail, power))
    )
    # the usual cases without a search: whole numbers that a long holds, and up to 15 digits, six of them behind the point
    whole = (plain < 1e15) & (value == F.floor(value))
    brief = F.when(plain < 1e9, value).cast("decimal(18,6)")
    brief = F.when(brief.cast("double") == value, F.rtrim(brief.cast("string"), F.lit("0")))
    # whole numbers that a long still holds are rounded as such: the formatter rounds them from digits that it rounded before
    exact = F.when((plain >= 1e15) & (plain < 9.2e18) & (value == F.floor(value)), plain).cast("long")

    def nearest(places: int) -> Column:
        unit = F.rpad(F.lit("1"), F.greatest(F.length(exact.cast("string")) - places + 1, F.lit(1)), "0").cast("long")
        near = exact + F.call_function("div", unit, F.lit(2))
        near = near - near % unit
        return F.when(near.cast("double") == plain, near.cast("string"))

    large = F.coalesce(*map(nearest, (15, 16, 17)))
    large = F.concat(F.when(value < 0, "-").otherwise(""), large)
    finite = F.when(whole, value.cast("long").cast("string")).otherwise(F.coalesce(brief, large, F.concat(F.when(value < 0, "-").otherwise(""), shown)))
    refused = F.isnan(value) | (plain == float("inf"))
    return F.when(refused, F.raise_error(F.lit("a number that isn't finite has no canonical form"))).otherwise(finite)


def encoded(value: Column, kind: t.DataType, semantic: bool = False, depth: int = 0) -> Column:
    """The canonical JSON of a value of a type; ``semantic``: without volatile keys at any level. Null is ``null``.

    Structs and maps with text keys are objects, arrays are arrays, dates and times are
    texts, decimals are doubles; whole numbers are written in full, beyond 2^53 too. Other
    types, equal names in a struct and more than 60 levels are refused when the plan is made.
    """
    if depth > DEEPEST:
        raise ValueError("nested too deeply")
    below = lambda v, k: encoded(v, k, semantic, depth + 1)
    if isinstance(kind, t.StructType):
        names = sorted(kind.names, key=lambda n: n.encode("utf-16-be"))
        if len(set(names)) < len(names):
            raise TypeError("fields of one name")
        parts = [F.concat(string(F.lit(n)), F.lit(":"), below(value.getField(n), kind[n].dataType)) for n in names if not (semantic and n in VOLATILE)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        # concat_ws of no columns is empty, and a null struct has null fields only
        out = F.when(value.isNotNull(), out)
    elif isinstance(kind, t.MapType) and isinstance(kind.keyType, t.StringType):
        entries = F.map_entries(value)
        if semantic:
            entries = F.filter(entries, lambda e: ~e["key"].isin(*sorted(VOLATILE)))
        entries = F.array_sort(F.transform(entries, lambda e: F.struct(units(e["key"]).alias("at"), F.concat(string(e["key"]), F.lit(":"), below(e["value"], kind.valueType)).alias("said"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["said"]), ","), F.lit("}"))
    elif isinstance(kind, t.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: below(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, t.StringType):
        out = string(value)
    elif isinstance(kind, t.BooleanType | t.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, t.FractionalType):
        out = number(value.cast("double"))
    elif isinstance(kind, t.DateType | t.TimestampType | t.TimestampNTZType):
        out = string(value.cast("string"))
    elif isinstance(kind, t.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def with_canonical(rows: DataFrame, column: str, name: str, semantic: bool = False, digest: str | None = None) -> DataFrame:
    """``rows`` with the canonical JSON of a column, and with its SHA-256 under ``digest`` if named."""
    out = rows.withColumn(name, encoded(F.col(f"`{column}`"), rows.schema[column].dataType, semantic))
    return out if digest is None else out.withColumn(digest, F.sha2(F.col(f"`{name}`"), 256))
