"""Functions for what the JVM has no expression for, over whole Arrow batches, and their registration for SQL.

None is evaluated on rows that a cheaper test settles (see ``operators.compare``).
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from . import passages, qualifiers, quantity

_REASON = "struct<role: string, reason: string, start: int, end: int, text: string>"
_QUANTITY = "struct<dimension: string, numerator: string, denominator: string, start: int, end: int, text: string, unit: string>"
_MARKER = "struct<family: string, value: string, start: int, end: int, text: string>"
QUANTITY_REVIEW = f"struct<state: string, candidate: array<{_QUANTITY}>, reference: array<{_QUANTITY}>, reasons: array<{_REASON}>>"
QUALIFIER_REVIEW = f"struct<state: string, candidate: array<{_MARKER}>, reference: array<{_MARKER}>, reasons: array<{_REASON}>>"


def _quantity_review(candidate, reference, language):
    return quantity.compare(candidate or "", reference or "", language or "")


def _qualifier_review(candidate, reference, language):
    return qualifiers.compare(candidate or "", reference or "", language or "")


def _token_values(text):
    return [t.value for t in qualifiers.tokenise(text or "")]


def _nfc(text):
    return None if text is None else unicodedata.normalize("NFC", text)


def _utf16_offset(text, offset):
    """A code point offset as UTF-16 code units."""
    return None if text is None or offset is None else offset + sum(c > "￿" for c in text[:offset])


#: Keys of clock and runtime fields, which semantic fingerprints leave out.
VOLATILE = frozenset(
    "generatedAt createdAt retrievedAt bibliographicRetrievedAt inferredAt savedAt elapsedMS startedAt completedAt runManifest runHistory".split()
)


def number(x: float) -> str:
    """A finite number in JavaScript's form: the fewest digits, an exponent from 1e21 and below 1e-6."""
    if not math.isfinite(x):
        raise ValueError("a number that isn't finite has no canonical form")
    if x == 0:
        return "0"
    _, said, power = Decimal(repr(x)).normalize().as_tuple()
    digits, point = "".join(map(str, said)), len(said) + power
    if len(digits) <= point <= 21:
        out = digits.ljust(point, "0")
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + ("." if digits[1:] else "") + digits[1:] + f"e{point - 1:+d}"
    return "-" * (x < 0) + out


def canonical(value, semantic: bool = False, depth: int = 0) -> str:
    """JSON with keys sorted by UTF-16 units and no spaces; semantic: without volatile keys. Non-finite numbers are refused."""
    if depth > 60:
        raise ValueError("nested too deeply")
    text = lambda x: json.dumps(x, ensure_ascii=False, allow_nan=False)
    if isinstance(value, dict):
        keys = sorted((k for k in value if not (semantic and k in VOLATILE)), key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{text(k)}:{canonical(value[k], semantic, depth + 1)}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(v, semantic, depth + 1) for v in value) + "]"
    return number(value) if isinstance(value, float) else text(value)


def _canonical_json(text):
    try:
        return None if text is None else canonical(json.loads(text))
    except (ValueError, RecursionError):
        return None


def _semantic_digest(text):
    try:
        return None if text is None else hashlib.sha256(canonical(json.loads(text), True).encode()).hexdigest()
    except (ValueError, RecursionError):
        return None


BODY = "struct<text: string, notes: array<string>, prefix_removed: boolean, anchors_removed: int, kept_as_sent: boolean>"

_FUNCTIONS = {
    "quantity_review": (_quantity_review, QUANTITY_REVIEW, 3),
    "qualifier_review": (_qualifier_review, QUALIFIER_REVIEW, 3),
    "token_values": (_token_values, "array<string>", 1),
    "nfc": (_nfc, "string", 1),
    "utf16_offset": (_utf16_offset, "int", 2),
    "canonical_json": (_canonical_json, "string", 1),
    "semantic_digest": (_semantic_digest, "string", 1),
    "decode_entities": (lambda text: None if text is None else passages.decoded(text), "string", 1),
    "numbered_body": (lambda html, group, ordinal: None if html is None else passages.read_passage(html, group, ordinal), BODY, 3),
}


def _over_batches(f, returns: str, n: int):
    """``f`` on the columns of a batch, with equal arguments evaluated once a batch."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(returns))

    def run(*columns):
        import pyarrow as pa

        known, out = {}, []
        for row in zip(*[c.to_pylist() for c in columns], strict=True):
            if row not in known:
                known[row] = f(*row)
            out.append(known[row])
        return pa.array(out, kind)

    # a signature of n columns, whose annotations make Spark hand over whole batches
    one = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[n]
    return one


def __getattr__(name: str):
    """The Arrow function of that name; made on the driver only, as workers import this module too."""
    if name not in _FUNCTIONS:
        raise AttributeError(name)
    import pyarrow as pa

    f, returns, n = _FUNCTIONS[name]
    batched = _over_batches(f, returns, n)
    batched.__annotations__ = dict.fromkeys(("a", "b", "c")[:n], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(batched, returns)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL, under their names here."""
    ship(spark)
    for name in _FUNCTIONS:
        spark.udf.register(name, __getattr__(name))
