"""Secret scans that link the parts of a credential.

Strong candidates (an assigned secret, an access identifier, a long hex run) stand for
themselves. Weak candidates - a bare token, an account name, an endpoint - are common in
harmless text, so they are reported only if complementary parts lie in the same scope: an
interval join of parts and scopes, made by one sweep over both. A credential needs a
secret, so nothing is reported for an account and an endpoint alone:

* a random-looking token (digits and both cases) with an identifier or an endpoint;
* another token of letters and digits only with an identifier and an endpoint;
* an account with a secret, be it assigned, weak or hex;
* an endpoint with an assigned or weak secret, or with a hex run and an identifier.

A scope is a run of lines without a blank line. Every pattern takes time linear in the
text, whatever it holds: runs are entered at their start only. Nulls and empty texts have
no spans. Texts of any length are scanned whole; repeated rows give repeated rows; an
empty table gives none; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from .common import ready, sliced, table

# The base kinds, in the order that spans of one start take.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Weak candidates, reported only with complementary parts.
WEAK = ("weak_secret", "weak_account", "weak_endpoint")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ACCOUNT = re.compile(
    r"""(?<![a-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@+/_.-]{3,}+""",
    re.A | re.I,
)
#: A scheme is looked for at the start of a run of its characters only.
_SCHEME = re.compile(r"""(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]++)""", re.A)
_HOST = re.compile(r"""(?<![A-Za-z0-9])(?:host|server|endpoint)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9.:_-]{4,}+""", re.A | re.I)
_BLANK = re.compile(r"\n[ \t\r]*+\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the strong candidates, ordered by start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS) or not text.isascii():
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2])))


def _random_looking(token: str) -> bool:
    """Digits and both cases mixed, and few repeats: not a word, a path or a rule of dashes."""
    return any(map(str.isdigit, token)) and any(map(str.isupper, token)) and any(map(str.islower, token)) and _varied(token)


def _varied(token: str) -> bool:
    return len(set(token)) * 2 >= min(len(token), 20)


def _plain_token(token: str) -> bool:
    """Letters and digits mixed, as in a UUID or a key of one case."""
    return any(map(str.isdigit, token)) and any(map(str.isalpha, token)) and _varied(token)


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates that overlap no strong one nor each other; of equal starts secrets come first.

    A token that doesn't look random is a weak_secret too, told apart by ``_random_looking``.
    """
    found: list[Span] = []
    if any(map(str.isdigit, text)):
        found += [(*m.span(), "weak_secret") for m in _TOKEN.finditer(text) if _plain_token(m[0])]
    if ":" in text or "=" in text:
        found += [(*m.span(), "weak_account") for m in _ACCOUNT.finditer(text)]
        found += [(*m.span(), "weak_endpoint") for m in _HOST.finditer(text)]
    if "://" in text:
        found += [(*m.span(1), "weak_endpoint") for m in _SCHEME.finditer(text)]
    taken = sorted(strong)
    out: list[Span] = []
    end = -1
    starts = [s[0] for s in taken]
    ends = []
    for s in taken:
        end = max(end, s[1])
        ends.append(end)
    last = -1
    for s in sorted(found, key=lambda s: (s[0], WEAK.index(s[2]))):
        k = bisect_right(starts, s[1] - 1) - 1
        if s[0] >= last and not (k >= 0 and ends[k] > s[0]):
            out.append(s)
            last = s[1]
    return out


def confirmed(part: str, there: set[str]) -> bool:
    """Whether a weak part (a kind, or "token" for one that looks less random) has its complements among the parts of a scope."""
    identifier = bool(there & {"access", "weak_account"})
    secret = bool(there & {"assign", "weak_secret"})
    if part == "weak_secret":
        return identifier or "weak_endpoint" in there
    if part == "token":
        return identifier and "weak_endpoint" in there
    # a token that its own scope confirms is a secret
    secret |= "token" in there and identifier and "weak_endpoint" in there
    if part == "weak_account":
        return secret or "hex" in there
    return secret or ("hex" in there and identifier)


def linked(text: str, strong: list[Span], weak: list[Span]) -> list[Span]:
    """Those of ``weak`` whose scope holds complementary parts; parts and scopes are swept in their order."""
    if not weak:
        return []
    blanks = [m.end() for m in _BLANK.finditer(text)]
    named = [(s, "token" if s[2] == "weak_secret" and not _random_looking(text[s[0] : s[1]]) else s[2]) for s in sorted([*strong, *weak])]
    kept: list[Span] = []
    for _, parts in groupby(named, key=lambda p: bisect_right(blanks, p[0][0])):
        inside = list(parts)
        there = {kind for _, kind in inside}
        kept += [s for s, kind in inside if s[2] in WEAK and confirmed(kind, there)]
    return kept


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the linked weak candidates, of one text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = linked(text, base, weak_spans(text, base))
    kinds = (*BASE, *WEAK)
    return base, sorted([*base, *more], key=lambda s: (s[0], kinds.index(s[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans): spans is an array of (start, end, kind, text)."""
    ready(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("text", pa.string())]))
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            spans = [
                [{"start": a, "end": b, "kind": k, "text": t[a:b]} for a, b, k in scan(t)[1]] for t in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<start: long, end: long, kind: string, text: string>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of ``find_secrets`` over every document."""
    from pyspark.sql import functions as F

    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
