"""English qualifiers in a text: quantifiers, modals, permissions and order words.

Markers of one family are taken as equal where the table says so. Uses whose scope a list
of words cannot settle are reasons to abstain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import regex

from . import spots
from .quantity import ABOUT, NONE, Token, token_value
from .text import NEGATIONS_EN

# Families and the markers that each of their values has.
FAMILIES = {
    "quantifier": {"universal": "all every each", "some": "some"},
    "modality": {"obligation": "must required mandatory", "may": "may"},
    "permission": {"allowed": "allowed permitted authorized", "forbidden": "forbidden prohibited disallowed"},
    "order": {"before": "before", "after": "after"},
}
MARKERS = {w: (family, value) for family, values in FAMILIES.items() for value, words in values.items() for w in words.split()}
_MARKED = frozenset(MARKERS)
_NOT = frozenset(NEGATIONS_EN)
_ASCII_TOKEN = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)*")
_TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:['’][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*")


# negations by their Latin letters alone, and the end of the others
_PLAIN_NOT, _SHORT_NOT = frozenset(w for w in NEGATIONS_EN if "'" not in w), "n't"
#: A marker is read with one token on each side.
_AROUND = 4


def tokenise(text: str, begin: int = 0, end: int | None = None) -> list[Token]:
    pattern = _ASCII_TOKEN if text.isascii() else _TOKEN
    return [Token(t := m[0], token_value(t), *m.span()) for m in pattern.finditer(text, begin, len(text) if end is None else end)]


def _first_negation(text: str, low: spots.Lowered) -> int:
    """Where the first token that negates begins, or the end of the text."""
    places = spots.words_at(low, _PLAIN_NOT) + spots.every(low.low, _SHORT_NOT)
    for at in sorted(places):
        for bounds in spots.pieces(text, [at], 1):
            for t in tokenise(text, *bounds):
                if t.start <= at < t.end and t.value in _NOT:
                    return t.start
    return len(text)


def _stretches(text: str) -> tuple[list[list[Token]], int]:
    """The text's tokens around its markers, in stretches, and where its first negation begins."""
    low = spots.lowered(text)
    if low is not None:
        places = spots.words_at(low, _MARKED)
        if not places:
            return [], 0
        bounds = spots.pieces(text, places, _AROUND)
        out = [tokenise(text, *b) for b in bounds]
        # stretches without a letter or digit hold no token
        lone = lambda tokens, b: (b[0] and tokens[0].value in MARKERS) or (b[1] < len(text) and tokens[-1].value in MARKERS)
        if not any(lone(tokens, b) for tokens, b in zip(out, bounds, strict=True) if tokens):
            return out, _first_negation(text, low)
    tokens = tokenise(text)
    return [tokens], next((t.start for t in tokens if t.value in _NOT), len(text))


def _ambiguities(tokens: list[Token], i: int, family: str, value: str, negated: int) -> Iterator[str]:
    """Reasons why the marker at i is not read; "not" before a permission turns it instead. ``negated``: where the text's first negation begins."""
    token = tokens[i]
    before = tokens[i - 1] if i else NONE
    after = tokens[i + 1] if i + 1 < len(tokens) else NONE
    turned = before.value == "not" and (family, value) == ("permission", "allowed")
    tests = (
        ("capitalized_May_month_or_modality_ambiguous", token.text == "May"),
        ("epistemic_modal_construction_not_supported", token.value in ("must", "may") and after.value == "have"),
        ("following_negation_scope_not_supported", after.value in _NOT),
        ("quantifier_exception_scope_not_supported", family == "quantifier" and after.value in ("but", "except")),
        ("approximate_quantifier_scope_not_supported", family == "quantifier" and before.value in ABOUT),
        ("idiomatic_all_not_supported", token.value == "all" and before.value == "in"),
        ("idiomatic_order_marker_not_supported", token.value == "after" and before.value == after.value == "day"),
        ("negated_marker_scope_not_supported", before.value in _NOT and not turned),
        ("nonadjacent_negation_scope_not_supported", negated < before.start),
    )
    yield from (reason for reason, raised in tests if raised)


def inventory(text: str) -> tuple[list[dict], list[dict]]:
    """Markers and reasons of a text, with code point offsets."""
    markers, reasons = [], []
    # the first negation is looked for once: a look back from each marker would be quadratic in the text
    parts, negated = _stretches(text)
    for tokens, i, t in ((tokens, i, t) for tokens in parts for i, t in enumerate(tokens)):
        if t.value not in MARKERS:
            continue
        family, value = MARKERS[t.value]
        reasons += [{"reason": r, "start": t.start, "end": t.end, "text": t.text} for r in _ambiguities(tokens, i, family, value, negated)]
        start = t.start
        if i and tokens[i - 1].value == "not" and value == "allowed":
            value, start = "forbidden", tokens[i - 1].start
        markers.append({"family": family, "value": value, "start": start, "end": t.end, "text": text[start : t.end]})
    many = {f for f, n in Counter(m["family"] for m in markers).items() if n > 1}
    for family in FAMILIES:
        if family in many:
            reasons += [
                {"reason": "multiple_markers_require_scope_binding", "start": m["start"], "end": m["end"], "text": m["text"]}
                for m in markers if m["family"] == family
            ]
    return markers, reasons


def compare(candidate: str, reference: str, language: str) -> dict:
    """The review of two texts' qualifiers: state, both inventories, and reasons with their side."""
    empty: dict = {"candidate": [], "reference": [], "reasons": []}
    if candidate == reference:
        return {"state": "unchanged", **empty}
    if language not in ("", "en"):
        return {"state": "unsupported", **empty}
    (a, why_a), (b, why_b) = inventory(candidate), inventory(reference)
    reasons = [{"role": "candidate", **r} for r in why_a] + [{"role": "reference", **r} for r in why_b]
    key = lambda ms: sorted(f"{m['family']}:{m['value']}" for m in ms)
    state = "none" if not a and not b else "abstain" if reasons else "difference" if key(a) != key(b) else "equivalent"
    return {"state": state, "candidate": a, "reference": b, "reasons": reasons}
