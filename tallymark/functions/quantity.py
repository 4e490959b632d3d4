"""Quantities written in a text: exact amounts with units, or reasons to abstain.

A text becomes tokens, the tokens that start a number become phrases, and every phrase is
put to a list of doubts. Amounts are fractions in base units. Nothing binds an amount to
what it counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import regex

from . import spots
from .text import DIGITS_FROM, DIGITS_TO

# Tokens, number words, scales, words that stop a reading.
TOKEN = regex.compile(r"[+\-−]?\p{Nd}+(?:[.,٫٬]\p{Nd}+)*(?:[eE][+\-]?\p{Nd}+)?|[\p{L}][\p{L}\p{M}\p{N}]*(?:['’][\p{L}\p{M}]*)*|[%٪]|\S")
# the same for text of ASCII only
_ASCII_TOKEN = re.compile(r"[+\-]?[0-9]+(?:[.,][0-9]+)*(?:[eE][+\-]?[0-9]+)?|[A-Za-z][A-Za-z0-9]*(?:'[A-Za-z]*)*|[^\t-\r ]")
ONES_EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS_EN = "twenty thirty forty fifty sixty seventy eighty ninety".split()
CARDINALS_AR = {
    0: "صفر", 1: "واحد واحدة", 2: "اثنان اثنين اثنتان اثنتين", 3: "ثلاثة ثلاث", 4: "أربعة اربعة أربع اربع", 5: "خمسة خمس",
    6: "ستة ست", 7: "سبعة سبع", 8: "ثمانية ثمان ثماني", 9: "تسعة تسع", 10: "عشرة عشر", 20: "عشرون عشرين", 30: "ثلاثون ثلاثين",
    40: "أربعون اربعون أربعين اربعين", 50: "خمسون خمسين", 60: "ستون ستين", 70: "سبعون سبعين", 80: "ثمانون ثمانين",
    90: "تسعون تسعين", 100: "مئة مائة", 1000: "ألف الف",
}
UNREAD_EN = set("half halves quarter quarters dozen million millions billion billions trillion trillions".split())
UNREAD_AR = set("أحد احد إحدى احدى اثنا اثني اثنتا اثنتي نصف ثلث ربع مليون ملايين مليار مليارات".split())
SCALES_EN = {"hundred": 100, "thousand": 1000}
ABOUT = set("about approximately around roughly nearly almost circa حوالي تقريبا نحو قرابة".split())
BOUND = re.compile(r"(?:at least|at most|more than|less than|between|على الأقل|على الاقل|أكثر من|اكثر من|أقل من|اقل من)$")
# Units by dimension, with their factor to the base unit.
UNITS_TEXT = (
    ("length", Fraction(1, 1000), "mm millimeter millimeters millimetre millimetres ملليمتر مليمتر"),
    ("length", Fraction(1, 100), "cm centimeter centimeters centimetre centimetres سنتيمتر"),
    ("length", Fraction(1), "m meter meters metre metres متر أمتار امتار"),
    ("length", Fraction(1000), "km kilometer kilometers kilometre kilometres كيلومتر كيلومترات"),
    ("mass", Fraction(1, 1000), "mg milligram milligrams مليغرام ملليغرام"),
    ("mass", Fraction(1), "g gram grams غرام جرام"),
    ("mass", Fraction(1000), "kg kilogram kilograms كيلوغرام كيلوجرام كغ"),
    ("volume", Fraction(1, 1000), "ml milliliter milliliters millilitre millilitres مليلتر ملليلتر"),
    ("volume", Fraction(1), "l liter liters litre litres لتر لترات"),
    ("duration", Fraction(1), "s second seconds ثانية ثوان ثواني"),
    ("duration", Fraction(60), "minute minutes دقيقة دقائق"),
    ("duration", Fraction(3600), "hour hours ساعة ساعات"),
    ("duration", Fraction(86400), "day days يوم أيام ايام"),
    ("percent", Fraction(1), "% ٪ percent percentage بالمئة بالمائة"),
)
UNREAD_UNITS = set(
    "pound pounds lb lbs ounce ounces oz inch inches foot feet yard yards mile miles cup cups celsius fahrenheit square cubic sqm sqft "
    "درجة درجات فهرنهايت مئوية مربع مكعب".split()
)
SYMBOLS = {s: {s} for s in "mm cm m km mg g kg s".split()} | {"ml": {"ml", "mL"}, "l": {"l", "L"}}

_TO_ASCII = str.maketrans(DIGITS_FROM, DIGITS_TO)
_POWERED = re.compile(r"^(?:mm|cm|m|km|mg|g|kg|ml|l|s)[23²³]$")
_ARABIC = regex.compile(r"\p{Script=Arabic}")
_ARABIC_MARKS = regex.compile(r"[\p{M}ـ]")
_ND = regex.compile(r"^[+\-−]?\p{Nd}")
_LETTER = regex.compile(r"^\p{L}")
_GLUE = regex.compile(r"[\p{L}/:\-.]")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")


@lru_cache(maxsize=100_000)
def token_value(text: str) -> str:
    """The form of a token that comparisons use."""
    value = unicodedata.normalize("NFKC", text).lower().replace("’", "'")
    return _ARABIC_MARKS.sub("", value) if _ARABIC.search(value) else value


VALUES_EN = {w: i for i, w in enumerate(ONES_EN)} | {w: 10 * i for i, w in enumerate(TENS_EN, 2)}
VALUES_AR = {w: n for n, words in CARDINALS_AR.items() for w in words.split()}
_WORDS_EN = frozenset(VALUES_EN) | frozenset(SCALES_EN) | UNREAD_EN
UNITS = {token_value(w): (dimension, factor) for dimension, factor, words in UNITS_TEXT for w in words.split()}


class Token(NamedTuple):
    text: str
    value: str
    start: int
    end: int

    @property
    def digits(self) -> bool:
        return bool(_ND.match(self.text))


NONE = Token("", "", -1, -1)


def tokenise(text: str, begin: int = 0, end: int | None = None) -> list[Token]:
    """The text's tokens, or those of a part of it."""
    pattern = _ASCII_TOKEN if text.isascii() else TOKEN
    return [Token(t := m[0], token_value(t), *m.span()) for m in pattern.finditer(text, begin, len(text) if end is None else end)]


#: A number is read with four tokens before it and five behind it at most.
_AROUND = 6


@lru_cache(maxsize=4)
def stretches(text: str, language: str) -> list[list[Token]]:
    """The text's tokens around its numbers, in stretches; the last few texts are remembered, as a comparison reads each twice."""
    low = None if language == "ar" else spots.lowered(text)
    if low is None:
        return [tokenise(text)]
    places = spots.digits_at(low)
    if language in ("", "en"):
        places += spots.words_at(low, _WORDS_EN)
    return [tokenise(text, *bounds) for bounds in spots.pieces(text, places, _AROUND)] if places else []


@lru_cache(maxsize=100_000)
def is_number(text: str, language: str) -> bool:
    """Whether a token belongs to a number; most tokens don't, and are told once by their spelling."""
    return bool(_ND.match(text)) or is_cardinal(token_value(text), language)


def is_cardinal(value: str, language: str) -> bool:
    """Whether a word belongs to a number in the language; no language reads as English."""
    if language == "ar":
        bare = value.removeprefix("و")
        return any(w in VALUES_AR or w in UNREAD_AR for w in {value, bare})
    return language in ("", "en") and (value in VALUES_EN or value in SCALES_EN or value in UNREAD_EN)


def literal(text: str) -> Fraction | str:
    """The amount of a number in digits, or the reason why it isn't read."""
    if any(unicodedata.category(c) == "Nd" and c not in DIGITS_TO + DIGITS_FROM for c in text):
        return "unicode_numeral_alphabet_not_supported"
    value = text.translate(_TO_ASCII).replace("−", "-")
    checks = (
        (len(value) > 42, "numeric_literal_exceeds_bound"),
        ("e" in value.lower(), "scientific_notation_not_supported"),
        ("," in value, "western_comma_locale_ambiguous"),
        ("٬" in value and not re.fullmatch(r"[+-]?\d{1,3}(?:٬\d{3})+(?:٫\d+)?", value), "invalid_arabic_grouping"),
    )
    for wrong, reason in checks:
        if wrong:
            return reason
    value = value.replace("٬", "").replace("٫", ".")
    return Fraction(value) if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", value) else "numeric_literal_not_supported"


def _below_hundred(words: list[str]) -> int | None:
    match words:
        case [w]:
            return VALUES_EN.get(w)
        case [tens, ones] if tens in TENS_EN and 0 < VALUES_EN.get(ones, 0) < 10:
            return VALUES_EN[tens] + VALUES_EN[ones]
    return None


def _scaled(words: list[str], scale: str, head, rest) -> int | None:
    """head * scale + rest, where the scale word splits the words; "and" may follow it."""
    at = words.index(scale)
    tail = words[at + 1 :]
    tail = tail[1:] if tail[:1] == ["and"] else tail
    a, b = head(words[:at]), rest(tail) if tail else 0
    return None if not a or b is None else a * SCALES_EN[scale] + b


def _below_thousand(words: list[str]) -> int | None:
    if "hundred" not in words:
        return _below_hundred(words)
    one = lambda w: VALUES_EN.get(w[0], 0) if len(w) == 1 and VALUES_EN.get(w[0], 0) < 10 else None
    return _scaled(words, "hundred", one, _below_hundred)


def spelled(words: list[str], language: str) -> Fraction | str:
    """The amount of a number in words, or the reason why it isn't read."""
    if language == "ar":
        if len(words) == 1 and not words[0].startswith("و") and words[0] in VALUES_AR:
            return Fraction(VALUES_AR[words[0]])
        return "arabic_compound_cardinal_not_supported"
    value = _scaled(words, "thousand", _below_thousand, _below_thousand) if "thousand" in words else _below_thousand(words)
    return "written_cardinal_composition_ambiguous" if value is None else Fraction(value)


@dataclass
class Phrase:
    """A number: tokens first..last of the text, an article that counts as one, its amount or a reason."""

    tokens: list[Token]
    first: int
    last: int
    amount: Fraction | str
    article: bool = False

    def at(self, k: int) -> Token:
        """The k-th token after the number."""
        i = self.last + k
        return self.tokens[i] if i < len(self.tokens) else NONE

    @property
    def begin(self) -> int:
        return self.first - self.article

    @property
    def lead(self) -> Token:
        return self.tokens[self.begin - 1] if self.begin else NONE

    @property
    def unit_place(self) -> int:
        return 2 if self.at(1).value == "-" and self.at(2).value in UNITS else 1


def phrases(tokens: list[Token], language: str) -> Iterator[Phrase]:
    i = 0
    value = lambda k: tokens[k].value if k < len(tokens) else ""
    while i < len(tokens):
        first, last = tokens[i], i
        if not is_number(first.text, language):
            i += 1
            continue
        if first.digits:
            yield Phrase(tokens, i, i, literal(first.text))
        elif is_cardinal(first.value, language):
            while True:
                if is_cardinal(value(last + 1), language):
                    last += 1
                elif value(last + 1) in ("and", "و", "-") and is_cardinal(value(last + 2), language):
                    last += 2
                else:
                    break
            words = [t.value for t in tokens[i : last + 1] if t.value != "-"]
            amount, article = spelled(words, language), False
            if isinstance(amount, str) and last == i and language in ("", "en") and first.value in SCALES_EN and i and tokens[i - 1].value == "a":
                amount, article = Fraction(SCALES_EN[first.value]), True
            yield Phrase(tokens, i, last, amount, article)
        i = last + 1


def doubts(p: Phrase, text: str, language: str) -> Iterator[tuple[str, Token]]:
    """Reasons not to trust the phrase, each with the token that raises it."""
    first, end, after, then = p.tokens[p.first], p.tokens[p.last].end, p.at(1), p.at(2)
    number = lambda t: t is not NONE and (t.digits or is_cardinal(t.value, language))
    before = p.tokens[p.first - 1] if p.first else NONE
    unit = p.at(p.unit_place)
    past = p.at(p.unit_place + 1)
    odd_unit = lambda v: v in UNREAD_UNITS or bool(_POWERED.match(v))
    whole = Token(text[first.start : end], first.value, first.start, end)
    prior = " ".join(t.value for t in p.tokens[max(0, p.begin - 3) : p.begin])
    touching = after is not NONE and after.start == end
    tests = (
        ("adjacent_identifier_or_compound_syntax", before is not NONE and before.end == first.start and _GLUE.search(before.text), first),
        (p.amount, isinstance(p.amount, str), whole),
        ("adjacent_numeric_components_not_supported", number(after), after),
        ("separate_numeric_conjunction_ambiguous", after.value in ("and", "و") and number(then), after),
        ("numeric_power_not_supported", after.value == "^", after),
        (
            "fraction_range_date_or_time_not_supported",
            (after.value in ("/", ":", "-", "–", "—") and not (after.value == "-" and then.value in UNITS)) or (touching and after.digits), after,
        ),
        ("adjacent_identifier_or_compound_syntax", touching and _LETTER.match(after.text) and after.value not in UNITS and not odd_unit(after.value), after),
        ("approximate_quantity_not_exact", p.lead.value in ABOUT, p.lead),
        ("bounded_quantity_not_exact", BOUND.search(prior) or p.lead.value in ("<", ">", "≤", "≥"), p.lead if p.lead is not NONE else first),
        ("unit_conversion_not_supported", odd_unit(unit.value) or unit.value == "°", unit),
        ("unit_symbol_case_ambiguous", unit.value in UNITS and unit.text not in SYMBOLS.get(unit.value, {unit.text}), unit),
        (
            "compound_or_power_unit_not_supported",
            unit.value in UNITS and (past.value in ("/", "^", "²", "³") or (past.digits and past.start == unit.end)), past,
        ),
    )
    yield from ((reason, token) for reason, raised, token in tests if raised)


def inventory(text: str, language: str) -> tuple[list[dict], list[dict]]:
    """Quantities and reasons of a text, with code point offsets."""
    quantities, reasons = [], []
    for p in (p for tokens in stretches(text, language) for p in phrases(tokens, language)):
        reasons += [{"reason": r, "start": t.start, "end": t.end, "text": t.text} for r, t in doubts(p, text, language)]
        if isinstance(p.amount, str):
            continue
        unit = p.at(p.unit_place)
        dimension, factor = UNITS.get(unit.value, ("unitless", Fraction(1)))
        amount = p.amount * factor
        start, end = p.tokens[p.begin].start, unit.end if unit.value in UNITS else p.tokens[p.last].end
        quantities.append({
            "dimension": dimension, "numerator": str(amount.numerator), "denominator": str(amount.denominator),
            "start": start, "end": end, "text": text[start:end], "unit": unit.text if unit is not NONE else None,
        })
    return quantities, reasons


def signature(text: str, language: str) -> list[tuple]:
    """How the numbers stand in the text; equal signatures need no reading."""
    out = []
    for tokens, i, t in ((tokens, i, t) for tokens in stretches(text, language) for i, t in enumerate(tokens)):
        if not is_number(t.text, language):
            continue
        begin = i - 1 if language in ("", "en") and t.value in SCALES_EN and i and tokens[i - 1].value == "a" else i
        prior = " ".join(x.value for x in tokens[max(0, begin - 3) : begin])
        lead = tokens[begin - 1].value if begin else ""
        bounded = BOUND.search(prior) or lead in ABOUT or lead in ("<", ">", "≤", "≥")
        left = tokens[i - 1].text if i and not _WORDLIKE.search(tokens[i - 1].text) else ""
        nxt = tokens[i + 1] if i + 1 < len(tokens) else NONE
        telling = not _WORDLIKE.search(nxt.text) or nxt.value in UNITS or nxt.value in UNREAD_UNITS or _POWERED.match(nxt.value) or nxt.start == t.end
        out.append((t.text, left, nxt.text if nxt is not NONE and telling else "", prior if bounded else ""))
    return out


def compare(candidate: str, reference: str, language: str) -> dict:
    """The review of two texts' quantities: state, both inventories, and reasons with their side."""
    empty: dict = {"candidate": [], "reference": [], "reasons": []}
    if candidate == reference:
        return {"state": "unchanged", **empty}
    ours = signature(candidate, language)
    if ours == signature(reference, language):
        return {"state": "unchanged" if ours else "none", **empty}
    (a, why_a), (b, why_b) = inventory(candidate, language), inventory(reference, language)
    reasons = [{"role": "candidate", **r} for r in why_a] + [{"role": "reference", **r} for r in why_b]
    key = lambda qs: sorted(f"{q['dimension']}:{q['numerator']}/{q['denominator']}" for q in qs)
    state = "abstain" if reasons else "difference" if key(a) != key(b) else "equivalent"
    return {"state": state, "candidate": a, "reference": b, "reasons": reasons}
