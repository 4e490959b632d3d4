"""Reads numbered HTML passages: their body, their notes apart, note marks and the passage's own number removed.

A parser's events build the body piece by piece. A raised mark is held back until it closes
and is then one of three things: a power, if it is a small number right behind a number or
a unit and no note link; a note's mark, which goes; or text like any other.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements whose content isn't shown, elements that don't part words, classes of note blocks.
HIDDEN = frozenset(("script", "style", "noscript", "iframe", "object", "embed"))
WITHIN_WORDS = frozenset(("a", "b", "em", "i", "span", "strong"))
NOTE_BLOCKS = frozenset(("foot-notes", "footnotes"))
NOTE_LINKS = frozenset(("footnote", "footnote-ref", "noteref", "doc-noteref"))
NOTE_TARGETS = ("#fn", "#footnote", "#note")
UNITS = frozenset(("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "mL", "l", "L", "s"))
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "ndash": "–", "mdash": "—", "hellip": "…"}

_EXPONENT = re.compile(r"[+\-−]?\d{1,3}")
_MARK = re.compile(r"[\[(]?\s*(?:\d{1,3}[a-z]?|[*†‡])?\s*[\])]?", re.I)
_CONTROL = dict.fromkeys([*range(9), 0x0B, 0x0C, *range(0x0E, 0x20)])
#: Stands for an ampersand while the parser runs, so that only the references below are read.
_HELD = "\ue000"


def character(reference: str) -> str | None:
    """The character of a reference such as amp, #65 or #x41; empty for numbers of none, null for other names."""
    name = reference.lower()
    if name in NAMED:
        return NAMED[name]
    digits, base = (name[2:], 16) if name.startswith("#x") else (name[1:], 10)
    try:
        number = int(digits, base) if name.startswith("#") else None
    except ValueError:
        return None
    if number is None:
        return None
    return chr(number) if 0 < number < 0x110000 and number not in range(0xD800, 0xE000) else ""


def decoded(text: str, sign: str = "&") -> str:
    """The text with its references read; what is no reference stays."""
    head, *rest = text.split(sign)
    out = [head]
    for part in rest:
        name, end, tail = part.partition(";")
        got = character(name) if end and len(name) < 12 else None
        out.append("&" + part if got is None else got + tail)
    return "".join(out)


def _shown(text: str) -> str:
    return " ".join(decoded(text, _HELD).translate(_CONTROL).split())


class _Reader(HTMLParser):
    """Collects the body's pieces (text, or a tag's name), notes, powers and note marks."""

    def __init__(self, keep_marks: bool):
        super().__init__(convert_charrefs=False)
        self.keep_marks = keep_marks
        self.pieces: list[tuple[str, str]] = []  # kind (text, edge, seam) and text
        self.notes: list[str] = []
        self.powers = self.marks = 0
        self.hidden: str | None = None
        self.note: list[str] | None = None
        self.raised: list[tuple[str, str]] | None = None
        self.raised_link = self.inside_link = False

    def _put(self, kind: str, text: str = "") -> None:
        if self.note is not None:
            self.note.append(text if kind == "text" else " ")
        elif self.raised is not None:
            self.raised.append((kind, text))
        else:
            self.pieces.append((kind, text))

    @staticmethod
    def _links_a_note(attributes: dict[str, str]) -> bool:
        words = f"{attributes.get('class') or ''} {attributes.get('role') or ''}".lower().split()
        return not NOTE_LINKS.isdisjoint(words) or (attributes.get("href") or "").lower().startswith(NOTE_TARGETS)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if self.hidden is not None:
            return
        if tag in HIDDEN:
            self.hidden = tag
        elif tag == "div" and self.note is None and not NOTE_BLOCKS.isdisjoint((given.get("class") or "").lower().split()):
            self._put("edge")
            self.note = []
            return
        if tag == "sup" and self.note is None:
            self.raised, self.raised_link = [], self.inside_link or self._links_a_note(given)
        elif tag == "a":
            linked = self._links_a_note(given)
            self.inside_link = linked
            self.raised_link |= linked
        self._put("seam" if tag in WITHIN_WORDS else "edge")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden is not None:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        if tag == "div" and self.note is not None:
            self.notes.append(_shown("".join(self.note)))
            self.note = None
            return
        if tag == "a":
            self.inside_link = False
        if tag == "sup" and self.raised is not None and self.note is None:
            self._settle()
            return
        self._put("seam" if tag in WITHIN_WORDS else "edge")

    def handle_data(self, data: str) -> None:
        if self.hidden is None:
            self._put("text", data)

    def handle_comment(self, data: str) -> None:
        self._put("edge")

    def _before(self) -> str:
        """What is shown right before, back to the last break between words; a few signs tell a unit."""
        out, size = [], 0
        for kind, text in reversed(self.pieces):
            if kind == "edge":
                continue
            out.append(text[-64:])
            size += len(text)
            if size > 8 or any(map(str.isspace, text)):
                break
        return decoded("".join(reversed(out)), _HELD)

    def _settle(self) -> None:
        held, self.raised = self.raised or [], None
        inner = _shown("".join(text if kind == "text" else " " for kind, text in held))
        before = self._before()
        last = re.split(r"[\s(]", before)[-1]
        if _EXPONENT.fullmatch(inner) and not self.raised_link and (before[-1:].isdigit() or last in UNITS):
            self.powers += 1
            self.pieces.append(("text", f"^{inner}"))
        elif not self.keep_marks and _MARK.fullmatch(inner):
            self.marks += 1
        else:
            self.pieces += [("edge", ""), *held, ("edge", "")]
        self.raised_link = False

    def body(self) -> str:
        """The text shown. Where a power must stay with its base, tags within words don't part them."""
        joined = self.powers > 0
        return _shown("".join(text if kind == "text" or (kind == "seam" and joined) else " " for kind, text in self.pieces))


def _read(html: str, keep_marks: bool) -> _Reader:
    reader = _Reader(keep_marks)
    reader.feed(html.replace(_HELD, "").replace("&", _HELD))
    reader.close()
    if reader.raised is not None:  # never closed: text like any other
        held, reader.raised = reader.raised, None
        reader.pieces += held
    if reader.note is not None:  # never closed: no note block
        reader.pieces.append(("text", " ".join(reader.note)))
    return reader


def _without_own_number(text: str, group, ordinal) -> str:
    """The text without (g:n), [g:n], (n) or n. in front."""
    for opening, closing in ("()", "[]"):
        inside, end, rest = text.partition(closing)
        if end and inside.startswith(opening):
            told = [x.strip() for x in inside[1:].split(":")]
            if told == [str(group), str(ordinal)] or (opening == "(" and inside[1:] == str(ordinal)):
                return rest.lstrip()
    rest = text.removeprefix(f"{ordinal}.")
    return rest.lstrip() if rest != text and not rest[:1].isdigit() else text


def read_passage(html: str, group, ordinal) -> dict:
    """Body text of a numbered passage and what was done to it. If nothing would be left, the body stays as it was sent."""
    reader = _read(html, keep_marks=False)
    body = reader.body()
    text = _without_own_number(body, group, ordinal)
    bare, brackets = re.subn(r"\[\d+\]", "", text)
    bare = " ".join(bare.split())
    notes = [x for x in reader.notes if x]
    if not bare:
        kept = _read(html, keep_marks=True).body()
        if kept:
            return {"text": kept, "notes": notes, "prefix_removed": False, "anchors_removed": 0, "kept_as_sent": True}
    return {"text": bare, "notes": notes, "prefix_removed": text != body, "anchors_removed": reader.marks + brackets, "kept_as_sent": False}
