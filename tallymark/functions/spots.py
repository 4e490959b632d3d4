"""Where a text holds given words or digits, so that only what lies around them is cut into tokens.

No token of the readings holds white space, so the tokens of a piece that begins and ends at
white space are those of the whole text in that place. Words are looked for in the lower-case
text, and found inside of longer words too: the tokens of a piece tell.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# what ``str.split`` takes as white space and the token patterns don't
_CONTROL = "\x1c\x1d\x1e\x1f"
_LETTER, _FOREIGN = re.compile("[A-Za-z]"), re.compile("[^\x00-\x7f]")
#: Pieces that lie so close are one; a text with a place in so many characters is taken whole.
CLOSE, DENSE = 80, 60


@lru_cache(maxsize=100_000)
def _folded(c: str) -> bool:
    """Whether the compatibility form of a character has Latin letters: words may be spelled with it."""
    return bool(_LETTER.search(unicodedata.normalize("NFKC", c)))


@lru_cache(maxsize=100_000)
def _decimal(c: str) -> bool:
    return c.isdecimal()


class Lowered(NamedTuple):
    """A text in lower case, character by character, with straight apostrophes, and its digits that aren't ASCII."""

    low: str
    digits: frozenset[str]


@lru_cache(maxsize=4)
def lowered(text: str) -> Lowered | None:
    """What words and digits are looked up in; None if words of the text can't be. The last few are remembered, as readings share texts."""
    foreign = frozenset() if text.isascii() else frozenset(_FOREIGN.findall(text))
    if any(c in text for c in _CONTROL) or any(map(_folded, foreign)):
        return None
    low = text.lower().replace("’", "'")
    return Lowered(low, frozenset(filter(_decimal, foreign))) if len(low) == len(text) else None


def every(text: str, part: str) -> list[int]:
    """All places of a part."""
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def words_at(text: Lowered, words: frozenset[str]) -> list[int]:
    """Places of the words where they aren't parts of longer ones in Latin letters."""
    low, out = text.low, []
    for w in words:
        for at in every(low, w):
            end = at + len(w)
            if not ("a" <= low[end : end + 1] <= "z" or (at and "a" <= low[at - 1] <= "z")):
                out.append(at)
    return out


def digits_at(text: Lowered) -> list[int]:
    return [at for d in ("0123456789", *text.digits) for c in d if c in text.low for at in every(text.low, c)]


def _begin(text: str, at: int, least: int) -> int:
    """A place behind white space, or 0, with so many stretches of other characters between it and ``at``."""
    size = 64
    while size < at:
        parts = text[at - size : at].split(None, 1)
        # the first stretch may be cut
        if len(parts) == 2 and len(parts[1].split()) >= least:
            return at - len(parts[1])
        size *= 4
    return 0


def _end(text: str, at: int, least: int) -> int:
    """A place before white space, or the end, with so many stretches between ``at`` and it."""
    size = 64
    while at + size < len(text):
        parts = text[at : at + size].rsplit(None, 1)
        if len(parts) == 2 and len(parts[0].split()) >= least:
            return at + len(parts[0])
        size *= 4
    return len(text)


def pieces(text: str, places: list[int], least: int) -> list[tuple[int, int]]:
    """Bounds of the pieces around the places, with so many stretches on both sides of each."""
    if len(places) * DENSE > len(text):
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    for at in sorted(places):
        # what ends far enough behind it needs no end of its own
        if out and at < out[-1][1]:
            begin = out.pop()[0]
        else:
            begin = _begin(text, at, least)
            if out and begin <= out[-1][1] + CLOSE:
                begin = out.pop()[0]
        out.append((begin, _end(text, at, least)))
    return out
