"""Strict delimited text: quoting errors are errors, the delimiter is found from a sample."""

from __future__ import annotations

import re
from collections import Counter

from .matrix import Malformed, blank, looks_like_table

# Delimiters in the order in which ties are settled; the last only fits a known layout.
DELIMITERS = (",", "\t", ";", "|", "،")
_SAMPLE, _KEPT = 40, 10


def parse(text: str, delimiter: str | None = None, most: int | None = None) -> list[list[str]]:
    """Records of cells. Raises Malformed on a quote in a bare cell, text after a closing quote, or an open one."""
    text = text.removeprefix("﻿")
    return records_of(text, delimiter or detect(text), most)


def records_of(text: str, delimiter: str, most: int | None = None) -> list[list[str]]:
    """Records of a text that may begin anywhere in a file, but at the start of a record."""
    cut = re.compile(f"[{re.escape(delimiter)}\r\n]")
    records: list[list[str]] = []
    record: list[str] = []
    at, n = 0, len(text)
    while at < n and (most is None or len(records) < most):
        if text[at] == '"':
            cell, at = _quoted(text, at + 1, len(records) + 1)
        else:
            m = cut.search(text, at)
            end = m.start() if m else n
            cell, at = text[at:end], end
            if '"' in cell:
                raise Malformed("quote_in_bare_cell", str(len(records) + 1))
        record.append(cell)
        if at >= n:
            break
        sign = text[at]
        if sign not in (delimiter, "\r", "\n"):
            raise Malformed("text_after_quote", str(len(records) + 1))
        at += 2 if text.startswith("\r\n", at) else 1
        if sign != delimiter:
            records.append(record)
            record = []
        elif at >= n:
            record.append("")
    if record:
        records.append(record)
    return records if most is None else records[:most]


def _quoted(text: str, at: int, record: int) -> tuple[str, int]:
    """The cell whose opening quote was just passed, and where it ends."""
    parts = []
    while True:
        end = text.find('"', at)
        if end < 0:
            raise Malformed("unclosed_quote", str(record))
        parts.append(text[at:end])
        if not text.startswith('""', end):
            return '"'.join(parts), end + 1
        at = end + 2


def detect(text: str) -> str:
    """The delimiter that gives the first records one width; known layouts first, then wider tables."""
    found = []
    for place, delimiter in enumerate(DELIMITERS):
        try:
            sample = [r for r in parse(text, delimiter, _SAMPLE) if not blank(r)][:_KEPT]
        except Malformed:
            continue
        width = len(sample[0]) if sample else 0
        fits = bool(sample) and looks_like_table(sample[0])
        if width >= 2 and all(len(r) == width for r in sample) and (fits or delimiter != DELIMITERS[-1]):
            found.append((not fits, -width, place))
    if found:
        return DELIMITERS[min(found)[2]]
    line = next((x for x in re.split(r"\r\n|\r|\n", text) if x.strip()), "")
    counts = Counter({d: line.count(d) for d in DELIMITERS[:-1]})
    return counts.most_common(1)[0][0]
