"""From a matrix of cells to numbered rows: header roles, identifiers, guards. Pure Python, one file at a time."""

from __future__ import annotations

import json
import re

from ..functions.text import DIGITS_FROM, DIGITS_TO

# Header names of each role, and limits of the strict profile.
ROLES = {
    "group": "surah sura chapter chapternumber surahnumber group سورة السورة رقمالسورة",
    "ordinal": "ayah aya verse versenumber ayahnumber ordinal آية الآية رقمالآية",
    "text": "translation text translatedtext translationtext ترجمة الترجمة النص نصالترجمة",
    "id": "id verseid ayahid versekey ayahkey معرف معرفالآية",
}
MAX_ROWS, MAX_TEXT, MAX_COLUMNS = 20_000, 20_000, 128

_TO_ASCII = str.maketrans(DIGITS_FROM, DIGITS_TO)
_COMPOSITE = re.compile(r"^(\d{1,3})[:/.](.+)$")


class Malformed(ValueError):
    """A file that can't be read without a guess; the code says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


def header_form(value) -> str:
    """A header for comparison: lower case, without spaces, dashes and tatweel, alef forms as one."""
    text = re.sub(r"[\s_\-ـ]", "", str("" if value is None else value).strip().lower())
    return re.sub("[أإآ]", "ا", text)


_NAMES = {role: {header_form(n) for n in names.split()} for role, names in ROLES.items()}


def digits(value) -> str:
    return ("" if value is None else str(value)).strip().translate(_TO_ASCII)


def blank(record) -> bool:
    return all(not str("" if v is None else v).strip() for v in record)


def looks_like_table(cells) -> bool:
    """A header with two known roles, or a headerless row of number, number or range, text."""
    if sum(any(header_form(c) in names for c in cells) for names in _NAMES.values()) >= 2:
        return True
    return len(cells) >= 3 and digits(cells[0]).isdecimal() and bool(re.fullmatch(r"[\d-]+", digits(cells[1])))


def _columns(first: list[str], body: list, mapping: dict[str, int | str] | None) -> tuple[dict[str, int], int, list[str]]:
    """The column of each role (-1: none), where data begins, and warnings."""
    at, warnings = {}, []
    mapping = mapping or {}
    for role, names in _NAMES.items():
        want = mapping.get(role)
        found = [i for i, c in enumerate(first) if header_form(c) in names]
        if role == "id" and want is None and "group" in mapping and "ordinal" in mapping:
            at[role] = -1
        elif want is None:
            if len(found) > 1:
                raise Malformed("ambiguous_header", role)
            at[role] = found[0] if found else -1
        else:
            at[role] = want if isinstance(want, int) else first.index(want) if want in first else -1
            if not -1 <= at[role] < len(first):
                raise Malformed("mapping_out_of_range", role)
    if "id" not in mapping and min(at["id"], at["group"], at["ordinal"]) >= 0:
        sample = [digits(r[at["id"]]) if at["id"] < len(r) else "" for r in body[:50]]
        if not any(re.match(r"^\d{1,3}[:/.]\d+", s) for s in sample):
            at["id"] = -1
            warnings.append("incidental_id_column_ignored")
    start = 1
    if at["text"] < 0 or (at["id"] < 0 and min(at["group"], at["ordinal"]) < 0):
        if not (len(first) >= 3 and digits(first[0]).isdecimal() and re.fullmatch(r"[\d-]+", digits(first[1]))):
            raise Malformed("columns_not_recognised")
        at, start = {"group": 0, "ordinal": 1, "text": 2, "id": -1}, 0
        warnings.append("headerless_columns_assumed")
    return at, start, warnings


class Layout:
    """Where the columns of a matrix are, from its first record that isn't blank and a sample of what follows."""

    def __init__(self, first: list, body: list, mapping: dict[str, int | str] | None = None, lead: int = 0):
        """``lead``: blank records before the first. Raises Malformed."""
        names = [str("" if v is None else v).strip() for v in first]
        self.width = len(names)
        self.at, start, self.warnings = _columns(names, body, mapping)
        if lead:
            self.warnings.append("leading_blank_rows_skipped")
        #: Records before the first one of data.
        self.before = lead + start

    def to_json(self) -> str:
        return json.dumps([self.width, self.at, self.before])

    @classmethod
    def from_json(cls, text: str) -> Layout:
        out = cls.__new__(cls)
        out.width, out.at, out.before = json.loads(text)
        out.warnings = []
        return out

    def row(self, record: list, i: int, strict: bool = True) -> dict | None:
        """The row of the i-th record of all; None for a blank one. Raises Malformed."""
        if blank(record):
            return None
        at = self.at
        if len(record) != self.width:
            raise Malformed("ragged_row", str(i))
        if strict and len(record) > MAX_COLUMNS:
            raise Malformed("too_many_columns", str(i))
        group, ordinal = (digits(record[at[r]]) if at[r] >= 0 else "" for r in ("group", "ordinal"))
        if at["id"] >= 0:
            whole = digits(record[at["id"]])
            m = _COMPOSITE.match(whole)
            if m and ((group and group != m[1]) or (ordinal and ordinal != m[2])):
                raise Malformed("identifier_conflict", str(i))
            group, ordinal = (m[1], m[2]) if m else ("", whole)
        value = record[at["text"]]
        kind = "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"
        text = "" if value is None else value if kind == "string" else str(value)
        if strict and len(text) > MAX_TEXT:
            raise Malformed("text_too_long", str(i))
        return {"group_raw": group, "ordinal_raw": ordinal, "text": text if kind == "string" else None, "row_number": i, "raw_type": kind}


def rows_from_matrix(matrix: list[list], mapping: dict[str, int | str] | None = None, strict: bool = True) -> tuple[list[dict], list[str]]:
    """Rows (group_raw, ordinal_raw, text, row_number, raw_type) and warnings; raises Malformed.

    ``strict`` enforces the limits on rows, columns and text.
    """
    lead = next((i for i, r in enumerate(matrix) if not blank(r)), None)
    if lead is None:
        raise Malformed("empty_file")
    layout = Layout(matrix[lead], matrix[lead + 1 :], mapping, lead)
    rows = [r for i, record in enumerate(matrix[layout.before :], layout.before + 1) if (r := layout.row(record, i, strict)) is not None]
    if not rows:
        raise Malformed("no_data_rows")
    if strict and len(rows) > MAX_ROWS:
        raise Malformed("too_many_rows")
    return rows, layout.warnings
