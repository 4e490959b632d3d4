"""Spreadsheets: archive checks before anything is inflated, then cells of one sheet. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

from .matrix import MAX_COLUMNS, MAX_ROWS, Malformed

# Budgets of an archive.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO = 2_000, 50 << 20, 100 << 20, 2_000
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def checked(content: bytes) -> dict[str, bytes]:
    """The archive's entries, inflated within the budgets and matching their checksums; raises Malformed."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OverflowError) as e:
        raise Malformed("not_an_archive") from e
    entries = archive.infolist()
    if len(entries) > MAX_ENTRIES:
        raise Malformed("too_many_entries")
    spans, total, names = [], 0, set()
    for e in entries:
        parts = e.filename.split("/")
        if e.filename in names or e.filename.startswith("/") or "\\" in e.filename or ".." in parts or "\0" in e.filename:
            raise Malformed("unsafe_or_repeated_name", e.filename[:80])
        names.add(e.filename)
        if e.flag_bits & 1:
            raise Malformed("encrypted_entry")
        if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise Malformed("unknown_compression")
        total += e.file_size
        if e.file_size > MAX_ENTRY or total > MAX_TOTAL or e.file_size > MAX_RATIO * max(1, e.compress_size):
            raise Malformed("archive_budget")
        spans.append((e.header_offset, e.header_offset + 30 + len(e.filename.encode()) + e.compress_size))
    spans.sort()
    if any(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False)) or (spans and spans[-1][1] > len(content)):
        raise Malformed("overlapping_entries")
    return {e.filename: _inflated(content, e) for e in entries if not e.is_dir()}


def _inflated(content: bytes, e: zipfile.ZipInfo) -> bytes:
    head = content[e.header_offset : e.header_offset + 30]
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise Malformed("broken_entry", e.filename[:80])
    at = e.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    raw = content[at : at + e.compress_size]
    if e.compress_type == zipfile.ZIP_DEFLATED:
        try:
            raw = zlib.decompressobj(-15).decompress(raw, e.file_size + 1)
        except zlib.error as error:
            raise Malformed("broken_entry", e.filename[:80]) from error
    if len(raw) != e.file_size or zlib.crc32(raw) != e.CRC:
        raise Malformed("checksum_mismatch", e.filename[:80])
    return raw


def _xml(files: dict[str, bytes], name: str):
    if name not in files:
        raise Malformed("missing_part", name)
    if re.search(rb"<!DOCTYPE|<!ENTITY", files[name], re.I):
        raise Malformed("entities_refused")
    try:
        return ElementTree.fromstring(files[name])
    except ElementTree.ParseError as e:
        raise Malformed("invalid_xml", name) from e


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[str]:
    return [s.attrib.get("name", "") for s in _xml(checked(content), "xl/workbook.xml").iter(f"{_S}sheet")]


def matrix(content: bytes, sheet: str | None = None) -> list[list]:
    """Cells of the first or the named sheet; numbers and booleans stay what they are."""
    files = checked(content)
    listed = list(_xml(files, "xl/workbook.xml").iter(f"{_S}sheet"))
    chosen = next((s for s in listed if sheet is None or s.attrib.get("name") == sheet), None)
    if chosen is None:
        raise Malformed("no_such_sheet")
    links = {r.attrib["Id"]: r.attrib["Target"] for r in _xml(files, "xl/_rels/workbook.xml.rels")}
    target = links.get(chosen.attrib.get(f"{_R}id"), "worksheets/sheet1.xml")
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    shared = []
    if "xl/sharedStrings.xml" in files:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(files, "xl/sharedStrings.xml").iter(f"{_S}si")]
    out: list[list] = []
    for row in _xml(files, path).iter(f"{_S}row"):
        number = int(row.attrib.get("r", len(out) + 1))
        if number > MAX_ROWS + 1:
            raise Malformed("too_many_rows")
        while len(out) < number - 1:
            out.append([])
        cells: list = []
        for c in row.iter(f"{_S}c"):
            at = _column(c.attrib["r"]) if "r" in c.attrib else len(cells)
            if at >= MAX_COLUMNS:
                raise Malformed("too_many_columns")
            cells += [None] * (at + 1 - len(cells))
            cells[at] = _value(c, shared)
        out.append(cells)
    width = max(map(len, out), default=0)
    return [r + [None] * (width - len(r)) for r in out]


def _value(c, shared: list[str]):
    kind, v = c.attrib.get("t", "n"), c.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        i = int(v.text)
        if not 0 <= i < len(shared):
            raise Malformed("broken_shared_string")
        return shared[i]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() and abs(number) < 2**53 else number
