"""Numbered passages in XML: outermost passage elements, group from the element or an ancestor."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from .matrix import Malformed

# Element and attribute names, first match wins.
PASSAGES = ("aya", "ayah", "verse")
GROUPS = ("sura", "surah", "chapter")
GROUP_ATTRIBUTES, ANCESTOR_ATTRIBUTES = ("surah", "sura"), ("index", "id", "number")
ORDINAL_ATTRIBUTES = ("ayah", "aya", "number", "index", "id")
TEXT_ATTRIBUTES = ("translation", "text")


def _name(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _first(element, attributes, children) -> str | None:
    for a in attributes:
        if a in element.attrib:
            return element.attrib[a]
    for child in element.iter():
        if child is not element and _name(child) in children:
            return "".join(child.itertext())
    return None


def matrix(text: str) -> list[list[str | None]]:
    """A header and a record for each passage; raises Malformed on entities, bad XML, or no passage."""
    if re.search(r"<!DOCTYPE|<!ENTITY", text, re.I):
        raise Malformed("entities_refused")
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise Malformed("invalid_xml", str(e)) from e
    out: list[list[str | None]] = [["group", "ordinal", "text"]]
    todo = [(root, None)]
    while todo:
        element, above = todo.pop()
        if _name(element) in PASSAGES:
            group = _first(element, GROUP_ATTRIBUTES, ())
            if group is None and above is not None:
                group = next((above.attrib[a] for a in ANCESTOR_ATTRIBUTES if a in above.attrib), None)
            if group is None:
                group = _first(element, (), ("surah", "chapter"))
            body = _first(element, TEXT_ATTRIBUTES, ("translation", "text"))
            ordinal = _first(element, ORDINAL_ATTRIBUTES, ("ayah", "aya", "ayah_number", "number"))
            out.append([group, ordinal, "".join(element.itertext()) if body is None else body])
            continue
        inner = element if _name(element) in GROUPS else above
        todo += [(child, inner) for child in reversed(list(element))]
    if len(out) == 1:
        raise Malformed("no_passages")
    return out
