"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences after full stops, at blank lines and before lines that begin a
licence sentence. A sentence is read by line and part, and, if it is wrapped, as a whole
too, which counts where it tells what no part does. What mentions what licences speak of is
normalised (lower case, single spaces, no quotes, comment signs or final stop) and looked
up in the table of known licence sentences. What the table doesn't hold word for word -
sentences that name a holder, a version or an address - goes to the first of the sentence
patterns that it matches, or to UNKNOWN if it claims a licence that none matches. The
identifiers in their order form a sequence, and ordered rules are matched against it: a rule
that matches names its licence and takes its sentences out, so that a later, more general
rule doesn't see them.

Nulls and empty texts have no licences. Texts of any length are scanned whole, each row
alone, without a shuffle; repeated rows give repeated rows; an empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# A word of these makes a sentence worth a look.
MENTIONS = (
    r"licen[cs]e|copyright|permission|warrant|redistribut|public\W+domain|\bas\W+is\b|liab|all\W+rights\W+reserved|\bcc0\b|\bcc[- ]by|"
    r"creative\W+commons|advertising\W+materials|applicable\W+law|neither\W+the\W+name|©|\(c\)|misrepresented|accompanying\W+materials|\bmpl\b"
)


def _gnu_sentences() -> list[tuple[str, str]]:
    """The GNU grants by kind, version and whether later versions are allowed."""
    out = []
    for name, kind in (("AGPL", "affero "), ("LGPL", "(?:lesser|library) "), ("GPL", "")):
        for version in ("3", "2.1", "2", "1"):
            v = version.replace(".", r"\.") + r"(?:\.0)?(?![.\d])"
            # each part is looked for once, from where the one before was first found
            base = rf"(?>.*?gnu {kind}general public licen[cs]e)(?>.*?(?:version|v)[ .]?{v})"
            out.append((f"{name}{version}+", base + r".*any later version.*"))
            out.append((f"{name}{version}", base + ".*"))
        out.append((f"{name}any", rf".*gnu {kind}general public licen[cs]e.*"))
    return out


def _creative_commons() -> list[tuple[str, str]]:
    """The Creative Commons grants, the longer names first."""
    out = []
    for name, words in (
        ("BY-NC-SA", "attribution-noncommercial-sharealike"), ("BY-NC-ND", "attribution-noncommercial-noderivatives"),
        ("BY-NC", "attribution-noncommercial"), ("BY-SA", "attribution-sharealike"),
        ("BY-ND", "attribution-noderivatives"), ("BY", "attribution"),
    ):
        for version in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            v = version.replace(".", r"\.")
            out.append((f"CC-{name}-{version}", rf".*(?:\bcc[- ]{name.lower()}|creative commons {words}(?: \w+){{0,8}})[- ]{v}.*"))
    out.append(("CC0", r".*(?:\bcc0\b|creative commons zero).*"))
    return out


def _spdx() -> dict[str, str]:
    """The licences that single sentences name."""
    spdx = {"Apache2": "Apache-2.0", "Apache1.1": "Apache-1.1", "MPL2": "MPL-2.0", "MPL1.1": "MPL-1.1", "EPL2": "EPL-2.0", "EPL1": "EPL-1.0",
            "MITheader": "MIT", "BSD3header": "BSD-3-Clause", "BSD2header": "BSD-2-Clause", "BSDheader": "BSD", "ISCheader": "ISC",
            "ZlibHeader": "Zlib", "BoostHeader": "BSL-1.0", "Unlicense": "Unlicense", "PublicDomain": "Public-Domain", "CC0": "CC0-1.0"}
    for name, _ in [*_gnu_sentences(), *_creative_commons()]:
        if name.startswith("CC-"):
            spdx[name] = name
        elif name != "CC0":
            kind = name.rstrip("+0123456789.").removesuffix("any")
            version = name[len(kind) :].rstrip("+")
            full = "" if version == "any" else f"-{version}" + ("" if "." in version else ".0")
            spdx[name] = f"{kind}{full}" + ("-or-later" if name.endswith("+") else "" if version == "any" else "-only")
    return spdx


def _tags() -> list[tuple[str, str]]:
    """SPDX tags as sentences; the old short forms of the GNU licences too."""
    out = []
    for name, licence in _spdx().items():
        old = licence.removesuffix("-only") if licence.endswith("-only") else licence.replace("-or-later", "+")
        either = "|".join(dict.fromkeys(x.lower().replace(".", r"\.").replace("+", "[+]") for x in (licence, old)))
        out.append((name, rf".*spdx-license-identifier: ?\(*(?:{either})(?![\w+.-]).*"))
    return [*out, ("UNKNOWN", r".*spdx-license-identifier: ?\S.*")]


# Licence sentences word for word, normalised, by their identifier.
KNOWN: dict[str, tuple[str, ...]] = {
    "MITgrant": (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), "
        "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
    ),
    "MITnotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "AsIs": (
        "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, "
        "fitness for a particular purpose and noninfringement",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "NoLiability": (
        "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or "
        "otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    "ISCgrant": (
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    "BSDgrant": (
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "ApacheUse": ("you may not use this file except in compliance with the license",),
    "ApacheUnless": (
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without "
        "warranties or conditions of any kind, either express or implied",
    ),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "GNUhope": (
        "this program is distributed in the hope that it will be useful, but without any warranty",
        "this library is distributed in the hope that it will be useful, but without any warranty",
    ),
    "MPL2": ("this source code form is subject to the terms of the mozilla public license, v. 2.0",),
    "MPLcopy": ("if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/",),
    "ZlibAsIs": ("this software is provided as-is, without any express or implied warranty",),
    "ZlibGrant": (
        "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions",
    ),
    "ZlibMarked": ("altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",),
    "EPLterms": ("the accompanying program is provided under the terms of this eclipse public license",),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
}

# Patterns of sentences that name holders, versions or addresses; the first match names a sentence.
SENTENCES: list[tuple[str, str]] = [
    *_tags(),
    ("BoostGrant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software.*"),
    ("MITgrant", r"permission is hereby granted, free of charge, to any person obtaining a copy.*"),
    ("MITnotice", r"the above copyright notice and this permission notice .*shall be included in all.*"),
    ("ISCgrant", r"permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose.*"),
    ("AsIs", r".*(?:software|work|program) is provided \W*as is\W*.*"),
    ("BSDgrant", r"redistribution and use in source and binary forms.*"),
    ("BSDsource", r".*redistributions? of source code must retain.*"),
    ("BSDbinary", r".*redistributions? in binary form must reproduce.*"),
    ("BSDnames", r"(?>.*?neither the names? of )(?>.*? (?:nor|or) ).*contributors may be used.*"),
    ("BSDads", r".*all advertising materials mentioning features.*"),
    ("ApacheUse", r"you may not use this file except in compliance with the licen[cs]e.*"),
    ("ApacheCopy", r"you may obtain a copy of the licen[cs]e at.*"),
    ("ApacheUnless", r"unless required by applicable law or agreed to in writing.*"),
    ("ApacheSee", r"see the licen[cs]e for the specific language governing.*"),
    ("Apache2", r".*apache(?: software)? licen[cs]e,? ?(?:version|v)?[ .]?2(?:\.0)?(?!\d).*"),
    ("Apache1.1", r".*apache(?: software)? licen[cs]e,? ?(?:version|v)?[ .]?1\.1.*"),
    ("ZlibAsIs", r"this software is provided as-is, without any express or implied warranty.*"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose.*"),
    ("ZlibMarked", r".*(?:altered source versions must be plainly marked|must not be misrepresented).*"),
    ("GNUhope", r"this (?:program|library|software|file) is distributed in the hope that it will be useful.*"),
    ("MPLcopy", r".*copy of the mpl was not distributed.*"),
    ("MPL2", r".*mozilla public licen[cs]e,? ?(?:version|v\.?)? ?2\.0.*"),
    ("MPL1.1", r".*mozilla public licen[cs]e,? ?(?:version|v\.?)? ?1\.1.*"),
    ("EPL2", r"(?>.*?eclipse public licen[cs]e).*2\.0.*"),
    ("EPL1", r"(?>.*?eclipse public licen[cs]e).*1\.0.*"),
    *_gnu_sentences(),
    *_creative_commons(),
    ("MITheader", r".*\bmit(?:[- ]style)? licen[cs]e.*"),
    ("BSD3header", r".*\b(?:3-clause|new|modified|revised) bsd licen[cs]e.*|.*\bbsd[- ]3[- ]clause.*"),
    ("BSD2header", r".*\b(?:2-clause|simplified) bsd licen[cs]e.*|.*\bbsd[- ]2[- ]clause.*"),
    ("BSDheader", r".*\bbsd(?:[- ]style)? licen[cs]e.*"),
    ("ISCheader", r".*\bisc licen[cs]e.*"),
    ("ZlibHeader", r".*\bzlib licen[cs]e.*"),
    ("BoostHeader", r"(?>.*?boost software licen[cs]e).*1\.0.*"),
    ("Unlicense", r".*free and unencumbered software released into the public domain.*|.*\bunlicense\b.*"),
    ("PublicDomain", r".*(?:in|into|to) the public domain.*"),
    ("AllRights", r".*all rights reserved.*"),
    ("Copyright", r"(?:copyright|©|\(c\)).*\d{4}.*"),
    ("UNKNOWN", r"(?>.*?(?:licen[cs]ed under|released under|distributed under|terms of (?:the|this))).*licen[cs]e.*"),
]


def _rules() -> list[tuple[str, str]]:
    """Ordered rules: a licence and the run of sentences that declares it; others may lie between."""
    gap = r"(?: \S+){0,3}"
    rules = [
        ("Apache-2.0", rf" Apache2{gap} ApacheUse(?:{gap} ApacheCopy)?(?:{gap} ApacheUnless)?(?:{gap} ApacheSee)?(?= )"),
        ("MIT", rf"(?: MITheader)?{gap} MITgrant(?:{gap} MITnotice)?(?:{gap} AsIs)?(?: NoLiability)?(?= )"),
        ("ISC", rf"(?: ISCheader)?(?: Copyright)? ISCgrant(?:{gap} AsIs)?(?= )"),
        ("BSD-4-Clause", rf"(?: AllRights)? BSDgrant{gap} BSDads{gap}(?: BSDnames)?(?:{gap} AsIs)?(?= )"),
        ("BSD-3-Clause", rf"(?: AllRights)? BSDgrant{gap} BSDnames(?:{gap} AsIs)?(?= )"),
        ("BSD-2-Clause", rf"(?: AllRights)? BSDgrant(?:{gap} BSDsource)?(?:{gap} BSDbinary)?(?:{gap} AsIs)?(?= )"),
        ("MPL-2.0", r"(?: MPL2(?= ))++(?: MPLcopy)?(?= )"),
        ("Zlib", rf"(?: ZlibHeader)? ZlibAsIs(?: NoLiability)?(?:{gap} ZlibGrant)?(?: ZlibMarked(?= ))*+(?= )"),
        ("BSL-1.0", rf"(?: BoostHeader(?= ))++(?:{gap} BoostGrant)?(?:{gap} AsIs)?(?= )"),
        ("EPL-2.0", r"(?: EPL2(?= ))++(?: EPLterms)?(?= )"),
        ("EPL-1.0", r"(?: AllRights)?(?: EPL1(?= ))++(?: EPLterms)?(?= )"),
    ]
    # what follows a grant of one of the GNU licences repeats its name without a version
    for kind in ("AGPL", "LGPL", "GPL"):
        for version in ("3", "2.1", "2", "1"):
            for later in ("+", ""):
                name = f"{kind}{version}{later}"
                pattern = name.replace("+", "[+]").replace(".", "[.]")
                again = rf"(?:(?: GNUhope)?(?: {kind}any| {pattern})| GNUhope)(?= )"
                rules.append((_spdx()[name], rf"(?<! {kind}any)(?: {kind}any)*+ {pattern}(?= )(?:{again})*+"))
    rules += [(licence, f" {name.replace('+', '[+]').replace('.', '[.]')}(?= )") for name, licence in _spdx().items()]
    return [*rules, ("unknown", r" UNKNOWN(?= )"), ("all-rights-reserved", r" AllRights(?= )")]


RULES = _rules()


# Comment signs before a line, how sentences begin that stand on a line of their own, and where texts are cut for good.
_SIGNS = r"[ \t\r/*#;%<!-]"
_STARTS = (
    r"you may (?:not use|obtain)|unless required by|see the licen|permission (?:is|to)|redistribution|neither the name|the above copyright|"
    r"the (?:software|work|program) is provided|this (?:software|work|program) is|all advertising|all rights|(?:licensed|released|distributed) under|"
    r"copyright (?:\(c\)|©|\d)|spdx-"
)
_ENDS = rf"(?<=[.!?])(?<!\bv\.)\s+|\n{_SIGNS}*+(?=\n)|(?:\n|(?<=;)\s)(?={_SIGNS}*+(?i:{_STARTS}))"


def _plain(s: Column) -> Column:
    """Lower case, single spaces, no quotes, comment signs or final stop."""
    one = F.regexp_replace(F.regexp_replace(F.lower(s), r"""^[\s/*#;%<!-]+|["'“”‘’`]+""", ""), r"\s+", " ")
    return F.regexp_replace(F.trim(one), r"[\s.;:!?]+$", "")


def _sentences(text: Column) -> Column:
    """Structs (parts, whole) of what mentions what licences speak of: a sentence's pieces by line and ';', and all of it, null if it is one piece."""
    # each licence of an SPDX expression is a sentence of its own
    each = F.regexp_replace(text, r"(?i)(?<=spdx-license-identifier:[^\n]{0,200})[ \t]+(?:or|and)[ \t]+", "\nSPDX-License-Identifier: ")
    text = F.when(text.rlike("(?i)spdx-license-identifier"), each).otherwise(text)
    fine = F.filter(F.split(text, _ENDS), lambda s: s.rlike(f"(?i){MENTIONS}"))

    def read(s: Column) -> Column:
        cut = F.filter(F.split(s, r"\n|(?<=;)\s+"), lambda p: p.rlike(r"\S"))
        joined = F.regexp_replace(s, rf"\s*\n{_SIGNS}*+", " ")
        parts = F.transform(F.filter(cut, lambda p: p.rlike(f"(?i){MENTIONS}")), _plain)
        return F.struct(parts.alias("parts"), F.when(F.size(cut) > 1, _plain(joined)).alias("whole"))

    return F.transform(fine, read)


#: The sentence without which a rule doesn't match, where its licence isn't that of one sentence.
_CORE = {"Apache-2.0": "Apache2", "MIT": "MITgrant", "ISC": "ISCgrant", "BSD-4-Clause": "BSDads", "BSD-3-Clause": "BSDnames", "BSD-2-Clause": "BSDgrant", "MPL-2.0": "MPL2", "Zlib": "ZlibAsIs",
         "BSL-1.0": "BoostHeader", "EPL-2.0": "EPL2", "EPL-1.0": "EPL1", "unknown": "UNKNOWN", "all-rights-reserved": "AllRights"}


def _rows() -> Column:
    """The rules as an array of structs (name, pattern, needs)."""
    sentences = {f" {name.replace('+', '[+]').replace('.', '[.]')}(?= )": name for name in _spdx()}
    gnu = {licence: name for name, licence in _spdx().items() if "GPL" in name}
    needs = [sentences.get(pattern) or _CORE.get(licence) or gnu[licence] for licence, pattern in RULES]
    return F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("pattern"), F.lit(f" {c} ").alias("needs")) for (a, b), c in zip(RULES, needs, strict=True)])


def recognise(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, sentences, ids, licenses): the licence sentences, their identifiers, the licences named."""
    # texts without a mention take the short way round
    told = F.col("text").rlike(f"(?i){MENTIONS}")
    none = F.array().cast("array<string>")
    nothing = F.array().cast("array<struct<parts: array<string>, whole: string>>")
    out = docs.select("doc_id", F.when(told, _sentences(F.col("text"))).otherwise(nothing).alias("said"))

    table_ = F.map_from_arrays(*[F.array(*map(F.lit, x)) for x in zip(*[(text, name) for name, texts in KNOWN.items() for text in texts], strict=True)])

    def name(s: Column) -> Column:
        return F.coalesce(F.element_at(table_, s), *[F.when(s.rlike(f"^(?:{pattern})$"), F.lit(x)) for x, pattern in SENTENCES])

    def known_of(s: Column) -> Column:
        """What the pieces name; the whole comes first if it names what no piece does, in place of what it makes exact."""
        named = F.filter(F.transform(s["parts"], lambda p: F.struct(p.alias("sentence"), name(p).alias("id"))), lambda x: x["id"].isNotNull())
        whole = F.struct(s["whole"].alias("sentence"), name(s["whole"]).alias("id"))
        # as an element of an array each is read once, however often it is looked at
        return F.transform(F.array(F.struct(named.alias("named"), whole.alias("whole"))), lambda b: chosen(b["named"], b["whole"]))[0]

    def chosen(named: Column, whole: Column) -> Column:
        def joined(w: Column) -> Column:
            vague = lambda x: (x["id"] == "UNKNOWN") | (x["id"] == F.regexp_replace(w["id"], r"[+]$", "")) | (x["id"] == F.regexp_replace(w["id"], r"(?<=GPL)[\d.]+[+]?$", "any"))
            return F.concat(F.array(w), F.filter(named, lambda x: ~vague(x)))

        adds = whole["id"].isNotNull() & ~F.exists(named, lambda x: x["id"] == whole["id"]) & ((whole["id"] != "UNKNOWN") | (F.size(named) == 0))
        return F.when(adds, joined(whole)).otherwise(named)

    known = F.flatten(F.transform("said", known_of))
    out = out.select("doc_id", F.when(F.size("said") > 0, known).alias("known"))
    out = out.select("doc_id", F.coalesce(F.col("known.sentence"), none).alias("sentences"), F.coalesce(F.col("known.id"), none).alias("ids"))
    start = F.struct(F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")).alias("left"), none.alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        # most rules lack their sentence, and then their pattern isn't tried
        hit = F.contains(acc["left"], rule["needs"]) & F.rlike(acc["left"], rule["pattern"])
        return F.when(
            hit,
            F.struct(F.regexp_replace(acc["left"], rule["pattern"], F.lit("")).alias("left"), F.array_append(acc["found"], rule["name"]).alias("found")),
        ).otherwise(acc)

    matched = F.when(F.size("ids") > 0, F.aggregate(_rows(), start, step)["found"]).otherwise(none)
    return out.select("doc_id", "sentences", "ids", F.array_distinct(F.coalesce(matched, none)).alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence sentences and licences."""
    found = recognise(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
    )
