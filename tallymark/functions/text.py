"""Text functions as Column expressions: digits, tokens, markers, hygiene, differences.

All of them stay in the JVM. Offsets are code points; ``functions.udfs`` has UTF-16 ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit alphabets, format controls, the token pattern, white space.
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
SPACE = r"\t-\r \u0085   -     　﻿"
FORMAT_CONTROLS = r"[​-‏‪-‮⁠-⁩﻿]"
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:['’][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*"
MAX_SAFE = 9_007_199_254_740_991

# Negation markers.
NEGATIONS_EN = (
    "no not never neither nor without cannot can't don't doesn't didn't isn't aren't wasn't weren't won't "
    "wouldn't shouldn't couldn't mustn't hasn't haven't hadn't"
).split()
NEGATIONS_AR = (
    "لا ليس ليست لم لن بدون ولا فلا ولم فلم ولن فلن وليس فليس وليست فليست لست لسنا لستم لستما لستن ليسا ليستا "
    "ليسوا لسن ولست فلست ولسنا فلسنا ولستم فلستم وليسا فليسا وليسوا فليسوا ولسن فلسن"
).split()

# Languages by script, for the hygiene rules and the model gate.
LATIN_LANGUAGES = "en fr id tr es ms de it nl pt sw ha so sq bs az uz".split()
SCRIPTS = {
    "Latin": "en fr es id tr de it pt nl sw ms".split(),
    "Arabic": "ar ur fa ps".split(),
    "Cyrillic": "ru uk".split(),
}
RTL_LANGUAGES = "ar ur fa he ps sd ug yi dv ku".split()

# Hygiene patterns.
MARKUP = r"(?i)</?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?>|&(?:[a-z]{2,8}|#[0-9]{2,6}|#x[0-9a-f]{2,5});"
HIDDEN = r"[­͏᠎​⁠-⁤﻿￹-￻‪-‮⁦-⁩\x{e0000}-\x{e007f}]"
JOINERS = r"[‌-‏]"
ARABIC_RUN = r"\p{IsArabic}[\p{IsArabic}\p{M}]{2,}"
WORD = r"[\p{L}\p{M}]+"


def ascii_digits(text: Column) -> Column:
    """Arabic-Indic and Eastern Arabic digits as ASCII."""
    return F.translate(text, DIGITS_FROM, DIGITS_TO)


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strict_integer(text: Column) -> Column:
    """The non-negative integer that the text is, digits only; null otherwise or beyond 2**53 - 1."""
    def read(t: Column) -> Column:
        digits = trimmed(ascii_digits(t))
        plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
        value = F.when(digits.rlike("^[0-9]+$") & (F.length(plain) <= 16), plain.try_cast("bigint"))
        return F.when(value <= MAX_SAFE, value)

    # most identifiers are a few plain digits, which need no pattern: as a number they are spelled alike
    number = text.try_cast("bigint")
    few = number.between(0, 10**15 - 1) & (number.cast("string") == text)
    # the patterns stay out of the generated code, which Java wouldn't compile with them: too long a method
    return F.when(few, number).otherwise(F.get(F.transform(F.array(text), read), F.lit(0)))


def merged_range(text: Column) -> Column:
    """struct(first, last) of text like "3-5", with any dash; null otherwise."""
    digits = trimmed(ascii_digits(text))
    pattern = rf"^([0-9]+)[{SPACE}]*[-–—][{SPACE}]*([0-9]+)$"
    first, last = (F.regexp_extract(digits, pattern, k).try_cast("bigint") for k in (1, 2))
    dashed = F.contains(text, F.lit("-")) | F.contains(text, F.lit("–")) | F.contains(text, F.lit("—"))
    return F.when(dashed & digits.rlike(pattern), F.struct(first.alias("first"), last.alias("last")))


def meaningful(text: Column) -> Column:
    """Whether anything is left without format controls and white space; false for null."""
    # stops at the first character that counts
    return F.coalesce(text.rlike(f"[^{FORMAT_CONTROLS[1:-1]}{SPACE}]"), F.lit(False))


def language_base(language: Column) -> Column:
    """The primary language tag; names of two languages are known."""
    low = F.lower(trimmed(F.coalesce(language, F.lit(""))))
    return (
        F.when(low == "english", "en").when(low.isin("arabic", "العربية"), "ar")
        .otherwise(F.regexp_extract(low, "^([^-_]*)", 1))
    )


def text_direction(language: Column) -> Column:
    base = F.regexp_extract(F.lower(trimmed(F.coalesce(language, F.lit("")))), "^([^-_]*)", 1)
    return F.when(base.isin("", "unknown"), "auto").when(base.isin(*RTL_LANGUAGES), "rtl").otherwise("ltr")


def tokens(text: Column) -> Column:
    """Words and numbers as they are written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"))


def token_values(text: Column) -> Column:
    """Tokens for comparison: lower case, straight apostrophes, Arabic without marks.

    Compatibility forms are left as they are; ``functions.udfs.token_values`` folds them.
    """
    text = F.coalesce(text, F.lit(""))
    low = lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'"))

    def value(t: Column) -> Column:
        # a pattern is tried on what isn't ASCII only
        return F.when((F.octet_length(t) > F.length(t)) & low(t).rlike(r"\p{IsArabic}"), F.regexp_replace(low(t), r"[\p{M}ـ]", "")).otherwise(low(t))

    # other letters are small ones by themselves, so the text may be lowered as one; the small form of a sigma depends on what is around it
    one_by_one = (F.octet_length(text) > F.length(text)) & text.rlike(r"[Σ\p{IsArabic}]")
    return F.when(one_by_one, F.transform(tokens(text), value)).otherwise(tokens(low(text)))


def normalised(text: Column) -> Column:
    return F.array_join(token_values(text), " ")


def overlap(a: Column, b: Column) -> Column:
    """Shared over all distinct values of two arrays, 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def negation_count(values: Column, language: str | None) -> Column:
    """Markers among token values; null where the language has none. No language counts as English."""
    markers = NEGATIONS_AR if language == "ar" else NEGATIONS_EN if language in (None, "", "en") else None
    if markers is None:
        return F.lit(None).cast("int")
    return F.size(F.filter(values, lambda v: v.isin(*markers)))


def code_point(character: Column) -> Column:
    """U+XXXX of the first character."""
    code = F.hex(F.encode(character, "UTF-32"))
    digits = F.regexp_replace(code, "^0+", "")
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def _issue(kind: str, matches: Column, describe=None) -> Column:
    shown = F.slice(matches, 1, 5)
    shown = F.array_distinct(F.transform(shown, describe) if describe else shown)
    return F.struct(F.lit(kind).alias("kind"), F.size(matches).alias("count"), shown.alias("examples"))


ISSUES = "array<struct<kind: string, count: int, examples: array<string>>>"


def hygiene(text: Column, language: Column) -> Column:
    """Issues of the characters: array of struct(kind, count, examples), kinds in a fixed order."""
    text = F.coalesce(text, F.lit(""))
    latin = language_base(language).isin(*LATIN_LANGUAGES)

    none = F.array().cast("array<string>")
    # what the other patterns look for lies outside of Latin letters, the soft hyphen apart
    odd = (F.octet_length(text) > F.length(text)) & text.rlike(r"[^\u0000-\u00ac\u00ae-\u024f]")

    marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))

    def every(pattern: str) -> Column:
        return F.when(odd, F.regexp_extract_all(text, F.lit(f"({pattern})"))).otherwise(none)

    mixed = F.filter(every(WORD), lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))

    def strangers(word: Column) -> Column:
        foreign = F.regexp_extract_all(word, F.lit(r"([\p{IsCyrillic}\p{IsGreek}])"))
        return F.array_join(F.transform(foreign, code_point), " ")

    # (?i) inside a group applies to the rest of it
    issues = F.array(
        _issue("markup", F.when(marked, F.regexp_extract_all(text, F.lit(f"({MARKUP})"))).otherwise(none)),
        _issue("hidden_controls", every(HIDDEN), code_point),
        _issue("directional_marks", F.when(latin, every(JOINERS)).otherwise(none), code_point),
        _issue("foreign_script", F.when(latin, every(ARABIC_RUN)).otherwise(none), lambda _: F.lit("Arabic script")),
        _issue("mixed_script_word", mixed, strangers),
    )
    # most texts are clean, and need no list of what they lack
    return F.when(marked | odd, F.filter(issues, lambda i: i["count"] > 0)).otherwise(F.array().cast(ISSUES))


def script_gate(text: Column, language: Column) -> Column:
    """struct(letters, outside, compatible, reason) of a text against its declared language's script.

    Letters count by their script property; letters that several scripts share are outside.
    """
    text = F.coalesce(text, F.lit(""))
    base = language_base(language)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    inside = F.lit(None).cast("int")
    for script, languages in SCRIPTS.items():
        inside = F.when(base.isin(*languages), F.regexp_count(text, F.lit(rf"(?=\p{{L}})\p{{Is{script}}}"))).otherwise(inside)
    outside = letters - inside
    reason = (
        F.when(inside.isNull(), "unsupported_language").when(letters == 0, "no_letter_evidence")
        .when(outside > 0, "letters_outside_declared_script").otherwise("declared_script_only")
    )
    return F.struct(
        letters.alias("letters"), outside.alias("outside"), (reason == "declared_script_only").alias("compatible"), reason.alias("reason")
    )


def raw_diff(before: Column, after: Column) -> Column:
    """struct(prefix, old_text, new_text): what changed between the common ends, in code points."""
    x, y = F.split(before, ""), F.split(after, "")

    def same_start(a: Column, b: Column, n: Column) -> Column:
        differs = F.array_position(F.zip_with(a, b, lambda p, q: ~p.eqNullSafe(q)), F.lit(True))
        return F.when(n == 0, F.lit(0)).otherwise(F.when(differs == 0, n).otherwise(F.least(differs - 1, n))).cast("int")

    shorter = F.least(F.length(before), F.length(after))
    prefix = same_start(x, y, shorter)
    suffix = F.least(same_start(F.reverse(x), F.reverse(y), shorter), shorter - prefix)
    return F.struct(
        prefix.alias("prefix"),
        F.substring(before, prefix + 1, F.length(before) - prefix - suffix).alias("old_text"),
        F.substring(after, prefix + 1, F.length(after) - prefix - suffix).alias("new_text"),
    )


def hidden_characters(text: Column) -> Column:
    """The text's invisible format characters in their order."""
    return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({FORMAT_CONTROLS})")), "")


def csv_cell(value: Column) -> Column:
    """A quoted cell; a formula marker is defused even behind controls, marks and separators."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    formula = r"^[\s\p{Cc}\p{Cf}\p{M}\p{Z}ᅟᅠㅤﾠ]*[=+\-@＝＋－＠−]|^[\t\r\n]"
    safe = F.when(text.rlike(formula), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


#: Classes of invisible characters in the order of the flags.
CONTROL_CLASSES = (
    ("bidi_control", r"[؜‎‏‪-‮⁦-⁩]"),
    ("zero_width", r"[­͏᠎​-‍⁠-⁤﻿￹-￻\x{e0000}-\x{e007f}]"),
    ("control_char", r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f]"),
)


def hidden_control_flags(text: Column) -> Column:
    """For each class of hidden characters its name, an equals sign, and the code points with their counts as they first appear."""
    text = F.coalesce(text, F.lit(""))
    def counted(found: Column) -> Column:
        def one(c: Column) -> Column:
            return F.concat(code_point(c), F.lit(":"), F.size(F.filter(found, lambda x: x == c)).cast("string"))

        return F.array_join(F.transform(F.array_distinct(found), one), ",")

    parts = []
    for name, pattern in CONTROL_CLASSES:
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"))
        parts.append(F.when(F.size(found) > 0, F.concat(F.lit(f"{name}="), counted(found))))
    return F.concat_ws(";", *parts)


def joined_texts(texts: Column, most: int = 30_000) -> Column:
    """Texts of a case's rows in one cell, bounded, with a notice where it was cut."""
    joined = F.array_join(texts, " ‖ ")
    cut = F.concat(F.left(joined, F.lit(most)), F.lit(" … [cut for spreadsheet programs; the report has the whole text]"))
    return F.when((F.size(texts) > 1) & (F.length(joined) > most), cut).otherwise(joined)


def search_form(text: Column) -> Column:
    """Digits folded, vowel marks and tatweel dropped, lower case."""
    return F.lower(F.regexp_replace(ascii_digits(F.coalesce(text, F.lit(""))), r"[ً-ٰٟـ]", ""))


def search_matches(text: Column, query: str) -> Column:
    """Whether the text holds the query; digits at the query's ends match whole numbers only."""
    if not query:
        return F.lit(True)
    pattern = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if query[0] in DIGITS_TO:
        pattern = "(?<![0-9])" + pattern
    if query[-1] in DIGITS_TO:
        pattern += "(?![0-9])"
    return text.rlike(pattern)


# Named entities.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "amp": "&"}


def html_to_text(html: Column) -> Column:
    """The text that a page shows: markup of any kind gives way to a space in one pass, then names of characters are read."""
    hidden = r"<(?<name>script|style|noscript|iframe|object|embed)\b[^>]*+>.*?</\k<name>\s*>"
    out = F.regexp_replace(html, rf"(?is)<!--.*?-->|{hidden}|<[^>]*+>", " ")
    for name, character in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", character)
    return plain(out)


def plain(text: Column) -> Column:
    """Without control characters, white space collapsed."""
    out = F.regexp_replace(text, r"[\u0000-\u0008\u000b\u000c\u000e-\u001f]", "")
    return trimmed(F.regexp_replace(out, f"[{SPACE}]+", " "))


def without_number_prefix(text: Column, group: Column, ordinal: Column) -> Column:
    """The text without its own number in front: (g:n), [g:n], (n) or n. - the first form that is there."""
    g, n = group.cast("string"), ordinal.cast("string")
    forms = [
        F.concat(F.lit(r"^\(\s*"), g, F.lit(r"\s*:\s*"), n, F.lit(r"\s*\)\s*")),
        F.concat(F.lit(r"^\[\s*"), g, F.lit(r"\s*:\s*"), n, F.lit(r"\s*\]\s*")),
        F.concat(F.lit(r"^\("), n, F.lit(r"\)\s*")),
        F.concat(F.lit("^"), n, F.lit(r"\.(?![0-9])\s*")),
    ]
    out = text
    for form in reversed(forms):
        out = F.when(F.rlike(text, form), F.regexp_replace(text, form, F.lit(""))).otherwise(out)
    return out


# What says that an author, publisher or edition isn't known.
UNKNOWN = (
    r"(?i)unknown|not\s+(?:known|provided|declared|supplied)|unavailable|^unchecked$|غير\s+(?:معلوم|معروف|متاح|معلن|موثق)|غير\s+معلنة|مجهول"
)


def known_attribution(text: Column) -> Column:
    """The attribution, or the empty text where it says nothing."""
    value = trimmed(F.coalesce(text, F.lit("")))
    return F.when(value.rlike(UNKNOWN), "").otherwise(value)


def clean_name(text: Column, most: int = 80) -> Column:
    """A name on one line, without controls that could disguise it."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u0000-\u001f\u007f‎‏‪-‮⁦-⁩]", " ")
    return F.left(trimmed(F.regexp_replace(out, f"[{SPACE}]+", " ")), F.lit(most))


def clean_note(text: Column, most: int = 1000) -> Column:
    """A note that keeps its line breaks but no other controls."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\u0000-\u0009\u000b-\u001f\u007f‪-‮⁦-⁩]", " ")
    return F.left(trimmed(out), F.lit(most))


def iso_time(text: Column) -> Column:
    """The timestamp of an ISO-8601 text with a zone; null if it isn't one."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(form), F.try_to_timestamp(text))


# Model failures in the order in which they are told apart.
MODEL_ERRORS = (
    ("integrity", r"WeightIntegrityError"),
    ("corrupt_model", r"(?i)Can't create a session|ERROR_CODE|protobuf|parsing failed|Invalid (?:model|ONNX)|Failed to load model|Deserialize|ModelProto"),
    ("memory", r"(?i)out of memory|Array buffer allocation failed|memory access out of bounds|Cannot allocate|allocation failed|failed to allocate|Invalid typed array length|Aborted\(.*(?:OOM|memory)"),
    ("network", r"(?i)did not honour the Range|Failed to fetch|NetworkError|Load failed|network|ERR_(?:HTTP2|CONNECTION|NETWORK|INTERNET|TIMED)|timed? ?out"),
    ("server", r"(?i)Could not locate file|Unauthorized|Forbidden|Bad gateway|Service unavailable|Gateway timeout|Internal server error|Bad request"),
    ("runtime", r"(?i)wasm|WebAssembly|dynamically imported module|Failed to resolve module|Cross-Origin|import\(\)"),
)


def model_error(message: Column) -> Column:
    """The kind of a model failure; a message in Arabic is the application's own."""
    message = F.coalesce(message, F.lit(""))
    (first, pattern), *others = MODEL_ERRORS
    kind = F.when(message.rlike(pattern), first).when(message.rlike(r"\p{IsArabic}") & ~message.rlike("(?i)ERROR_CODE|protobuf"), "app")
    for name, pattern in others:
        kind = kind.when(message.rlike(pattern), name)
    return kind.otherwise("unknown")


#: Fixed value: the form of a language code, with a region or script at most.
LANGUAGE_CODE = r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})?$"


def is_language(code: str) -> bool:
    import re

    return re.fullmatch(LANGUAGE_CODE, code) is not None


def valid_language(code: Column) -> Column:
    """Whether a text is a language code; null isn't."""
    return F.coalesce(code.rlike(LANGUAGE_CODE), F.lit(False))


def bounded_integer(value: Column, least: int, most: int) -> Column:
    """The whole number of a value of digits only, if it lies within the bounds; null otherwise."""
    text = value.cast("string")
    number = F.try_to_number(text, F.lit("9" * 19)).cast("long")
    return F.when(text.rlike(r"^[0-9]{1,19}$") & number.between(least, most), number)


def counted(n: Column, one: str, many: str) -> Column:
    """A number with its noun, thousands parted."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def date_stamp(time: Column, zone: str) -> Column:
    """The date of a timestamp in a zone, as in file names."""
    return F.date_format(F.from_utc_timestamp(time, zone), "yyyy-MM-dd")


# Letters that are spelled alike, and beginnings that a word loses before it is compared, in the order in which they are tried.
ALIKE_FROM, ALIKE_TO = "أإآٱىةؤئ", "اااايهوي"
STEM_PREFIXES = ("وال", "بال", "فال", "كال", "لل", "ال", "و", "ف", "ب")


def folded(text: Column) -> Column:
    """Lower case, no vowel marks, letters of like spelling made one, signs as single spaces."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\u064B-\u0670\u06D6-\u06ED\u0640]", "")
    return trimmed(F.regexp_replace(F.regexp_replace(F.translate(out, ALIKE_FROM, ALIKE_TO), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def stem(word: Column) -> Column:
    """A word without the first of the known beginnings that leaves three letters."""
    return F.regexp_replace(word, rf"^(?:{'|'.join(STEM_PREFIXES)})(?=.{{3}})", "")
