"""Line dedup by a tree of line templates, with DataFrame functions only.

A line's fields that hold a digit are variable and read <*>. The tree has a fixed depth:
the number of tokens, then the first ``DEPTH`` tokens; lines of one leaf are alike in both.
Within a leaf, lines that agree in at least ``SIMILARITY`` of their tokens share a template
whose other tokens are variable, and so do lines linked by a chain of such lines. All lines
of a leaf of up to ``BLOCK`` distinct ones are compared. In a larger leaf, the tokens behind
the leading ones are cut into so many pieces that two such lines must agree in one piece at
least. The lines of a piece are compared with its first line; then those outside the piece's
largest group of linked lines are compared with all lines of the piece that they aren't
linked to. Where more than ``BLOCK`` lines are outside, the piece is cut again by the tokens
in which its lines differ, until none is left; no line is passed over.

A template found in at least ``MIN_DOCS`` documents is recurring. Its lines stay in the
document with the smallest id, and are dropped elsewhere. Lines of fewer than
``MIN_TOKENS`` tokens are too short to merge with unlike ones: their fields aren't
variable, and they recur only where they are equal but for spacing. In scripts without
spaces each character is a token. Blank lines and repeats within one document stay.

Every step is a hash join or a partial aggregation on narrow rows of hashes; texts move
once, to meet the places of their dropped lines. Null and empty texts, and rows without an
id, pass unchanged; a null text stays null. Repeated rows are treated alike: an id counts
as one document. An empty table gives none. Other columns pass through ``dedup``
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, beside, checkpointed, columns_of, components, table, written

DEPTH = 3
SIMILARITY = 0.8
MIN_TOKENS = 4
MIN_DOCS = 2
#: Lines of a piece outside its largest group that are compared with all lines of it; with more, the piece is cut again.
BLOCK = 64

_FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
# The blocks of scripts that put no spaces between words (Thai to Myanmar, Khmer, kana, bopomofo, Han).
_UNSPACED = (
    r"\u0E01-\u0E7F\u0E80-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u17FF\u19E0-\u19FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u30FF"
    r"\u3105-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFF66-\uFF9F\x{1B000}-\x{1B2FF}\x{20000}-\x{3FFFF}"
)


def _masked(line: Column) -> Column:
    """The line with single spaces between tokens, and variable fields as <*> if it is long enough.

    One search tells the lines that need no replacement, which are most.
    """
    plain = F.trim(line)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(line, f"[{_UNSPACED}]", " $0 "), r"\s+", " "))
    long = spaced.rlike(rf"^(?:\S+ ){{{MIN_TOKENS - 1}}}\S")
    full = F.when(long, F.regexp_replace(spaced, _FIELD, "<*>")).otherwise(spaced)
    return F.when(plain.rlike(rf"[0-9\t\x0B\f\r{_UNSPACED}]|  "), full).otherwise(plain)


def _key(of: str) -> Column:
    return F.xxhash64(F.col(of)).alias("__k")


def _exploded(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, __k, pos, m, leaf): the masked lines that can recur, and the leaf of the tree that they reach.

    Lines too short to merge with unlike ones have no leaf.
    """
    one = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", _key("text"))
    # masked within the array: a filter on an exploded column isn't evaluated twice
    one = one.select("doc_id", "__k", F.posexplode(F.transform(F.split("text", "\n"), _masked)).alias("pos", "m"))
    spaces = F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit("")))
    one = one.withColumn("n", spaces + 1).where("m <> ''")
    leaf = F.when(F.col("n") >= MIN_TOKENS, F.xxhash64("n", F.substring_index("m", " ", DEPTH))).alias("leaf")
    return one.select("doc_id", "__k", "pos", "m", leaf)


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("m").alias("h1"), F.xxhash64(F.lit("line"), "m").alias("h2")


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, __k, pos, h1, h2, leaf): the lines that can recur, as hashes."""
    return _exploded(docs).select("doc_id", "__k", "pos", *_hashes(), "leaf")


def _mixed(lines: DataFrame) -> DataFrame:
    """Rows (leaf, h1, h2, doc_id, __k, pos): the distinct lines of leaves with more than one, and a place of each."""
    # any place will do: they have one text
    place = [F.first(c).alias(c) for c in ("doc_id", "__k", "pos")]
    kinds = lines.where("leaf IS NOT NULL").groupBy("leaf", "h1", "h2").agg(*place)
    mixed = kinds.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    return kinds.join(mixed, "leaf", "left_semi")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (leaf, h1, h2, m) of ``wanted``: places meet their texts."""
    places = wanted.groupBy("doc_id", "__k").agg(F.collect_list(F.struct("pos", "leaf", "h1", "h2")).alias("places"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", _key("text"))
    found = texts.join(places, ["doc_id", "__k"])
    # the lines as an array first, so that each place takes its line without another split
    found = found.select(F.split("text", "\n").alias("all"), "places").select("all", F.explode("places").alias("p"))
    found = found.select("p.leaf", "p.h1", "p.h2", _masked(F.get("all", F.col("p.pos"))).alias("m"))
    return found.dropDuplicates(["h1", "h2"])


def _differing(n: Column) -> Column:
    """In how many of n tokens lines of one template may differ."""
    return F.floor(n * (1 - SIMILARITY) + 1e-9).cast("int")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (part, id): ``rows`` (part, id, tokens, open) by each piece of the open places; alike lines meet in one part."""
    most, of = _differing(F.size("tokens")), F.size("open")
    start = lambda i: F.floor(i * of / (most + 1)).cast("int")

    def key(i: Column) -> Column:
        piece = F.slice("open", start(i) + 1, start(i + 1) - start(i))
        return F.xxhash64("part", i, F.transform(piece, lambda p: F.get("tokens", p)))

    return rows.select(F.explode(F.transform(F.sequence(F.lit(0), most), key)).alias("part"), "id")


def _agree(a: str, b: str) -> Column:
    """Whether two lines of a leaf agree in enough tokens."""
    ours, theirs = F.split(a, " "), F.split(b, " ")
    same = F.size(F.filter(F.zip_with(ours, theirs, lambda x, y: x == y), lambda z: z))
    return same >= F.size(ours) * SIMILARITY - 1e-9


def _alike(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose lines agree in enough tokens."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(found.select(F.col("id").alias("a"), "m"), "a").join(found.select(F.col("id").alias("b"), F.col("m").alias("other")), "b")
    return both.where(_agree("m", "other")).select("a", "b")


def _open(large: DataFrame) -> DataFrame:
    """Rows (part, id, tokens, open) of ``large`` (part, id, tokens): the places in which lines of a part differ."""
    each = large.select("part", F.posexplode("tokens").alias("at", "token"))
    each = each.groupBy("part", "at").agg(F.min("token").alias("a"), F.max("token").alias("z")).where("a <> z")
    return large.join(each.groupBy("part").agg(F.sort_array(F.collect_list("at")).alias("open")), "part")


def _large_links(large: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) within ``large`` (part, id): leaves with more lines than are compared with each other."""
    tokens = F.split("m", " ")
    able = large.join(found.select("id", tokens.alias("tokens")), "id")
    parts = _cut(able.select("part", "id", "tokens", F.sequence(F.lit(DEPTH), F.size("tokens") - 1).alias("open")))
    links = None
    while True:
        first = parts.groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
        parts = written(parts.join(first.select("part", "first"), "part"), "parts")
        near = _alike(parts.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")), found)
        links = written(near if links is None else links.unionByName(near), "links")
        named = parts.join(components(links), "id", "left").select("part", "id", F.coalesce("component", "id").alias("kin"))
        sizes = named.groupBy("part", "kin").agg(F.count("*").alias("n")).groupBy("part")
        sizes = sizes.agg(F.count("*").alias("kins"), F.sum("n").alias("all"), F.max(F.struct("n", "kin")).alias("top")).where("kins > 1")
        sizes = sizes.select("part", F.col("top.kin").alias("most"), (F.col("all") - F.col("top.n") <= BLOCK).alias("few"))
        open_ = written(named.join(sizes, "part"), "open")
        outside = open_.where("few AND kin <> most").select("part", F.col("id").alias("a"), F.col("kin").alias("akin"))
        inside = open_.where("few").select("part", F.col("id").alias("b"), F.col("kin").alias("bkin"))
        links = written(links.unionByName(_alike(outside.join(inside, "part").where("akin <> bkin"), found)), "links")
        rest = open_.where("NOT few").select("part", "id")
        if rest.isEmpty():
            return links
        parts = _cut(_open(rest.join(found.select("id", tokens.alias("tokens")), "id")))


def _merged(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (h1, h2, t1, t2): distinct lines that take another line's template."""
    found = written(_texts_of(docs, _mixed(lines)).withColumn("id", F.monotonically_increasing_id()), "mixed")
    # lines of four tokens or fewer differ in none, so distinct ones aren't alike
    able = found.where(_differing(F.size(F.split("m", " "))) > 0)
    sizes = written(able.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "leaves")
    few = able.join(sizes.where(F.col("n") <= BLOCK).select("leaf"), "leaf")
    other = few.select("leaf", F.col("id").alias("b"), F.col("m").alias("other"))
    links = few.select("leaf", F.col("id").alias("a"), "m").join(other, "leaf").where("a < b").where(_agree("m", "other")).select("a", "b")
    large = able.join(sizes.where(F.col("n") > BLOCK).select("leaf"), "leaf").select(F.col("leaf").alias("part"), "id")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, found))
    kin = components(links).where("id <> component")
    named = found.select("id", "h1", "h2")
    theirs = found.select(F.col("id").alias("component"), F.col("h1").alias("t1"), F.col("h2").alias("t2"))
    return kin.join(named, "id").join(theirs, "component").select("h1", "h2", "t1", "t2")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (doc_id, __k, dropped): the places of each text's lines to drop, ascending."""
    first = Written(_lines(docs), "lines")
    lines = first.df.join(written(_merged(docs, first.df), "merged"), ["h1", "h2"], "left").select(
        "doc_id", "__k", "pos", F.coalesce("t1", "h1").alias("t1"), F.coalesce("t2", "h2").alias("t2")
    )
    if min_docs == 2:  # two documents are there if the smallest isn't the largest
        often = lines.groupBy("t1", "t2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner <> last")
    else:
        by_doc = lines.groupBy("t1", "t2", "doc_id").agg(F.lit(1).alias("one"))
        often = by_doc.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where(F.col("n") >= min_docs)
    # a table of its own, so that adaptive execution can split a template that very many lines have
    often = checkpointed(often.select("t1", "t2", "owner"))
    gone = lines.join(often, ["t1", "t2"]).where("doc_id <> owner").select("doc_id", "__k", "pos")
    return gone.groupBy("doc_id", "__k").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _without(docs: DataFrame, min_docs: int) -> DataFrame:
    """Rows (row, dropped): ``docs`` as structs, and the places of the lines to drop, null if none."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_docs).select(F.col("doc_id").alias("id"), F.col("__k").alias("key"), "dropped")
    rows = docs.select(beside(docs).alias("row"))
    return rows.join(gone, (F.col("row.doc_id") == F.col("id")) & (F.xxhash64("row.text") == F.col("key")), "left").select("row", "dropped")


def _rest() -> Column:
    """The text without the dropped lines; flags in line order make that one pass."""
    flags = F.transform(
        "dropped",
        lambda at, i: F.concat(F.repeat(F.lit("0"), (at - F.coalesce(F.get("dropped", i - 1), F.lit(-1)) - 1).cast("int")), F.lit("1")),
    )
    flags = F.split(F.array_join(flags, ""), "")
    kept = F.zip_with(F.split("row.text", "\n"), flags, lambda line, flag: F.when(flag == "1", F.lit(None)).otherwise(line))
    return F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, drop_empty: bool = False) -> DataFrame:
    """The rows of ``docs`` with recurring lines dropped from their texts.

    With ``drop_empty``, rows that lose all they had (nothing but white space is left of
    a text with dropped lines) go.
    """
    out = _without(docs, min_docs).select("row", "dropped", _rest().alias("rest"))
    if drop_empty:
        out = out.where("dropped IS NULL OR rest RLIKE '\\\\S'")
    return out.select(*columns_of("row", docs, text=F.col("rest")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted and its text without recurring lines."""
    out = _without(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_DOCS)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), _rest().alias("text"),
    )
