"""Queries on readings, landed references, findings, manifests, teams and benchmarks; each over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import baseline, findings, index, manifest, review, revision, semantic, structure, team
from ..operators.index import dealt
from ..operators.ranks import ranked
from ..sources import files, reference, samples
from ..sources.matrix import MAX_ROWS
from .shipping import ship
from .tables import line_tasks, lines_as_rows, order_index, order_sizes, table, turns_as_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _one_of(key: str, *cases):
    """The case of a row, by the remainder of its key."""
    out = None
    for i, case in enumerate(cases):
        hit, value = F.col(key) % len(cases) == i, F.lit(case) if isinstance(case, str | int | type(None)) else case
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _sql_one_of(key: str, *cases: str) -> str:
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


# --- readings of identifiers, texts and cells --------------------------------------------------


def _arabic(c):
    return F.translate(c, "0123456789", "٠١٢٣٤٥٦٧٨٩")


@query(f"SELECT o_orderkey, {_sql_one_of('o_orderkey', 'o_custkey', 'o_custkey', 'o_custkey', 'NULL', 'NULL', 'NULL')}::BIGINT AS value FROM orders")
def strict_integer_ids(spark, d):
    """Order numbers as written: plain, in other digits, with zeros and spaces, and in forms that are no identifier."""
    n = F.col("o_custkey").cast("string")
    raw = _one_of("o_orderkey", n, _arabic(n), F.concat(F.lit("  00"), n, F.lit(" ")), F.concat(n, F.lit(".5")), F.concat(F.lit("-"), n), F.concat(F.lit("n"), n))
    return table(spark, d, "orders").select("o_orderkey", T.strict_integer(raw).alias("value"))


@query(f"SELECT p_partkey, {_sql_one_of('p_partkey', 'p_size', 'p_size', 'p_size', 'NULL', 'NULL')}::BIGINT AS first, {_sql_one_of('p_partkey', 'p_size + 2', 'p_size + 2', 'p_size + 2', 'NULL', 'NULL')}::BIGINT AS last FROM part")
def merged_ranges(spark, d):
    a, b = F.col("p_size").cast("string"), (F.col("p_size") + 2).cast("string")
    raw = _one_of("p_partkey", F.concat_ws("-", a, b), F.concat_ws(" – ", _arabic(a), _arabic(b)), F.concat_ws("—", a, b), a, F.concat_ws("-", F.lit("x"), b))
    return table(spark, d, "part").select("p_partkey", T.merged_range(raw).alias("r")).select("p_partkey", "r.first", "r.last")


@query(f"""SELECT kind, count(*)::BIGINT AS rows FROM (SELECT {_sql_one_of('doc_id', "'markup'", "'hidden_controls'", "'directional_marks'", "'foreign_script'", "'mixed_script_word'", 'NULL')} AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY 1""")
def hygiene_kinds(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("number "), F.col("doc_id").cast("string"), F.lit(" "), _one_of("doc_id", "<b>x</b>", "a​b", "a‎b", "see سلام here", "pаy", "clean")).alias("text"))
    return rows.select(F.explode(T.hygiene(F.col("text"), F.lit("en"))).alias("i")).groupBy("i.kind").agg(F.count("*").alias("rows"))


@query(f"SELECT c_custkey, {_sql_one_of('c_custkey', 'c_name', 'c_name', 'c_name', 'c_custkey || chr(46) || 5 || chr(32) || c_name', 'c_custkey + 1 || chr(46) || chr(32) || c_name', 'c_name')} AS text FROM customer")
def strip_prefix(spark, d):
    """Names behind their own number in each of its forms; a decimal number and another row's number stay."""
    n, name = F.col("c_custkey").cast("string"), F.col("c_name")
    body = _one_of("c_custkey", F.concat(F.lit("(7:"), n, F.lit(") "), name), F.concat(F.lit("[7 : "), n, F.lit("] "), name), F.concat(n, F.lit(". "), name),
                   F.concat(n, F.lit(".5 "), name), F.concat((F.col("c_custkey") + 1).cast("string"), F.lit(". "), name), F.concat(F.lit("("), n, F.lit(") "), name))
    return table(spark, d, "customer").select("c_custkey", T.without_number_prefix(body, F.lit(7), F.col("c_custkey")).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '^2 of ' || p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || ' & more' ELSE p_size || '.' END AS text,
  CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS anchors_removed, CASE WHEN p_partkey % 4 = 1 THEN 'see ' || p_brand ELSE '' END AS notes, p_partkey % 4 = 3 AS kept_as_sent FROM part""")
def numbered_bodies(spark, d):
    """Parts as numbered HTML: powers, note marks, note blocks, names of characters, and bodies of a number only."""
    from ..functions.udfs import numbered_body

    ship(spark)
    n, name = F.col("p_size").cast("string"), F.col("p_name")
    html = _one_of(
        "p_partkey", F.concat(F.lit("<p>(7:"), n, F.lit(") "), n, F.lit("<sup>2</sup> of <b>"), name, F.lit("</b><sup>*</sup></p>")),
        F.concat(n, F.lit(". "), name, F.lit("<sup>1</sup><div class='footnotes'>see "), F.col("p_brand"), F.lit("</div>")),
        F.concat(name, F.lit(" &amp; <script>x()</script>more")), F.concat(n, F.lit(".")),
    )
    out = table(spark, d, "part").withColumn("b", numbered_body(html, F.lit(7), F.col("p_size")))
    return out.select("p_partkey", "b.text", "b.anchors_removed", F.array_join("b.notes", "|").alias("notes"), "b.kept_as_sent")


@query(f"""SELECT p_partkey, '"' || {_sql_one_of('p_partkey', "'''=' || p_name", 'p_name', "'say ' || chr(34) || chr(34) || p_name || chr(34) || chr(34)", "'''-' || p_size", "''", "'''  @' || p_name")} || '"' AS cell FROM part""")
def csv_safe_cells(spark, d):
    name = F.col("p_name")
    value = _one_of("p_partkey", F.concat(F.lit("="), name), name, F.concat(F.lit('say "'), name, F.lit('"')), F.concat(F.lit("-"), F.col("p_size").cast("string")), F.lit(None).cast("string"), F.concat(F.lit("  @"), name))
    return table(spark, d, "part").select("p_partkey", T.csv_cell(value).alias("cell"))


@query(f"""SELECT flags, count(*)::BIGINT AS rows FROM (SELECT {_sql_one_of('p_partkey', "'bidi_control=U+202E:2;zero_width=U+200B:1'", "''", "'control_char=U+0007:1'")} AS flags FROM part) GROUP BY 1""")
def hidden_control_flags(spark, d):
    value = F.concat("p_name", _one_of("p_partkey", "a‮b​c‮", "clean", "bell\x07"))
    return table(spark, d, "part").groupBy(T.hidden_control_flags(value).alias("flags")).agg(F.count("*").alias("rows"))


@query(f"""SELECT kind, count(*)::BIGINT AS rows FROM (SELECT {_sql_one_of('event_id', "'memory'", "'network'", "'corrupt_model'", "'unknown'", "'integrity'", "'server'", "'runtime'")} AS kind FROM events) GROUP BY 1""")
def model_errors(spark, d):
    told = _one_of("event_id", "RangeError: Array buffer allocation failed", "TypeError: Failed to fetch", "INVALID_PROTOBUF: parsing failed", "odd", "WeightIntegrityError: hash", "502 Bad gateway", "no wasm here")
    events = table(spark, d, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(": "), told).alias("message"))
    return events.groupBy(T.model_error(F.col("message")).alias("kind")).agg(F.count("*").alias("rows"))


@query(r"""SELECT page_id, regexp_extract(url, '^https://[a-z.]+example\.org(/[^?#\s]*)$', 1) AS path FROM pages WHERE regexp_full_match(url, 'https://[a-z.]*example\.org(/[^?#\s]*)')""")
def official_urls(spark, d):
    """Paths of the URLs that are official for their own host, which must lie in one domain."""
    pages = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([a-z.]+example\.org)/", 1)).where("host <> ''")
    return pages.select("page_id", review.official_url(F.col("url"), F.col("host")).alias("path")).where("path IS NOT NULL")


@query("SELECT page_id, regexp_matches(lang, '^[a-z]{2,3}(-[a-z0-9]{2,8})?$') AS valid, CASE WHEN page_id BETWEEN 10 AND 99 THEN page_id END AS bounded FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'pt-br' WHEN 2 THEN 'EN' ELSE 'english' END AS lang FROM pages)")
def codes_and_bounds(spark, d):
    pages = table(spark, d, "pages").select("page_id", _one_of("page_id", "en", "pt-br", "EN", "english").alias("lang"))
    return pages.select("page_id", T.valid_language(F.col("lang")).alias("valid"), T.bounded_integer(F.col("page_id"), 10, 99).alias("bounded"))


# --- quantities and qualifiers ---------------------------------------------------------------


@query(f"""SELECT state, reasons, count(*)::BIGINT AS rows FROM (SELECT {_sql_one_of('p_partkey', "'equivalent'", "'difference'", "'abstain'", "'unchanged'", "'none'")} AS state,
  CASE WHEN p_partkey % 5 = 2 THEN 'approximate_quantity_not_exact' ELSE '' END AS reasons FROM part) GROUP BY 1, 2""")
def numeric_inventory(spark, d):
    """Sizes of parts in kilograms and grams: equal after conversion, one more, approximate, unchanged, none."""
    from ..functions.udfs import quantity_review

    ship(spark)
    n = F.col("p_size")
    said = lambda x, unit: F.concat(F.lit("It weighs "), x.cast("string"), F.lit(f" {unit}"))
    text = _one_of("p_partkey", said(n, "kg"), said(n, "kg"), F.concat(F.lit("about "), n.cast("string"), F.lit(" kg")), said(n, "kg"), "It has no weight")
    other = _one_of("p_partkey", said(n * 1000, "g"), said(n + 1, "kg"), said(n + 1, "kg"), F.concat(said(n, "kg"), F.lit(" in all")), "It has none")
    rows = table(spark, d, "part").withColumn("q", quantity_review(text, other, F.lit("en")))
    return rows.groupBy("q.state", F.array_join(F.array_distinct("q.reasons.reason"), ",").alias("reasons")).agg(F.count("*").alias("rows"))


@query(f"""SELECT state, reasons, count(*)::BIGINT AS rows FROM (SELECT {_sql_one_of('p_partkey', "'difference'", "'equivalent'", "'abstain'", "'unchanged'", "'none'")} AS state,
  CASE WHEN p_partkey % 5 = 2 THEN 'negated_marker_scope_not_supported' ELSE '' END AS reasons FROM part) GROUP BY 1, 2""")
def qualifier_inventory(spark, d):
    from ..functions.udfs import qualifier_review

    ship(spark)
    brand = F.concat(F.lit(" "), F.col("p_brand"))
    text = F.concat(_one_of("p_partkey", "all must go", "it is not permitted", "not all go", "same all", "plain"), brand)
    other = F.concat(_one_of("p_partkey", "some must go", "it is forbidden", "all go", "same all", "text"), brand)
    rows = table(spark, d, "part").withColumn("q", qualifier_review(text, other, F.lit("en")))
    return rows.groupBy("q.state", F.array_join(F.array_distinct("q.reasons.reason"), ",").alias("reasons")).agg(F.count("*").alias("rows"))


@query("SELECT p_partkey, 3 AS candidate, 2 AS reference, 'difference' AS state FROM part")
def digit_quantities(spark, d):
    """Three numbers against two of them, read by the inventory."""
    from ..functions.udfs import quantity_review

    ship(spark)
    a, b, c = (F.format_string("%d", F.col("p_size") + k) for k in (0, 60, 600))
    text = F.concat(a, F.lit(" men, "), b, F.lit(" women and "), c, F.lit(" boys"))
    rows = table(spark, d, "part").withColumn("q", quantity_review(text, F.concat(a, F.lit(" men and "), b, F.lit(" women")), F.lit("en")))
    return rows.select("p_partkey", F.size("q.candidate").alias("candidate"), F.size("q.reference").alias("reference"), "q.state")


# --- structure --------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS first_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY lower(text) HAVING count(*) > 1")
def exact_copies(spark, d):
    """Documents with one normal form, as the identifiers that several rows claim."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    rows = docs.select(F.lit("d").alias("file_id"), F.lower("text").alias("id"), F.lit(True).alias("valid"), F.lit(1).alias("grp"), F.lit(1).alias("ord"), F.col("doc_id").alias("input_index"), F.col("doc_id").alias("row_number"), "text")
    return structure.duplicates(rows).select(F.col("places")[0]["row_number"].alias("first_id"), F.col("occurrences").alias("copies"))


@query("""WITH r AS (SELECT o_custkey AS grp, o_orderkey AS first, o_orderkey + o_orderkey % 40 - 1 AS last FROM orders), s AS (SELECT *, lag(last) OVER (PARTITION BY grp ORDER BY first, last) AS before FROM r)
  SELECT grp, first, CASE WHEN grp < 1 OR first < 1 OR last < first THEN 'invalid' ELSE 'overlapping' END AS reason FROM s WHERE grp < 1 OR first < 1 OR last < first OR first <= before""")
def scope_intervals(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + F.col("o_orderkey") % 40 - 1).alias("last"))
    return revision.scope_problem(rows).select("grp", "first", "reason")


@query("""SELECT l_orderkey AS file_id, count(DISTINCT l_linenumber)::BIGINT AS ids, 1::BIGINT AS groups FROM lineitem GROUP BY 1""")
def groups_and_ids(spark, d):
    return findings.groups_and_ids(structure.keyed(lines_as_rows(spark, d), index.numbering(order_sizes(spark, d)), many=line_tasks(spark, d)), ["file_id"])


_GAPS = """WITH idx AS (SELECT l_orderkey AS grp, max(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1), gone AS (SELECT grp, ord FROM (SELECT grp, unnest(range(1, n + 1)) AS ord FROM idx)
  ANTI JOIN (SELECT DISTINCT l_orderkey AS grp, l_linenumber::BIGINT AS ord FROM lineitem) USING (grp, ord))"""


@query(_GAPS + """, r AS (SELECT grp, ord, row_number() OVER (PARTITION BY grp ORDER BY ord) AS k, count(*) OVER (PARTITION BY grp) AS total FROM gone)
  SELECT grp AS file_id, string_agg(grp || ':' || ord, ',' ORDER BY ord) FILTER (k <= 2) AS shown, max(total)::BIGINT AS total, greatest(max(total) - 2, 0)::BIGINT AS hidden FROM r GROUP BY grp""")
def missing_preview(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("ord"))
    gone = structure.missing_in_groups(have, order_index(spark, d), line_tasks(spark, d)).withColumn("file_id", F.col("grp"))
    return findings.preview(gone, ["file_id"], 2).select("file_id", F.array_join("shown", ",").alias("shown"), "total", "hidden")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN '' ELSE l_returnflag END AS text, l_linenumber <= 4 AS valid FROM lineitem)
  SELECT 'invalid' AS kind, count(*)::BIGINT AS rows, count(*)::BIGINT AS occurrences FROM r WHERE NOT valid UNION ALL SELECT 'empty', count(*)::BIGINT, count(*)::BIGINT FROM r WHERE valid AND text = ''
  UNION ALL SELECT 'duplicate', count(*)::BIGINT, sum(n)::BIGINT FROM (SELECT count(*) AS n FROM r WHERE valid GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def reference_defects(spark, d):
    sizes = index.numbering(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.lit(4).alias("n")).distinct())
    lines = table(spark, d, "lineitem")
    rows = lines.select(F.lit("f").alias("file_id"), F.monotonically_increasing_id().alias("input_index"), F.monotonically_increasing_id().alias("row_number"), F.col("l_orderkey").cast("string").alias("group_raw"),
                        F.col("l_linenumber").cast("string").alias("ordinal_raw"), F.when(F.col("l_quantity") < 3, "").otherwise(F.col("l_returnflag")).alias("text"))
    out = findings.reference_defects(structure.keyed(rows, sizes))
    return out.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("occurrences").alias("occurrences"))


# --- findings as a reader sees them ------------------------------------------------------------


def _findings(spark, d):
    """Order lines as findings: the flag is the code, the status the type, the quantity the severity."""
    lines = table(spark, d, "lineitem")
    severity = F.when(F.col("l_quantity") > 45, "critical").when(F.col("l_quantity") > 35, "high").when(F.col("l_quantity") > 25, "medium").when(F.col("l_quantity") > 10, "low").otherwise("info")
    return lines.select(
        F.col("l_suppkey").alias("file_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("finding_id"), F.lit(0).alias("phase"), F.col("l_orderkey").alias("input_index"),
        F.col("l_returnflag").alias("code"), F.when(F.col("l_linestatus") == "O", "structural").otherwise("evidence").alias("type"), severity.alias("severity"),
        F.array("l_orderkey").alias("row_numbers"), F.when(F.col("l_linenumber") > 1, F.array(F.concat_ws(":", "l_partkey", "l_linenumber"))).otherwise(F.array().cast("array<string>")).alias("ids"),
        F.col("l_suppkey").alias("evidence_group"), F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "N", "refer").alias("decision"),
    )


@query("""WITH f AS (SELECT CASE WHEN l_linenumber > 1 AND l_partkey <> 0 THEN l_partkey ELSE l_suppkey END AS g FROM lineitem WHERE l_linestatus = 'O')
  SELECT CASE WHEN g BETWEEN 1 AND 1000 THEN g ELSE 0 END AS grp, count(*)::BIGINT AS cases FROM f GROUP BY 1""")
def team_cases(spark, d):
    return findings.cases(_findings(spark, d), 1000).groupBy("grp").agg(F.count("*").alias("cases"))


@query("""SELECT l_suppkey AS file_id, count(*)::BIGINT AS rows FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 35 AND l_returnflag <> 'A' GROUP BY 1""")
def filtered_findings(spark, d):
    """Grave structural findings that nobody settled."""
    return findings.filtered(_findings(spark, d), type_="structural", band="high", unresolved=True).groupBy("file_id").agg(F.count("*").alias("rows"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 12 OR l_suppkey = 12 OR (l_linenumber > 1 AND l_partkey = 12)""")
def searched_findings(spark, d):
    """A number finds rows, groups and identifiers of that number, not those that contain it."""
    out = findings.filtered(_findings(spark, d).withColumn("finding_id", F.lit("")), query="12")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    found = out.select(F.col("input_index").alias("l_orderkey"), F.col("file_id").alias("l_suppkey"), F.coalesce(F.try_element_at("ids", F.lit(1)), F.lit("")).alias("id")).distinct()
    match = F.when(F.col("l_linenumber") > 1, F.concat_ws(":", "l_partkey", "l_linenumber")).otherwise("")
    return lines.withColumn("id", match).join(found, ["l_orderkey", "l_suppkey", "id"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH f AS (SELECT l_suppkey AS file_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_shipdate) AS finding_id, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY
      CASE WHEN l_quantity > 45 THEN 0 WHEN l_quantity > 35 THEN 1 WHEN l_quantity > 25 THEN 2 WHEN l_quantity > 10 THEN 3 ELSE 4 END, l_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_shipdate)) AS k FROM lineitem)
  SELECT file_id, finding_id, k::BIGINT AS place, ceil(n / 20.0)::BIGINT AS pages FROM f WHERE k BETWEEN 21 AND 40""")
def findings_page(spark, d):
    """The second page of each file: which findings are on it, and in which place."""
    return findings.page(_findings(spark, d), 2, many=line_tasks(spark, d)).select("file_id", "finding_id", F.col("place").cast("long").alias("place"), "pages")


@query("""WITH e AS (SELECT user_id, event_id, max(greatest(0, least(99, floor(value)))) OVER w AS p, bool_or(event_type = 'purchase') OVER w AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT user_id, event_id, (CASE WHEN done THEN 100 ELSE p END)::INTEGER AS shown FROM e""")
def monotonic_progress(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("percent"), (F.col("event_type") == "purchase").alias("done"))
    return findings.monotonic_progress(events, ["user_id"], "event_id").select("user_id", "event_id", "shown")


# --- landed references -------------------------------------------------------------------------


@query("""WITH b AS (SELECT p_partkey, p_partkey % 500 + 1 AS book, p_name FROM part WHERE p_partkey % 3 = 0) SELECT book, arg_min(p_name, p_partkey) AS title FROM b GROUP BY book""")
def reference_catalog(spark, d):
    """Parts as a catalog of books: those of the language, once each, titles without markup."""
    part = table(spark, d, "part")
    catalog = part.select(F.col("p_partkey").alias("place"), (F.col("p_partkey") % 500 + 1).cast("string").alias("id"), _one_of("p_partkey", "en", "fr", "ar").alias("language"),
                          F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("name"), F.lit(" ").alias("short_name"), F.lit(None).cast("string").alias("card"))
    return reference.listed_books(catalog, "en").select("book", "title")


@query("""SELECT p_partkey AS book, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS author, p_type AS publisher FROM part WHERE p_partkey = 7""")
def reference_metadata(spark, d):
    part = table(spark, d, "part")
    records = part.select(F.col("p_partkey").alias("id"), F.lit("en").alias("language"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("not known").alias("author"),
                          F.lit("").alias("translator"), F.col("p_type").alias("publisher"), F.lit(None).cast("string").alias("edition"), F.lit(2020).alias("year"))
    return reference.book_metadata(records, 7, "en").select("book", "author", "publisher")


def _landed(spark, d):
    """Conversations as landed texts: turns are numbered HTML passages of their group; every fifth group was never fetched."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL AND conv_id % 5 <> 4")
    html = F.concat((F.col("turn") + 1).cast("string"), F.lit(". said by "), F.coalesce("role", F.lit("nobody")), F.lit("<sup>1</sup>"))
    return turns.select((F.col("conv_id") + 1).alias("grp"), (F.col("turn") + 1).alias("ord"), html.alias("html"), F.lit("https://api.example.org/v1/translation/7").alias("source_url"), F.lit("2026-01-02T03:04:05Z").alias("retrieved_at"))


def _turn_sizes(spark, d):
    turns = table(spark, d, "conversations")
    return index.numbering(turns.groupBy((F.col("conv_id") + 1).alias("grp")).agg((F.max("turn") + 1).alias("n")))


_WANTED = "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), l AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE text IS NOT NULL AND conv_id % 5 <> 4)"


@query(_WANTED + """ SELECT t.conv_id + 1 AS grp, count(*)::BIGINT AS requested, count(l.turn)::BIGINT AS covered, (count(*) - count(l.turn))::BIGINT AS missing, count(l.turn) < count(*) AS partial,
  count(l.turn)::BIGINT AS prefix_rows, count(l.turn)::BIGINT AS anchors_removed FROM t LEFT JOIN l ON t.conv_id = l.conv_id AND t.turn = l.turn GROUP BY 1""")
def reference_lookup(spark, d):
    """Requested identifiers (twice, the last row counts) against what is landed, with what the reading removed."""
    from ..functions.udfs import numbered_body

    ship(spark)
    rows = turns_as_rows(spark, d)
    rows = rows.unionByName(rows.withColumn("row_number", F.col("row_number") + 1_000_000))
    wanted, _ = reference.requested(rows, _turn_sizes(spark, d))
    found = reference.looked_up(wanted, _landed(spark, d).dropDuplicates(["grp", "ord"]), numbered_body("html", "grp", "ord"))
    return reference.coverage(found, ["grp"]).drop("kept_as_sent")


@query("""SELECT conv_id + 1 AS grp, CASE WHEN count(*) > 286 THEN 'too_many_rows' WHEN max(n) > 1 THEN 'repeated_identifier' END AS fault FROM (SELECT conv_id, turn, count(*) AS n FROM conversations WHERE text IS NOT NULL AND conv_id % 5 <> 4 GROUP BY 1, 2) GROUP BY 1""")
def reference_answers(spark, d):
    return reference.sound_groups(_landed(spark, d), 286).select("grp", "fault")


@query("""SELECT l_orderkey, l_linenumber::VARCHAR AS ordinal_raw, count(*)::BIGINT AS rows FROM lineitem WHERE l_linenumber > 4 GROUP BY 1, 2""")
def skipped_requests(spark, d):
    sizes = index.numbering(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.lit(4).alias("n")).distinct())
    _, skipped = reference.requested(lines_as_rows(spark, d), sizes)
    return skipped.groupBy(F.col("group_raw").cast("long").alias("l_orderkey"), "ordinal_raw").agg(F.count("*").alias("rows"))


@query("""WITH t AS (SELECT conv_id + 1 AS grp, turn + 1 AS ord, role FROM conversations), g AS (SELECT grp, sha256(string_agg(grp || '|' || ord || '|' || role, chr(10) ORDER BY ord)) AS sha, count(*) = max(ord) AND count(DISTINCT ord) = max(ord) AS whole FROM t GROUP BY grp)
  SELECT grp, ord, role AS text FROM t WHERE (SELECT bool_and(whole) FROM g)""")
def display_lookup(spark, d):
    """Texts for display, by the digest that they are pinned to."""
    texts = table(spark, d, "conversations").select((F.col("conv_id") + 1).alias("grp"), (F.col("turn") + 1).alias("ord"), F.col("role").alias("text"))
    line = F.concat_ws("|", F.col("grp").cast("string"), F.col("ord").cast("string"), "text")
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("line")))), lambda x: x["line"]), "\n")
    groups = texts.groupBy("grp").agg(F.sha2(ordered("ord", line), 256).alias("line"))
    pinned = groups.agg(F.sha2(ordered("grp", F.col("line")), 256).alias("sha")).first()["sha"]
    return reference.display_texts(texts, _turn_sizes(spark, d), pinned)


_PROV = _sql_one_of("o_orderkey", "''", "'normalized_hash_mismatch'", "'reference_source_url_invalid'", "'reference_retrieval_time_invalid'", "'reference_locator_mismatch'", "'reference_row_not_verified'", "'raw_hash_invalid'")


@query(f"SELECT failures, count(*)::BIGINT AS rows FROM (SELECT {_PROV} AS failures FROM orders WHERE o_orderkey > 0) GROUP BY 1")
def provenance_checks(spark, d):
    """Orders as retrieved rows, each with one fault or none."""
    key = F.col("o_orderkey").cast("string")
    fault = F.col("o_orderkey") % 7
    orders = table(spark, d, "orders").where("o_orderkey > 0")
    rows = orders.select(
        "o_orderkey", F.lit("f").alias("file_id"), F.col("o_orderkey").alias("input_index"), F.col("o_orderkey").alias("row_number"), key.alias("group_raw"), F.lit("1").alias("ordinal_raw"), F.col("o_orderpriority").alias("text"), F.lit(7).alias("book"),
        F.concat(F.when(fault == 4, F.lit("x")).otherwise(""), key, F.lit(":1")).alias("locator"),
        F.concat(F.lit("https://"), F.when(fault == 2, "other").otherwise("api"), F.lit(".example.org/v1/translation/7/"), key, F.lit("/1")).alias("source_url"),
        F.when(fault == 3, "2026-13-40T00:00:00Z").otherwise("2026-01-02T03:04:05Z").alias("retrieved_at"), F.when(fault == 5, "unverified").otherwise("verified").alias("verification_status"),
        F.lit("api").alias("source_kind"), F.sha2(F.when(fault == 1, F.lit("x")).otherwise(F.col("o_orderpriority")), 256).alias("normalized_sha256"), F.when(fault == 6, "zz").otherwise("a" * 64).alias("raw_sha256"),
    )
    sizes = index.numbering(orders.select(F.col("o_orderkey").alias("grp"), F.lit(1).alias("n")))
    out = review.retrieved_rows_checked(structure.keyed(rows, sizes), "api.example.org", 7, "api", True)
    return out.groupBy(F.array_join("failures", ",").alias("failures")).agg(F.count("*").alias("rows"))


_DECLARED = """WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem),
  p AS (SELECT CASE WHEN l_linenumber > 4 THEN 'comparison_id_invalid' WHEN n > 1 THEN 'comparison_id_duplicate' WHEN l_quantity < 3 THEN 'comparison_text_empty' END AS problem FROM k)"""


@query(_DECLARED + """ SELECT problem, 'user-declared' AS authority, CASE WHEN problem IS NULL THEN 'experimental-text-comparison-only' ELSE 'not-eligible' END AS eligibility, 'unverified' AS status, count(*)::BIGINT AS rows FROM p GROUP BY 1""")
def uploaded_provenance(spark, d):
    """An uploaded reference: comparable or not, and why; never verified."""
    out = review.declared_rows_checked(_line_reference(spark, d, ""), "user-upload")
    return out.groupBy(F.col("comparison_problem").alias("problem"), "authority", "eligibility", "status").agg(F.count("*").alias("rows"))


def _line_reference(spark, d, prefix: str):
    sizes = index.numbering(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.lit(4).alias("n")).distinct())
    text = F.when(F.col("l_quantity") < 3, "").otherwise(F.concat(F.lit(prefix), "l_returnflag"))
    rows = table(spark, d, "lineitem").select(F.lit("f").alias("file_id"), F.monotonically_increasing_id().alias("input_index"), F.monotonically_increasing_id().alias("row_number"),
                                              F.col("l_orderkey").cast("string").alias("group_raw"), F.col("l_linenumber").cast("string").alias("ordinal_raw"), text.alias("text"))
    return structure.keyed(rows, sizes)


@query("""SELECT 'verified' AS status, 'authored-teaching-only' AS authority, 'teaching-inspection-only' AS eligibility, count(*)::BIGINT AS rows FROM orders WHERE o_orderkey > 0""")
def teaching_provenance(spark, d):
    orders = table(spark, d, "orders").where("o_orderkey > 0")
    rows = orders.select(F.lit("f").alias("file_id"), F.col("o_orderkey").alias("input_index"), F.col("o_orderkey").alias("row_number"), F.col("o_orderkey").cast("string").alias("group_raw"), F.lit("1").alias("ordinal_raw"),
                         F.concat(F.lit("SYNTHETIC TRAINING TEXT "), "o_orderpriority").alias("text"))
    sizes = index.numbering(orders.select(F.col("o_orderkey").alias("grp"), F.lit(1).alias("n")))
    out = review.declared_rows_checked(structure.keyed(rows, sizes), "synthetic-teaching", True)
    return out.groupBy("status", "authority", "eligibility").agg(F.count("*").alias("rows"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS author, CASE WHEN p_partkey % 3 < 2 THEN 'recorded-unchecked' ELSE 'unknown' END AS author_status, 'unknown' AS publisher_status FROM part""")
def source_attributions(spark, d):
    sources = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("author unknown").alias("author"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).alias("translator"), F.lit(" ").alias("publisher"), F.lit("1").alias("edition"))
    return review.attributions(sources).select("p_partkey", "author", "author_status", "publisher_status")


# --- manifests ---------------------------------------------------------------------------------


def _report(spark, d):
    """A report on order lines that lost some rows and changed some texts."""
    rows = lines_as_rows(spark, d).select("file_id", "input_index", "group_raw", "ordinal_raw", "text")
    report = rows.where("file_id % 10 <> 3").select("file_id", "input_index", F.when(F.col("file_id") % 10 == 4, F.lit("0:0")).otherwise(F.concat_ws(":", "group_raw", "ordinal_raw")).alias("id"),
                                                   F.when(F.col("file_id") % 10 == 5, "other").otherwise(F.col("text")).alias("text"))
    return rows, report


@query("""SELECT CASE l_orderkey % 10 WHEN 3 THEN 'input_row_without_report' WHEN 4 THEN 'identifier_differs' ELSE 'text_differs' END AS problem, count(*)::BIGINT AS rows FROM lineitem WHERE l_orderkey % 10 BETWEEN 3 AND 5 GROUP BY 1""")
def manifest_positions(spark, d):
    rows, report = _report(spark, d)
    return manifest.positional_check(report, rows, index.numbering(order_sizes(spark, d))).groupBy("problem").agg(F.count("*").alias("rows"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), t AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS k FROM lineitem WHERE l_linenumber <= 5)
  SELECT CASE WHEN n IS NULL THEN 'no_input_reference' WHEN n > 1 THEN 'several_input_references' ELSE 'reference_text_differs' END AS problem, count(*)::BIGINT AS rows
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM t) t LEFT JOIN r USING (l_orderkey, l_linenumber) WHERE n IS NULL OR n > 1 OR l_orderkey % 10 = 6 GROUP BY 1""")
def manifest_linkage(spark, d):
    """Report rows whose reference isn't the one that went in."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("group_raw"), F.col("l_linenumber").cast("string").alias("ordinal_raw"), F.lit("same").alias("text"))
    report = lines.where("cast(ordinal_raw AS int) <= 5").select(F.lit("f").alias("file_id"), F.lit(0).alias("input_index"), F.concat_ws(":", "group_raw", "ordinal_raw").alias("id"),
                                                               F.when(F.col("group_raw").cast("long") % 10 == 6, "edited").otherwise("same").alias("reference_text")).distinct()
    out = manifest.linkage_check(report, lines.where("cast(ordinal_raw AS int) <= 4"), index.numbering(order_sizes(spark, d)))
    return out.groupBy("problem").agg(F.count("*").alias("rows"))


@query("""SELECT l_orderkey AS file_id, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1""")
def manifest_fingerprints(spark, d):
    """Digests of mapped rows by file: equal for equal rows in equal order, whatever their partitions."""
    rows = lines_as_rows(spark, d)
    once = manifest.rows_digest(rows, ["file_id"], stride=2)
    again = manifest.rows_digest(rows.repartition(7), ["file_id"], stride=2)
    runs = once.join(again.select("file_id", F.col("sha256").alias("again")), "file_id")
    parts = runs.select("file_id", "rows", F.col("sha256").alias("candidate_rows"), F.col("again").alias("reference_rows"), F.lit("x").alias("candidate_file"), F.lit("a" * 64).alias("reference_file"), F.lit("full").alias("scope"),
                        F.lit("{}").alias("metadata"), F.col("sha256").alias("output"), F.lit("m").alias("context"))
    out = manifest.fingerprints(parts)
    sound = (F.col("candidate_rows_sha256") == F.col("reference_rows_sha256")) & F.col("candidate_file_sha256").isNull() & F.col("input_sha256").rlike("^[a-f0-9]{64}$")
    return out.where(sound).select("file_id", "rows")


@query("""SELECT CASE page_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'mismatch' ELSE 'declared_not_verified' END AS status, count(*)::BIGINT AS files FROM pages WHERE html IS NOT NULL GROUP BY 1""")
def weight_guard(spark, d):
    """Pages as model files, a third with the right pin, a third with a wrong one, a third without."""
    pages = table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    pins = pages.where("page_id % 3 < 2").select("path", F.sha2(F.when(F.col("page_id") % 3 == 0, F.col("content")).otherwise(F.encode(F.lit("x"), "UTF-8")), 256).alias("sha256"))
    return manifest.weight_status(pages, pins).groupBy("status").agg(F.count("*").alias("files"))


@query("""SELECT user_id AS file_id, count(*)::BIGINT AS eligible, count(*) FILTER (event_type <> 'error')::BIGINT AS processed, count(*) FILTER (event_type = 'view')::BIGINT AS abstained, count(*) FILTER (event_type = 'error')::BIGINT AS not_processed,
  CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'not_run' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'complete' END AS state FROM events GROUP BY 1""")
def partial_results(spark, d):
    """A run that ended early: what it had finished is kept and counted."""
    pairs = table(spark, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("key"), "event_type")
    results = pairs.where("event_type <> 'error'").select("file_id", "key", F.when(F.col("event_type") == "view", "abstain").otherwise("no_signal").alias("outcome"))
    return manifest.partial_results(pairs, results.unionByName(results))


# --- decisions and teams -----------------------------------------------------------------------


@query("""SELECT user_id, user_id % 5 = 0 AS corrupt, CASE WHEN user_id % 5 <> 0 THEN count(*) FILTER (event_type IN ('click', 'view')) ELSE 1 END::BIGINT AS rows FROM events GROUP BY 1 HAVING user_id % 5 = 0 OR count(*) FILTER (event_type IN ('click', 'view')) > 0""")
def decision_stores(spark, d):
    """Each user's events as a stored object of decisions: unreadable ones are told, malformed entries left out."""
    entry = F.struct(F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "refer").otherwise("odd").alias("decision"), F.lit("seen").alias("note"), F.col("ts").cast("string").alias("savedAt"))
    events = table(spark, d, "events").select("user_id", F.sha2(F.col("event_id").cast("string"), 256).alias("k"), entry.alias("v"))
    stores = events.groupBy(F.col("user_id").alias("store")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("raw"))
    stores = stores.withColumn("raw", F.when(F.col("store") % 5 == 0, F.concat(F.lit("oops"), "raw")).otherwise(F.col("raw")))
    return review.parsed_store(stores).groupBy(F.col("store").alias("user_id"), "corrupt").agg(F.count("*").alias("rows"))


@query("SELECT p_type AS title, count(DISTINCT p_brand)::BIGINT AS identities FROM part GROUP BY 1")
def review_identities(spark, d):
    """Reports that differ in a file only have one identity; another author makes another."""
    reports = table(spark, d, "part").select(F.lit("v1").alias("schema"), F.col("p_type").alias("title"), F.col("p_brand").alias("author"), F.col("p_name").alias("file"))
    return review.review_identity(reports).groupBy("title").agg(F.countDistinct("identity").alias("identities"))


def _members(spark, d):
    """Suppliers as reviewers, nations as supervisors; every tenth supplier has left."""
    reviewers = table(spark, d, "supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("member_id"), F.col("s_name").alias("name"), F.lit("reviewer").alias("role"), F.concat(F.lit("n"), "s_nationkey").alias("supervisor_id"), (F.col("s_suppkey") % 10 == 9).alias("removed"))
    chiefs = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("member_id"), F.col("n_name").alias("name"), F.lit("supervisor").alias("role"), F.lit(None).cast("string").alias("supervisor_id"), F.lit(False).alias("removed"))
    return reviewers.unionByName(chiefs)


def _records(spark, d):
    """Order lines as records of their supplier; the flags tell how far they are."""
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").dropDuplicates(["l_orderkey"])
    stage = F.when(F.col("l_orderkey") % 5 == 0, "assigned").when(F.col("l_orderkey") % 5 == 1, "submitted").when(F.col("l_orderkey") % 5 == 2, "approved").when(F.col("l_orderkey") % 5 == 3, "returned").otherwise("approved")
    who = F.concat(F.lit("m"), F.col("l_orderkey") % 50)
    return lines.select(F.col("l_orderkey").cast("string").alias("fingerprint"), who.alias("reviewer_id"), stage.alias("stage"), F.lit("high").alias("severity"), (F.col("l_orderkey") % 7).alias("grp"),
                        F.when(F.col("l_orderkey") % 5 == 4, "odd").otherwise("accept").alias("decision"), F.lit("seen").alias("note"), F.lit("2026-01-01T00:00:00Z").alias("decided_at"), stage.alias("verdict"),
                        F.lit("so").alias("verdict_note"), F.lit("2026-01-02T00:00:00Z").alias("verdict_at"), F.lit("n1").alias("verdict_by"), F.lit(None).cast("string").alias("reviewer_name"))


_REC = """WITH r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1), s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 10 = 9 AS removed FROM supplier),
  rec AS (SELECT k, k % 50 AS who, CASE k % 5 WHEN 0 THEN 'assigned' WHEN 1 THEN 'submitted' WHEN 2 THEN 'approved' WHEN 3 THEN 'returned' ELSE 'approved' END AS stage FROM r)"""


@query(_REC + """ SELECT 'm' || s_suppkey AS member_id, count(k)::BIGINT AS total, count(*) FILTER (stage = 'approved')::BIGINT AS approved, count(*) FILTER (stage = 'submitted')::BIGINT AS submitted, count(*) FILTER (stage = 'returned')::BIGINT AS returned
  FROM s LEFT JOIN rec ON who = s_suppkey WHERE NOT removed GROUP BY 1 UNION ALL
  SELECT 'n' || n_nationkey, count(k)::BIGINT, count(*) FILTER (stage = 'approved')::BIGINT, count(*) FILTER (stage = 'submitted')::BIGINT, count(*) FILTER (stage = 'returned')::BIGINT
  FROM nation LEFT JOIN s ON s_nationkey = n_nationkey LEFT JOIN rec ON who = s_suppkey GROUP BY 1""")
def team_rollup(spark, d):
    return team.roll_up(_records(spark, d), _members(spark, d)).select("member_id", "total", "approved", "submitted", "returned")


@query(_REC + " SELECT who::VARCHAR AS reviewer, count(*)::BIGINT AS total, 0::BIGINT AS unassigned, count(*) FILTER (stage = 'assigned')::BIGINT AS assigned, count(*) FILTER (stage = 'submitted')::BIGINT AS submitted, count(*) FILTER (stage = 'approved')::BIGINT AS approved, count(*) FILTER (stage = 'returned')::BIGINT AS returned FROM rec GROUP BY 1")
def team_stages(spark, d):
    return team.stages(_records(spark, d).withColumn("reviewer", F.substring("reviewer_id", 2, 9)), ["reviewer"])


@query(_REC + """ SELECT member_id, count(*)::BIGINT AS items, count(note)::BIGINT AS notes FROM (
    SELECT 'm' || s_suppkey AS member_id, CASE WHEN stage = 'returned' THEN 'so' END AS note FROM s JOIN rec ON who = s_suppkey WHERE NOT removed
    UNION ALL SELECT 'n' || s_nationkey, 'so' FROM s JOIN rec ON who = s_suppkey WHERE NOT removed) GROUP BY 1""")
def team_tasks(spark, d):
    return team.task_items(_records(spark, d), _members(spark, d)).groupBy("member_id").agg(F.count("*").alias("items"), F.count("note").alias("notes"))


@query(_REC + """ SELECT outcome, count(*)::BIGINT AS items FROM (SELECT CASE WHEN k % 5 = 4 THEN 'invalid_decision' WHEN stage = 'returned' AND k % 2 = 0 THEN 'note_required' WHEN k % 3 = 0 THEN 'skipped' ELSE 'accepted' END AS outcome
    FROM rec JOIN s ON who = s_suppkey WHERE NOT removed AND s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3) AND stage IN ('approved', 'returned')) GROUP BY 1""")
def merged_reviews(spark, d):
    """A supervisor's review as it is merged: old verdicts, empty notes and unknown decisions don't stand."""
    records, members = _records(spark, d), _members(spark, d)
    chief = "n" + str(table(spark, d, "supplier").where("s_suppkey = 3").first()["s_nationkey"])
    items = team.review_items(records, members, chief)
    items = items.withColumn("verdict_note", F.when(F.col("fingerprint").cast("long") % 2 == 0, " ").otherwise(F.col("verdict_note")))
    items = items.withColumn("verdict_at", F.when(F.col("fingerprint").cast("long") % 3 == 0, "2026-01-01T12:00:00Z").otherwise("2026-01-03T00:00:00Z"))
    return team.merged_review(items, records, members, chief).groupBy("outcome").agg(F.count("*").alias("items"))


@query(_REC + " SELECT k::VARCHAR AS fingerprint FROM rec WHERE k % 5 = 2")
def approved_decisions(spark, d):
    return team.approved_decisions(_records(spark, d)).select("fingerprint")


@query(_REC + " SELECT k::VARCHAR AS fingerprint, stage, s_name AS reviewer_name, false AS certificate FROM rec LEFT JOIN supplier ON who = s_suppkey")
def team_export(spark, d):
    return team.exported(_records(spark, d), _members(spark, d)).select("fingerprint", "stage", "reviewer_name", "certificate")


@query(_REC + """ SELECT outcome, new_stage, count(*)::BIGINT AS rows FROM (SELECT CASE WHEN stage IN ('submitted', 'approved') THEN 'locked' WHEN k % 4 = 0 THEN 'freed' WHEN k % 4 = 1 THEN 'not_reviewer' ELSE 'moved' END AS outcome,
    CASE WHEN stage IN ('submitted', 'approved') THEN stage WHEN k % 4 = 0 THEN 'unassigned' WHEN k % 4 = 1 THEN stage WHEN stage = 'returned' AND k % 4 = 2 THEN 'returned' ELSE 'assigned' END AS new_stage FROM rec WHERE who < 9) GROUP BY 1, 2""")
def manual_assignments(spark, d):
    """Cases moved by hand: to nobody, to a stranger, to their own reviewer, to another."""
    k = F.col("fingerprint").cast("long")
    wish = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "zz").when(k % 4 == 2, F.col("reviewer_id")).otherwise("m0")
    wanted = _records(spark, d).where("cast(substring(reviewer_id, 2) AS int) < 9").withColumn("to", wish)
    wanted = wanted.withColumn("reviewer_id", F.when((k % 4 == 3) & (F.col("reviewer_id") == "m0"), "m1").otherwise(F.col("reviewer_id")))
    return team.assigned(wanted, _members(spark, d)).groupBy("outcome", "new_stage").agg(F.count("*").alias("rows"))


@query("""SELECT outcome, count(*)::BIGINT AS rows FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_nationkey < 25 THEN 'too_many' END WHEN 1 THEN 'not_found' WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 10 <> 9) THEN 'has_reviewers' ELSE 'removed' END
    ELSE 'name' END AS outcome FROM customer) GROUP BY 1""")
def membership_changes(spark, d):
    request = table(spark, d, "customer").select(
        F.col("c_custkey").alias("request"), F.when(F.col("c_custkey") % 4 % 3 == 0, "add").otherwise("remove").alias("action"), F.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("n"), "c_nationkey")).otherwise("nobody").alias("member_id"),
        F.when(F.col("c_custkey") % 4 == 3, " ‮ ").otherwise(F.col("c_name")).alias("name"), F.lit("reviewer").alias("role"), F.concat(F.lit("n"), "c_nationkey").alias("supervisor_id"),
    )
    return team.membership(request, _members(spark, d), most=30).groupBy("outcome").agg(F.count("*").alias("rows"))


@query("""WITH RECURSIVE crew AS (SELECT s_nationkey AS nation, list(s_suppkey ORDER BY s_suppkey) AS who, list((s_suppkey % 5 * 10)::BIGINT ORDER BY s_suppkey) AS load FROM supplier GROUP BY 1),
  g AS (SELECT nation, grp, n, row_number() OVER (PARTITION BY nation ORDER BY n DESC, grp) AS k FROM (SELECT c_nationkey AS nation, o_custkey % 7 AS grp, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)),
  s AS (SELECT nation, 0::BIGINT AS k, load, NULL::BIGINT AS grp, 0::BIGINT AS pick, 0::BIGINT AS n FROM crew
    UNION ALL SELECT nation, k, list_transform(load, lambda x, i: CASE WHEN i = pick THEN x + n ELSE x END), grp, pick, n
    FROM (SELECT s.nation, g.k, s.load, g.grp, CASE WHEN g.grp = 3 THEN len(s.load) ELSE list_position(s.load, list_min(s.load)) END AS pick, g.n FROM s JOIN g ON g.nation = s.nation AND g.k = s.k + 1))
  SELECT nation, grp, who[pick] AS reviewer, n::BIGINT AS cases FROM s JOIN crew USING (nation) WHERE k > 0""")
def assign_groups(spark, d):
    """Whole groups dealt to the reviewers of each nation's team, some loaded before; one group stays with the last of them."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    cases = table(spark, d, "orders").join(customers, "o_custkey").select("nation", (F.col("o_custkey") % 7).cast("long").alias("grp"))
    who = F.col("s_suppkey").cast("string").alias("reviewer_id")
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    crew = suppliers.select("nation", who, F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % 5 * 10).alias("load"))
    holders = suppliers.groupBy("nation").agg(F.max("s_suppkey").alias("s_suppkey")).select("nation", F.lit(3).cast("long").alias("grp"), who)
    out = team.by_group(cases, crew, holders, ["nation"])
    return out.select("nation", "grp", F.col("reviewer_id").cast("long").alias("reviewer"), "cases")


@query("""SELECT user_id, count(*)::BIGINT AS records FROM events WHERE user_id % 4 = 0 GROUP BY 1""")
def restored_workspaces(spark, d):
    """Stored workspaces: of another run, of another form, unreadable, and sound ones."""
    record = F.struct(F.lit("assigned").alias("stage"), F.lit("m1").alias("reviewerId"))
    events = table(spark, d, "events").select("user_id", F.struct(F.col("event_id").cast("string").alias("k"), record.alias("v")).alias("e"))
    grouped = events.groupBy("user_id").agg(F.map_from_entries(F.collect_list("e")).alias("records"))
    member = F.array(F.struct(F.lit("m1").alias("id"), F.lit("reviewer").alias("role")))
    raw = F.to_json(F.struct(F.when(F.col("user_id") % 4 == 1, "other/9").otherwise("team/1").alias("schema"), F.when(F.col("user_id") % 4 == 2, "b").otherwise("a").alias("runKey"), F.lit("project-1").alias("projectId"), F.lit("manager").alias("role"), member.alias("members"), "records"))
    stores = grouped.select(F.col("user_id").alias("store"), F.when(F.col("user_id") % 4 == 3, F.concat(F.lit("{"), raw)).otherwise(raw).alias("raw"))
    return team.restored(stores, "a", "team/1").groupBy(F.col("store").alias("user_id")).agg(F.count("*").alias("records"))


_ITEMS = _sql_one_of("o_orderkey", "'accepted'", "'skipped'", "'not_assigned'", "'invalid_decision'", "'not_yours'", "'not_reviewer'")


@query(f"SELECT outcome, count(*)::BIGINT AS items FROM (SELECT {_ITEMS} AS outcome FROM orders) GROUP BY 1")
def submission_outcomes(spark, d):
    """Orders as submitted items, a sixth of them for each thing that can become of one."""
    k = F.col("o_orderkey") % 6
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("fingerprint"), k.alias("k"))
    sender = F.when(F.col("k") == 4, "r2").when(F.col("k") == 5, "zz").otherwise("r1")
    items = orders.select("fingerprint", sender.alias("reviewer_id"), F.lit("accept").alias("decision"), F.when(F.col("k") == 3, " ").otherwise("ok").alias("note"), F.lit("2026-01-02T00:00:00Z").alias("created_at"))
    records = orders.where("k < 5").select("fingerprint", F.when(F.col("k").isin(2, 4), "r2").otherwise("r1").alias("reviewer_id"), F.when(F.col("k") == 1, "submitted").otherwise("assigned").alias("stage"), F.when(F.col("k") == 1, "2026-01-03T00:00:00Z").alias("submitted_at"))
    members = spark.createDataFrame([("r1", "One", "reviewer", "s1", False), ("r2", "Two", "reviewer", "s2", False), ("s1", "Sup", "supervisor", None, False)], "member_id string, name string, role string, supervisor_id string, removed boolean")
    return team.submissions(items, records, members, "s1").groupBy("outcome").agg(F.count("*").alias("items"))


# --- baselines, samples, files -----------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, arg_max(l_returnflag, k) AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey) AS k FROM lineitem WHERE l_linenumber <= 4) GROUP BY 1, 2),
  c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS text FROM lineitem WHERE l_linenumber <> 2)
  SELECT 'A' AS side, CASE WHEN r.text IS NULL THEN 'not_found' ELSE 'differs' END AS reason, count(*)::BIGINT AS rows FROM c LEFT JOIN r USING (l_orderkey, l_linenumber) WHERE r.text IS NULL OR r.text <> c.text GROUP BY 1, 2
  UNION ALL SELECT 'B', 'absent', count(*)::BIGINT FROM r ANTI JOIN c USING (l_orderkey, l_linenumber)""")
def naive_lookup(spark, d):
    """A spreadsheet's lookup on order lines."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey")
    lines = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_partkey"), line_tasks(spark, d), "l_orderkey", "l_linenumber")
    lines = lines.select(F.col("l_orderkey").alias("group_raw"), F.col("l_linenumber").alias("ordinal_raw"), F.col("l_returnflag").alias("text"), F.row_number().over(order).cast("long").alias("row_number"))
    out = baseline.naive_lookup(lines.where("ordinal_raw <> 2"), lines.where("ordinal_raw <= 4"))
    return out.groupBy("side", "reason").agg(F.count("*").alias("rows"))


@query("""WITH i AS (SELECT l_orderkey, l_returnflag AS defect, CASE WHEN l_orderkey % 3 = 0 THEN 2 WHEN l_orderkey % 3 = 1 THEN 1 ELSE 0 END AS hit FROM lineitem WHERE l_linenumber = 1),
  c AS (SELECT defect, count(*) AS injected, count(*) FILTER (hit > 0) AS touched, count(*) FILTER (hit = 2) AS detected FROM i GROUP BY 1)
  SELECT defect, injected::BIGINT AS injected, touched::BIGINT AS touched, detected::BIGINT AS detected, round(detected / injected::DOUBLE, 3) AS recall FROM c""")
def defect_recall(spark, d):
    """Known defects met by findings: by identifier with a code that tells them, by row with one that doesn't, or not at all."""
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.monotonically_increasing_id().alias("case_id"), F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("defect"))
    injected = lines.select("case_id", "defect", F.col("k").cast("string").alias("id"), F.col("k").alias("row_number"))
    keys = lines.select("k").distinct()
    told = keys.where("k % 3 = 0").select(F.lit("told").alias("code"), F.array(F.col("k").cast("string")).alias("ids"), F.array().cast("array<long>").alias("row_numbers"))
    near = keys.where("k % 3 = 1").select(F.lit("near").alias("code"), F.array().cast("array<string>").alias("ids"), F.array("k").alias("row_numbers"))
    relevant = lines.select("defect", F.lit("told").alias("code")).distinct()
    return baseline.defect_recall(injected, told.unionByName(near), relevant)


@query("""SELECT count(*) FILTER (l_orderkey % 5 > 1 AND l_linenumber > 1)::BIGINT AS untouched, count(*) FILTER (l_orderkey % 5 > 1 AND l_linenumber > 1 AND l_returnflag = 'R')::BIGINT AS false_alarms FROM lineitem""")
def false_alarms(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").cast("long").alias("row_number"), F.when(F.col("l_returnflag") == "R", "needs_review").otherwise("abstain").alias("status"))
    keys = rows.where("cast(id AS long) % 5 <= 1").select("id", F.lit(None).cast("long").alias("row_number")).distinct()
    return baseline.false_alarms(rows, keys.unionByName(spark.createDataFrame([(None, 1)], "id string, row_number long")))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'changed' ELSE 'kept' END AS type FROM documents WHERE text IS NOT NULL)
  SELECT type, count(*)::BIGINT AS cases, count(*) FILTER (type = 'changed')::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, count(*) FILTER (type = 'kept')::BIGINT AS tn FROM c GROUP BY ROLLUP (type)""")
def lexical_baseline(spark, d):
    """The transparent rules as a classifier of pairs: a lost negation is a risk, an equal text none."""
    from ..operators import compare

    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("number "), F.col("doc_id").cast("string"), F.lit(" does not go")).alias("other"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("other", F.lit(" not"), F.lit(""))).otherwise(F.col("other")))
    found = compare.lexical(docs, "en")
    risk = (F.col("negation_state") == "difference") | F.col("lexical_difference")
    cases = found.select(F.when(F.col("doc_id") % 2 == 0, "changed").otherwise("kept").alias("type"), (F.col("doc_id") % 2 == 0).alias("expected_risk"), F.when(risk, "risk").otherwise("no_signal").alias("predicted"), F.lit(True).alias("has_result"))
    return semantic.confusion(cases).select("type", "cases", "tp", "fp", "fn", "tn")


@query("""WITH k AS (SELECT l_orderkey AS grp, max(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1) SELECT count(*)::BIGINT AS groups, sum(n)::BIGINT AS rows, sum(n)::BIGINT AS ids FROM k""")
def generated_file(spark, d):
    """A generated sound file of as many groups as there are orders: every identifier once, none without text."""
    sizes = order_index(spark, d)
    rows = structure.keyed(samples.numbered_file(sizes).withColumn("file_id", F.lit("made")), sizes, many=line_tasks(spark, d)).where("valid AND text <> ''")
    ids = rows.groupBy("grp", "ord").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("rows"), F.count("*").alias("ids"))
    return ids.agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"), F.sum("ids").alias("ids"))


_BAD = _sql_one_of("conv_id", "'quote_in_bare_cell'", "'columns_not_recognised'", "'entities_refused'", "'not_an_archive'", "'ragged_row'", "'not_utf8'")


@query(f"SELECT error, count(*)::BIGINT AS files FROM (SELECT DISTINCT conv_id, {_BAD} AS error FROM conversations) GROUP BY 1")
def refused_files(spark, d):
    """Each conversation's number in a file that a strict reader refuses."""
    n = F.col("conv_id").cast("string")
    body = _one_of("conv_id", F.concat(n, F.lit(',b"c\n')), F.concat(F.lit("x,y\n1,"), n, F.lit("\n")), F.concat(F.lit("<!DOCTYPE x><x>"), n, F.lit("</x>")), F.concat(F.lit("nope"), n), F.concat(F.lit("chapter,verse,text\n1,"), n, F.lit("\n")), n)
    content = F.when(F.col("conv_id") % 6 == 5, F.concat(F.unhex(F.lit("FFFE00")), F.encode(n, "UTF-8"))).otherwise(F.encode(body, "UTF-8"))
    path = F.concat(n, _one_of("conv_id", ".csv", ".csv", ".xml", ".xlsx", ".csv", ".txt"))
    made = table(spark, d, "conversations").select("conv_id").distinct().select(path.alias("path"), content.alias("content"))
    return files.parse_files(made).groupBy("error").agg(F.count("*").alias("files"))


# --- files of other kinds ----------------------------------------------------------------------


@query("SELECT conv_id + 1 AS grp, turn::VARCHAR AS ordinal_raw, role AS text FROM conversations")
def xml_round_trip(spark, d):
    """Conversations as XML passages within their group, read again."""
    turns = table(spark, d, "conversations")
    passage = F.concat(F.lit('<aya index="'), F.col("turn").cast("string"), F.lit('"><text>'), F.coalesce("role", F.lit("")), F.lit("</text></aya>"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", passage.alias("p")))), lambda x: x["p"]), "\n")
    made = turns.groupBy("conv_id").agg(listed.alias("body"))
    content = F.concat(F.lit('<book><sura index="'), (F.col("conv_id") + 1).cast("string"), F.lit('">'), "body", F.lit("</sura></book>"))
    rows = files.parse_files(made.select(F.concat(F.col("conv_id").cast("string"), F.lit(".xml")).alias("path"), F.encode(content, "UTF-8").alias("content")))
    return rows.where("error IS NULL").select(F.col("group_raw").cast("long").alias("grp"), "ordinal_raw", "text")


@query(f"SELECT o_custkey, {_sql_one_of('o_custkey', chr(39) + ',' + chr(39), chr(39) + ';' + chr(39), 'chr(9)', chr(39) + '|' + chr(39))} AS delimiter, count(*)::BIGINT + 1 AS records FROM orders WHERE o_orderkey >= 0 GROUP BY 1 HAVING count(*) < 19")
def file_previews(spark, d):
    """Each customer's orders in a file of one of four delimiters, as the preview sees them."""
    sign = _one_of("o_custkey", ",", ";", "\t", "|")
    line = F.concat_ws(",", "o_custkey", "o_orderkey", "o_orderstatus")
    orders = table(spark, d, "orders").where("o_orderkey >= 0").groupBy("o_custkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.concat(F.lit("chapter,verse,translation\n"), F.array_join("lines", "\n"))
    made = orders.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(F.replace(text, F.lit(","), sign), "UTF-8").alias("content"))
    made = made.where(F.size(F.split(F.decode("content", "UTF-8"), "\n")) < 20)
    seen = files.preview(made).where("error IS NULL")
    return seen.groupBy(F.regexp_extract("file_id", "^([0-9]+)", 1).cast("long").alias("o_custkey"), "delimiter").agg(F.count("*").alias("records"))


def _workbooks(spark, d):
    """Each brand's parts as workbooks, packed on the executors: as many as the limit of rows asks for, the first with headings."""
    cells = ["p_partkey", "p_size", "p_name"]
    part = table(spark, d, "part")
    parts = ranked(part.select("p_brand", *cells), ["p_brand"], [F.col(c) for c in cells], "place", index.tasks(part))
    parts = parts.groupBy("p_brand", F.floor((F.col("place") - 1) / MAX_ROWS).alias("book")).agg(F.array_sort(F.collect_list(F.struct(*cells))).alias("rows"))

    def pack(batches):
        import io
        import zipfile

        import pyarrow as pa

        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        for batch in batches:
            names, out = [], []
            for brand, book, rows in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                cells = [["chapter", "verse", "translation"]] * (book == 0) + [[r["p_partkey"] + 1, r["p_size"], r["p_name"]] for r in rows]
                cell = lambda x: f"<c><v>{x}</v></c>" if isinstance(x, int) else f'<c t="inlineStr"><is><t>{x}</t></is></c>'
                sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in cells)
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
                    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
                    z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
                names.append(f"{brand.replace('#', '-')}.{book}.xlsx")
                out.append(body.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    ship(spark)
    return parts.mapInArrow(pack, "path string, content binary")


@query("SELECT p_partkey + 1 AS grp, p_size::VARCHAR AS ordinal_raw, p_name AS text FROM part")
def workbook_round_trip(spark, d):
    rows = files.parse_files(_workbooks(spark, d)).where("error IS NULL")
    return rows.select(F.col("group_raw").cast("long").alias("grp"), "ordinal_raw", "text")


@query("SELECT p_brand, 3 * count(*)::BIGINT + 3 AS cells FROM part GROUP BY 1")
def workbook_cells(spark, d):
    """The cells of workbooks by the table function, in SQL."""
    files.register(spark)
    _workbooks(spark, d).createOrReplaceTempView("tallymark_workbooks")
    out = spark.sql("SELECT path, count(*) AS cells FROM tallymark_workbooks, LATERAL parse_workbook(content) GROUP BY path")
    brand = F.replace(F.regexp_extract("path", "^(.*)[.][0-9]+[.]xlsx$", 1), F.lit("-"), F.lit("#"))
    return out.groupBy(brand.alias("p_brand")).agg(F.sum("cells").alias("cells"))
