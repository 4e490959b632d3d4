"""Queries on known defects: sentences made from orders, defects put in by rule, the whole audit, and what it tells of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import index, injection
from .shared import written
from .tables import table

QUERIES, SQL = {}, {}
PER_KIND, SEED = 10, 7

#: Families of sentences: the sound one, and by kind of defect what it turns into. Slots are filled from an order.
FAMILIES = {
    "does_not": ("Desk {desk} does not release parcels on {day} before lunch.", {
        "negation_removed": "Desk {desk} does release parcels on {day} before lunch.", "light_paraphrase": "Desk {desk} is not releasing parcels on {day} before lunch.",
        "moderate_paraphrase": "On {day}, nobody at desk {desk} hands out a parcel until lunch is over."}),
    "are_not": ("Returned boxes are not kept near desk {desk} after {day}.", {
        "negation_removed": "Returned boxes are kept near desk {desk} after {day}.", "light_paraphrase": "Returned boxes are not left near desk {desk} after {day}.",
        "moderate_paraphrase": "After {day}, desk {desk} never has anyone's returned box beside it."}),
    "takes": ("Desk {desk} takes new orders on {day} until the evening.", {
        "negation_added": "Desk {desk} does not take new orders on {day} until the evening.", "light_paraphrase": "Desk {desk} accepts new orders on {day} until the evening.",
        "moderate_paraphrase": "Anyone can place an order at desk {desk} all {day} long."}),
    "sends": ("The carriers bring the crates from desk {desk} to the yard every {day}.", {
        "negation_added": "The carriers do not bring the crates from desk {desk} to the yard every {day}.", "light_paraphrase": "The carriers move the crates from desk {desk} to the yard every {day}.",
        "moderate_paraphrase": "Each {day} crates go out to the yard, carried over from desk {desk}."}),
    "all": ("All carriers report to desk {desk} on {day}.", {
        "critical_word": "Some carriers report to desk {desk} on {day}.", "light_paraphrase": "All carriers check in at desk {desk} on {day}.",
        "moderate_paraphrase": "On {day}, every single carrier signs in with desk {desk}."}),
    "always": ("Desk {desk} always seals the crates on {day}.", {
        "word_to_negation": "Desk {desk} never seals the crates on {day}.", "light_paraphrase": "Desk {desk} always closes the crates on {day}.",
        "moderate_paraphrase": "Every {day}, without exception, crates are sealed by desk {desk}."}),
    "allowed": ("Desk {desk} is permitted to open crates on {day}.", {
        "critical_word": "Desk {desk} is forbidden to open crates on {day}.", "light_paraphrase": "Desk {desk} is allowed to open crates on {day}.",
        "moderate_paraphrase": "Opening a crate on {day} is something that desk {desk} may do."}),
    "must": ("Desk {desk} must weigh the crates on {day}.", {
        "critical_word": "Desk {desk} may weigh the crates on {day}.", "light_paraphrase": "Desk {desk} has to weigh the crates on {day}.",
        "moderate_paraphrase": "Weighing crates on {day} is required of desk {desk}."}),
    "before": ("The carriers load the crates before noon on {day} at desk {desk}.", {
        "critical_word": "The carriers load the crates after noon on {day} at desk {desk}.", "light_paraphrase": "The carriers pack the crates before noon on {day} at desk {desk}.",
        "moderate_paraphrase": "At desk {desk}, crates get loaded by carriers ahead of noon on {day}."}),
    "digits": ("Desk {desk} has {more} crates and one scale.", {
        "number_changed": "Desk {desk} has {less} crates and one scale.", "light_paraphrase": "Desk {desk} holds {more} crates and one scale.",
        "moderate_paraphrase": "There are {more} crates next to a single scale with desk {desk}."}),
    "words": ("Desk {desk} keeps seven crates in the yard on {day}.", {
        "number_changed": "Desk {desk} keeps six crates in the yard on {day}.", "light_paraphrase": "Desk {desk} stores seven crates in the yard on {day}.",
        "moderate_paraphrase": "On {day}, the yard of desk {desk} has seven crates in it."}),
}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def sentences(spark, d):
    """Sound rows (file_id, position, grp, ord, n, text, variants, family) of one file: a customer's orders are a group."""
    from pyspark.sql import Window

    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    rows = orders.select(F.col("o_custkey").cast("long").alias("grp"), place.alias("ord"), "o_orderkey", "o_orderdate")
    # a small index would be read by one task, and broadcast rows to it
    rows = rows.join(sizes(spark, d).hint("merge"), "grp")
    rows = rows.withColumn("position", F.col("base") + F.col("ord"))
    more = 10 + F.col("grp") % 80
    slots = {"desk": F.col("o_orderkey"), "day": F.date_format("o_orderdate", "EEEE"), "more": more, "less": more - 1}
    rows = rows.withColumns({k: v.cast("string") for k, v in slots.items()})

    def filled(sentence: str):
        out = F.lit(sentence)
        for slot in slots:
            if "{" + slot + "}" in sentence:
                out = F.replace(out, F.lit("{" + slot + "}"), F.col(slot))
        return out

    family = F.pmod("position", F.lit(len(FAMILIES)))
    text = variants = name = None
    for k, (label, (sound, other)) in enumerate(FAMILIES.items()):
        hit, pairs = family == k, F.create_map(*[x for kind, s in other.items() for x in (F.lit(kind), filled(s))])
        name = F.when(hit, label) if name is None else name.when(hit, label)
        text = F.when(hit, filled(sound)) if text is None else text.when(hit, filled(sound))
        variants = F.when(hit, pairs) if variants is None else variants.when(hit, pairs)
    return rows.select(F.lit("orders").alias("file_id"), "position", "grp", "ord", "n", text.alias("text"), variants.alias("variants"), name.alias("family"))


def sizes(spark, d):
    return index.numbering(table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("grp")).agg(F.count("*").alias("n")))


def trial(spark, d):
    """Cases, rows with them, reference and report of the audit."""
    made = sentences(spark, d)
    # read six times; what a text can turn into is asked for once, and not kept
    sound = written(made.drop("variants", "family"), "sound")
    cases = written(injection.chosen(made, PER_KIND, SEED).withColumn("sub_kind", F.when(F.element_at("variants", F.col("defect")).isNotNull(), F.col("family")).otherwise("")), "cases")
    rows = written(injection.injected(sound, cases, bad_group="-1", many=index.tasks(sound)), "injected")
    reference = sound.select("file_id", (F.col("position") - 1).alias("input_index"), (F.col("position") + 1).alias("row_number"), F.col("grp").cast("string").alias("group_raw"), F.col("ord").cast("string").alias("ordinal_raw"), "text")
    report = A.audit(rows.drop("case_id"), sizes(spark, d), reference, candidate_language="en", reference_language="en", verified=True)
    return cases, rows, reference, report


def _filled_sql(sentence: str) -> str:
    out = "'" + sentence.replace("'", "''") + "'"
    for slot in ("desk", "day", "more", "less"):
        if "{" + slot + "}" in sentence:
            out = f"replace({out}, '{{{slot}}}', {slot})"
    return out


def _drawn_sql(tag: str, *what: str) -> str:
    return "md5(" + f"'{SEED}:{tag}:orders:' || " + " || ':' || ".join(f"({w})::VARCHAR" for w in what) + ")"


def _bits_sql(tag: str, *what: str) -> str:
    return f"(('0x' || substr({_drawn_sql(tag, *what)}, 1, 8))::BIGINT)"


_KINDS = "CASE family " + " ".join(f"WHEN '{f}' THEN {sorted([*injection.STRUCTURAL, *v])!r}" for f, (_, v) in FAMILIES.items()) + " END"
_SOUND = "CASE family " + " ".join(f"WHEN '{f}' THEN {_filled_sql(s)}" for f, (s, _) in FAMILIES.items()) + " END"
_VARIANT = "CASE family || '/' || defect " + " ".join(f"WHEN '{f}/{kind}' THEN {_filled_sql(s)}" for f, (_, v) in FAMILIES.items() for kind, s in v.items()) + " END"
_MARKS = "['" + "','".join(w.replace("'", "''") for w in T.NEGATIONS_EN) + "']"
_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)*'), lambda w: lower(w))"
_CASES = f"""WITH g AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1),
  i AS (SELECT grp, n, coalesce(sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM g),
  o AS (SELECT o_custkey AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderkey, o_orderdate FROM orders),
  r AS (SELECT grp, ord, n, base + ord AS position, o_orderkey::VARCHAR AS desk, dayname(o_orderdate) AS day, (10 + grp % 80)::VARCHAR AS more, (9 + grp % 80)::VARCHAR AS less FROM o JOIN i USING (grp)),
  f AS (SELECT grp, ord, position, desk, day, more, less, {list(FAMILIES)!r}[position % {len(FAMILIES)} + 1] AS family FROM r
    WHERE position > 1 AND ord < n AND position % {injection.RUN} = {_bits_sql("run", f"position // {injection.RUN}")} % {injection.RUN // 2}),
  k AS (SELECT *, {_KINDS} AS kinds FROM f), d AS (SELECT *, kinds[({_bits_sql("kind", "position")} % len(kinds) + 1)::INT] AS defect FROM k),
  p AS (SELECT *, row_number() OVER (PARTITION BY defect ORDER BY {_drawn_sql("pick", "position")}, position) AS place FROM d),
  c AS (SELECT * FROM p WHERE place <= {PER_KIND}),
  t AS (SELECT defect, {_VARIANT} AS variant, {_SOUND} AS sound, family FROM c),
  w AS (SELECT defect, variant IS NOT NULL AS worded, CASE WHEN variant IS NULL THEN '' ELSE family END AS sub_kind, {_TOKENS.format("variant")} AS a, {_TOKENS.format("sound")} AS b FROM t),
  s AS (SELECT defect, sub_kind, worded, CASE WHEN worded THEN (len(list_filter(a, lambda x: list_contains({_MARKS}, x))) > 0) <> (len(list_filter(b, lambda x: list_contains({_MARKS}, x))) > 0)
    OR len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))::DOUBLE < 0.65 ELSE true END AS hit FROM w)"""


@query(_CASES + """ SELECT defect, sub_kind, count(*)::BIGINT AS injected, count(*) FILTER (hit)::BIGINT AS touched, count(*) FILTER (hit)::BIGINT AS detected, round(count(*) FILTER (hit) / count(*)::DOUBLE, 3) AS recall,
  count(*) FILTER (worded OR defect IN ('invalid_id', 'emptied_text', 'merged_rows'))::BIGINT AS naive_a, count(*) FILTER (worded OR defect IN ('invalid_id', 'emptied_text', 'merged_rows', 'missing_row'))::BIGINT AS naive_b FROM s GROUP BY 1, 2""")
def injected_recall(spark, d):
    """Thirteen kinds of defects, ten of each at most, in a file of all orders: what the audit and a plain lookup tell, by kind and family."""
    cases, rows, reference, report = trial(spark, d)
    return injection.recall(cases, rows, report.findings, reference, ("sub_kind",))


@query(_CASES + """ SELECT ((SELECT count(*) FROM orders) - count(*) - count(*) FILTER (defect IN ('swapped_rows', 'merged_rows')))::BIGINT AS untouched, 0::BIGINT AS false_alarms FROM c""")
def injected_alarms(spark, d):
    """The other rows of that file, and how many of them the audit sends to review."""
    cases, rows, _, report = trial(spark, d)
    touched = injection.few(cases)(rows.where("case_id IS NOT NULL").select("file_id", "row_number", "case_id"))
    audited = report.rows.select("file_id", "row_number", "id", "status").join(touched, ["file_id", "row_number"], "left")
    return injection.alarms(cases, audited)
