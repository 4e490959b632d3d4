"""Queries on structure, reference gates, text rules; each with its SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import compare, index, semantic, structure
from .shipping import ship
from .tables import line_tasks, lines_as_rows, order_index, order_sizes, pairs_by_start, table

QUERIES, SQL = {}, {}

#: The token pattern in the oracle's regex dialect, which has no possessive or look-around forms either.
_TOKEN = "[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*(?:[''’][\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*)*"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_INDEX = "idx AS (SELECT l_orderkey AS grp, max(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1)"
_ROWS = """rows AS (SELECT l_orderkey AS grp, l_linenumber::BIGINT AS ord, l_returnflag AS text,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS row_number FROM lineitem)"""


@query(f"WITH {_INDEX} SELECT grp, n, (sum(n) OVER (ORDER BY grp) - n)::BIGINT AS base FROM idx")
def expected_index(spark, d):
    return index.numbering(order_sizes(spark, d))


@query(f"WITH {_INDEX} SELECT grp, count(*)::BIGINT AS ids FROM (SELECT grp, unnest(range(1, n + 1)) FROM idx) GROUP BY grp")
def expected_ids(spark, d):
    return index.expected(index.numbering(order_sizes(spark, d))).groupBy("grp").agg(F.count("*").alias("ids"))


@query("""SELECT l_orderkey AS grp, count(*)::BIGINT AS invalid_rows FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL OR l_linenumber > 4 GROUP BY 1""")
def invalid_ids(spark, d):
    sizes = index.numbering(table(spark, d, "orders").select(F.col("o_orderkey").alias("grp"), F.lit(4).alias("n")))
    rows = structure.keyed(lines_as_rows(spark, d), sizes)
    return rows.where("NOT valid").groupBy("grp").agg(F.count("*").alias("invalid_rows"))


@query("""SELECT l_returnflag AS text, count(*)::BIGINT AS rows, count(*) FILTER (o_orderkey IS NULL)::BIGINT AS outside FROM lineitem
  LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY 1""")
def out_of_scope(spark, d):
    sizes = index.numbering(order_sizes(spark, d))
    scope = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("grp"))
    rows = structure.keyed(lines_as_rows(spark, d), sizes, scope)
    return rows.groupBy("text").agg(F.count("*").alias("rows"), F.count_if(~F.col("in_scope")).alias("outside"))


@query("""SELECT l_orderkey AS grp, l_linenumber::BIGINT AS ord, count(*)::BIGINT AS occurrences, count(DISTINCT lower(l_returnflag)) > 1 AS conflicting_text
  FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    rows = structure.keyed(lines_as_rows(spark, d), index.numbering(order_sizes(spark, d)), many=line_tasks(spark, d))
    return structure.duplicates(rows).select("grp", "ord", "occurrences", "conflicting_text")


_MISSING = f"""{_INDEX}, gone AS (SELECT grp, ord FROM (SELECT grp, unnest(range(1, n + 1)) AS ord FROM idx)
  ANTI JOIN (SELECT DISTINCT l_orderkey AS grp, l_linenumber::BIGINT AS ord FROM lineitem) USING (grp, ord)),
  runs AS (SELECT grp, min(ord) AS first, max(ord) AS last, count(*) AS size FROM
    (SELECT grp, ord, ord - row_number() OVER (PARTITION BY grp ORDER BY ord) AS island FROM gone) GROUP BY grp, island)"""


@query(f"WITH {_MISSING} SELECT grp, first, last, size::BIGINT AS size FROM runs")
def missing_ranges(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("ord"))
    return structure.ranges(structure.missing_in_groups(have, order_index(spark, d), line_tasks(spark, d)), ["grp"])


@query(f"""WITH {_ROWS}, seen AS (SELECT *, lag(ord) OVER (PARTITION BY grp ORDER BY row_number) AS before FROM rows)
  SELECT grp, row_number::BIGINT AS row_number, ord, before FROM seen WHERE ord < before""")
def out_of_order(spark, d):
    many = line_tasks(spark, d)
    rows = structure.keyed(lines_as_rows(spark, d), order_index(spark, d), many=many)
    out = structure.out_of_order(rows, many)
    return out.select("grp", "row_number", "ord", (F.col("ord") - (F.col("position") - F.col("previous_position"))).alias("before"))


@query(f"""WITH {_MISSING}, {_ROWS},
  dup AS (SELECT grp, ord, count(*) AS c FROM rows GROUP BY 1, 2 HAVING count(*) > 1),
  seen AS (SELECT ord, lag(ord) OVER (PARTITION BY grp ORDER BY row_number) AS before FROM rows)
  SELECT (SELECT count(*) FROM rows)::BIGINT AS total_rows, (SELECT sum(n) FROM idx)::BIGINT AS expected_ids,
    (SELECT count(*) FROM (SELECT DISTINCT grp, ord FROM rows))::BIGINT AS covered_ids, (SELECT count(*) FROM gone)::BIGINT AS missing_ids,
    (SELECT count(*) FROM runs)::BIGINT AS missing_runs, (SELECT count(*) FROM dup)::BIGINT AS duplicate_ids, (SELECT sum(c - 1) FROM dup)::BIGINT AS duplicate_rows,
    (SELECT count(*) FROM seen WHERE ord < before)::BIGINT AS out_of_order_rows,
    round(((SELECT count(*) FROM (SELECT DISTINCT grp, ord FROM rows)) * 100 / (SELECT sum(n) FROM idx)::DOUBLE)::DECIMAL(20,10), 2)::DOUBLE AS coverage_percent""")
def structural_summary(spark, d):
    """The flagship: coverage, gaps, copies and order of a numbered file in one row."""
    sizes = index.numbering(order_sizes(spark, d))
    return structure.totals(structure.keyed(lines_as_rows(spark, d), sizes), sizes)


_GATE = """WITH ref AS (SELECT l_orderkey AS grp, count(*) AS refs FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
  SELECT o_orderkey AS grp, CASE WHEN refs IS NULL THEN 'missing_reference' WHEN refs > 1 THEN 'ambiguous_reference' ELSE 'unverified_reference' END AS reason
  FROM orders LEFT JOIN ref ON o_orderkey = grp"""


@query(_GATE)
def reference_gate(spark, d):
    orders = table(spark, d, "orders").select(
        F.lit("o").alias("file_id"), F.col("o_orderkey").alias("input_index"), F.col("o_orderkey").alias("row_number"),
        F.col("o_orderkey").cast("string").alias("group_raw"), F.lit("1").alias("ordinal_raw"), F.col("o_orderpriority").alias("text"),
    )
    reference = lines_as_rows(spark, d).where("ordinal_raw = '1'")
    sizes = index.numbering(table(spark, d, "orders").select(F.col("o_orderkey").alias("grp"), F.lit(1).alias("n")))
    gated = compare.gated(structure.keyed(orders, sizes), structure.keyed(reference, sizes))
    return gated.select("grp", F.col("comparison_reason").alias("reason"))


@query("""WITH known AS (SELECT o_orderkey FROM orders), r AS (SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AND l_linenumber <= 4 AS valid
    FROM lineitem LEFT JOIN known ON l_orderkey = o_orderkey), ids AS (SELECT count(*) AS n FROM r WHERE valid GROUP BY l_orderkey, l_linenumber)
  SELECT (SELECT count(*) FROM r WHERE NOT valid)::BIGINT AS invalid_rows, 0::BIGINT AS empty_rows,
    (SELECT count(*) FROM ids WHERE n > 1)::BIGINT AS duplicate_ids, (SELECT count(*) FROM ids WHERE n = 1)::BIGINT AS usable_ids""")
def reference_integrity(spark, d):
    sizes = index.numbering(table(spark, d, "orders").select(F.col("o_orderkey").alias("grp"), F.lit(4).alias("n")))
    return compare.integrity(structure.keyed(lines_as_rows(spark, d), sizes))


@query("SELECT doc_id, len(regexp_extract_all(text, '" + _TOKEN + "'))::BIGINT AS tokens FROM documents")
def token_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.when(F.col("text").isNotNull(), F.size(T.tokens(F.col("text")))).cast("long").alias("tokens"))


_PAIRS = f"""WITH firsts AS (SELECT left(text, 20) AS s, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1),
  pairs AS (SELECT a.doc_id, f.first_id, a.text, b.text AS other FROM documents a JOIN firsts f ON left(a.text, 20) = f.s JOIN documents b ON b.doc_id = f.first_id
    WHERE a.doc_id <> f.first_id AND a.text IS NOT NULL),
  words AS (SELECT doc_id, first_id, list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda w: replace(lower(w), '’', '''')) AS a,
    list_transform(regexp_extract_all(other, '{_TOKEN}'), lambda w: replace(lower(w), '’', '''')) AS b FROM pairs),
  sets AS (SELECT doc_id, first_id, a, b, len(list_intersect(list_distinct(a), list_distinct(b))) AS shared, len(list_distinct(list_concat(a, b))) AS total FROM words)"""


@query(_PAIRS + " SELECT doc_id, first_id, CASE WHEN total = 0 THEN 1.0 ELSE shared / total::DOUBLE END AS overlap FROM sets")
def token_jaccard(spark, d):
    pairs = pairs_by_start(spark, d)
    a, b = (F.array_distinct(T.token_values(F.col(c))) for c in ("text", "other"))
    return pairs.select("doc_id", "first_id", T.overlap(a, b).alias("overlap"))


@query(_PAIRS + """ SELECT doc_id, first_id, len(list_distinct(list_filter(a, lambda w: NOT list_contains(b, w))))::INTEGER AS added,
  len(list_distinct(list_filter(b, lambda w: NOT list_contains(a, w))))::INTEGER AS removed
  FROM sets WHERE a <> b AND (CASE WHEN total = 0 THEN 1.0 ELSE shared / total::DOUBLE END) < 0.65 AND (len(a) >= 3 OR len(b) >= 3)""")
def lexical_difference(spark, d):
    out = compare.lexical(pairs_by_start(spark, d)).where("lexical_difference")
    return out.select("doc_id", "first_id", F.size("added").alias("added"), F.size("removed").alias("removed"))


_NEG = "['" + "','".join(w.replace("'", "''") for w in T.NEGATIONS_EN) + "']"


@query(f"""SELECT lang, sum(n)::BIGINT AS negations, count(*) FILTER (n > 0)::BIGINT AS documents FROM (SELECT lang,
    len(list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda w: list_contains({_NEG}, lower(w)))) AS n FROM documents) GROUP BY lang""")
def negation_inventory(spark, d):
    docs = table(spark, d, "documents").select("lang", T.negation_count(T.token_values(F.col("text")), "en").alias("n"))
    return docs.groupBy("lang").agg(F.sum("n").alias("negations"), F.count_if(F.col("n") > 0).alias("documents"))


@query(f"""WITH w AS (SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda w: list_contains({_NEG}, lower(w)))) AS n FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, n::INTEGER AS reference_negations, CASE WHEN n > 0 THEN 'abstain' ELSE 'difference' END AS state FROM w""")
def negation_change(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("It is not so. "), "text").alias("text"), F.col("text").alias("other"))
    return compare.lexical(docs, "en").select("doc_id", F.col("other_negations").alias("reference_negations"), F.col("negation_state").alias("state"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)</?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?>|&(?:[a-z]{2,8}|#[0-9]{2,6}|#x[0-9a-f]{2,5});'))::INTEGER AS matches
  FROM pages WHERE html IS NOT NULL AND regexp_matches(html, '(?i)</?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?>|&(?:[a-z]{2,8}|#[0-9]{2,6}|#x[0-9a-f]{2,5});')""")
def hygiene_markup(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.explode(T.hygiene(F.col("html"), F.lit("en"))).alias("i"))
    return pages.where("i.kind = 'markup'").select("page_id", F.col("i.count").alias("matches"))


@query("SELECT lang, count(*)::BIGINT AS rows, lang NOT IN ('en', 'ar') AS abstains FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_gate(spark, d):
    docs = table(spark, d, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("rows"))
    return docs.withColumn("abstains", ~T.language_base(F.col("lang")).isin("en", "ar"))


@query(r"""SELECT lang, count(*)::BIGINT AS rows, sum(len(regexp_extract_all(text, '\p{L}')))::BIGINT AS letters,
  sum(len(regexp_extract_all(text, '\p{L}')) - len(regexp_extract_all(regexp_replace(text, '[^\p{L}]', '', 'g'), '\p{Latin}')))::BIGINT AS outside FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def script_gate(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("lang", T.script_gate(F.col("text"), F.col("lang")).alias("g"))
    return docs.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("g.letters").alias("letters"), F.sum("g.outside").alias("outside"))


# Fixed expectations of the readings: two texts, a language, the state and the reasons.


_SAID, _GIVEN = "There are 5 kg. It must be. ", "There are 5000 g. It may not be. "


def _document_audit(spark, d):
    """Documents, without their digits, against copies of themselves that say one thing more."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    body = F.regexp_replace("text", "[0-9]+", "")
    rows = docs.select(
        F.col("lang").alias("file_id"), F.col("doc_id").alias("input_index"), F.col("doc_id").alias("row_number"), (F.col("doc_id") + 1).cast("string").alias("group_raw"),
        F.lit("1").alias("ordinal_raw"), F.concat(F.lit(_SAID), body).alias("text"),
    )
    reference = rows.withColumn("text", F.replace("text", F.lit(_SAID), F.lit(_GIVEN)))
    sizes = index.numbering(docs.select((F.col("doc_id") + 1).alias("grp"), F.lit(1).alias("n")))
    return A.audit(rows, sizes, reference, complete=False, candidate_language="en", reference_language="en", verified=True)


def _values_sql(said: str) -> str:
    return f"list_transform(regexp_extract_all('{said}' || body, '{_TOKEN}'), lambda w: replace(lower(w), '’', ''''))"


_AUDITED = f"""WITH t AS (SELECT lang, regexp_replace(text, '[0-9]+', '', 'g') AS body FROM documents WHERE text IS NOT NULL),
  w AS (SELECT lang, {_values_sql(_SAID)} AS a, {_values_sql(_GIVEN)} AS b FROM t),
  n AS (SELECT lang, len(list_filter(a, lambda x: list_contains({_NEG}, x))) AS ours, len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))::DOUBLE AS overlap FROM w),
  s AS (SELECT lang AS file_id, CASE WHEN ours = 0 OR overlap < 0.65 THEN 'needs_review' ELSE 'abstain' END AS status, CASE WHEN ours = 0 THEN 'difference' ELSE 'abstain' END AS negation_state, overlap < 0.65 AS lexical FROM n)"""


@query(_AUDITED + " SELECT file_id, status, 'equivalent' AS numeric, 'abstain' AS qualifier, negation_state, count(*)::BIGINT AS rows FROM s GROUP BY 1, 2, 5")
def document_audit(spark, d):
    """The whole audit on documents: quantities agree after conversion, a negation and a modal do not."""
    rows = _document_audit(spark, d).rows
    return rows.groupBy("file_id", "status", F.col("numeric_review.state").alias("numeric"), F.col("qualifier_review.state").alias("qualifier"), "negation_state").agg(F.count("*").alias("rows"))


@query(_AUDITED + """ SELECT file_id, count(*)::BIGINT AS total_rows, count(*)::BIGINT AS valid_rows, count(*)::BIGINT AS covered_ids, count(*)::BIGINT AS compared_rows, count(*) FILTER (status = 'needs_review')::BIGINT AS needs_review_rows,
  count(*) FILTER (status = 'abstain')::BIGINT AS abstain_rows, 0::BIGINT AS no_signal_rows, 0::BIGINT AS structural_findings, count(*) FILTER (negation_state = 'difference')::BIGINT AS n_potential_negation_change,
  count(*) FILTER (negation_state = 'abstain')::BIGINT AS n_negation_comparison_abstain, count(*)::BIGINT AS n_qualifier_comparison_abstain, count(*) FILTER (lexical)::BIGINT AS n_lexical_difference,
  (count(*) FILTER (negation_state = 'difference') + count(*) FILTER (lexical))::BIGINT AS comparison_findings, 0::BIGINT AS missing_ids, 100.0::DOUBLE AS coverage_percent, true AS structurally_complete, 'none' AS certification FROM s GROUP BY 1""")
def audit_summary(spark, d):
    return _document_audit(spark, d).summary.select(
        "file_id", "total_rows", "valid_rows", "covered_ids", "compared_rows", "needs_review_rows", "abstain_rows", "no_signal_rows", "structural_findings", "n_potential_negation_change",
        "n_negation_comparison_abstain", "n_qualifier_comparison_abstain", "n_lexical_difference", "comparison_findings", "missing_ids", "coverage_percent", "structurally_complete", "certification",
    )


@query(f"""WITH {_INDEX}, {_ROWS}, c AS (SELECT grp, ord, row_number, count(*) OVER (PARTITION BY grp, ord) AS copies, lag(ord) OVER (PARTITION BY grp ORDER BY row_number) AS before FROM rows)
  SELECT CASE WHEN copies > 1 OR ord < before THEN 'needs_review' ELSE 'abstain' END AS status, count(*)::BIGINT AS rows FROM c GROUP BY 1""")
def row_status(spark, d):
    """Statuses without a reference: structural findings need review, all else abstains."""
    report = A.audit(lines_as_rows(spark, d), index.numbering(order_sizes(spark, d)), complete=False)
    return report.rows.groupBy("status").agg(F.count("*").alias("rows"))


@query("""WITH f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label)
  SELECT a.vec_id, a.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a JOIN f USING (label) JOIN embeddings b ON b.vec_id = f.first_id WHERE a.vec_id <> b.vec_id""")
def cosine_pairs(spark, d):
    return _with_first(spark, d).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def _with_first(spark, d):
    vectors = table(spark, d, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    other = vectors.select(F.col("vec_id").alias("first_id"), F.col("embedding").alias("other"))
    pairs = vectors.join(first, "label").where("vec_id <> first_id").join(other, "first_id")
    return pairs.withColumn("similarity", semantic.cosine(F.col("embedding"), F.col("other")))


@query("""WITH f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label), s AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
    FROM embeddings a JOIN f USING (label) JOIN embeddings b ON b.vec_id = f.first_id WHERE a.vec_id <> b.vec_id)
  SELECT label, 'semantic_distance' AS code, count(*)::BIGINT AS rows FROM s WHERE s < 0.25 GROUP BY label""")
def semantic_distance(spark, d):
    scored = _with_first(spark, d).withColumn("truncated", F.lit(False))
    return semantic.distances(scored, 0.25).groupBy("label", "code").agg(F.count("*").alias("rows"))


_LOGITS = """WITH l AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE * 10) AS f, list_transform(embedding[4:6], lambda x: x::DOUBLE * 10) AS r FROM embeddings),
  e AS (SELECT vec_id, list_transform(f, lambda x: exp(x - list_max(f))) AS f, list_transform(r, lambda x: exp(x - list_max(r))) AS r FROM l),
  p AS (SELECT vec_id, list_transform(f, lambda x: x / list_sum(f)) AS f, list_transform(r, lambda x: x / list_sum(r)) AS r FROM e),
  s AS (SELECT vec_id, f, r, greatest(f[1], r[1]) AS c, least(f[2], r[2]) AS e, abs(f[2] - r[2]) AS g FROM p)"""


def _scores(spark, d):
    scaled = [F.transform(F.slice("embedding", k, 3), lambda x: x.cast("double") * 10) for k in (1, 4)]
    labels = ["contradiction", "entailment", "neutral"]
    rows = table(spark, d, "embeddings").select("vec_id", *[semantic.softmax(s, labels).alias(n) for s, n in zip(scaled, ("forward", "reverse"), strict=True)])
    return rows.withColumn("scores", semantic.both_ways(F.col("forward"), F.col("reverse")))


@query(_LOGITS + " SELECT vec_id, round(f[1], 9) AS contradiction, round(f[2], 9) AS entailment, round(f[3], 9) AS neutral FROM s")
def nli_softmax(spark, d):
    return _scores(spark, d).select("vec_id", *[F.round(f"forward.{x}", 9).alias(x) for x in semantic.LABELS])


@query(_LOGITS + """ SELECT vec_id, CASE WHEN c >= 0.65 THEN 'risk' WHEN g >= 0.45 AND e < 0.30 THEN 'risk' WHEN e >= 0.55 THEN 'no_signal' ELSE 'abstain' END AS outcome,
  CASE WHEN c >= 0.65 THEN 'potential_contextual_contradiction' WHEN g >= 0.45 AND e < 0.30 THEN 'potential_information_change'
    WHEN e >= 0.55 THEN 'no_context_signal_at_experimental_threshold' ELSE 'insufficient_context_or_model_confidence' END AS reason FROM s""")
def nli_classify(spark, d):
    rows = _scores(spark, d).withColumn("k", semantic.classified(F.col("scores"), F.lit(False)))
    return rows.select("vec_id", "k.outcome", "k.reason")


@query("""WITH c AS (SELECT quality::VARCHAR AS type, toxic = 1 AS expected, CASE WHEN doc_id > 500 THEN 'risk' WHEN quality = 1 THEN 'no_signal' ELSE 'abstain' END AS predicted FROM labels),
  r AS (SELECT type, count(*) AS cases, count(*) FILTER (expected AND predicted = 'risk') AS tp, count(*) FILTER (NOT expected AND predicted = 'risk') AS fp,
    count(*) FILTER (expected AND predicted <> 'risk') AS fn, count(*) FILTER (NOT expected AND predicted <> 'risk') AS tn, count(*) FILTER (predicted = 'abstain') AS known_abstentions
    FROM c GROUP BY ROLLUP (type))
  SELECT type, cases::BIGINT AS cases, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, known_abstentions::BIGINT AS known_abstentions,
    tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, tn / nullif(tn + fp, 0)::DOUBLE AS specificity FROM r""")
def confusion_rollup(spark, d):
    predicted = F.when(F.col("doc_id") > 500, "risk").when(F.col("quality") == 1, "no_signal").otherwise("abstain")
    cases = table(spark, d, "labels").select(
        F.col("quality").cast("string").alias("type"), (F.col("toxic") == 1).alias("expected_risk"), predicted.alias("predicted"), F.lit(True).alias("has_result")
    )
    return semantic.confusion(cases).select("type", "cases", "tp", "fp", "fn", "tn", "known_abstentions", "precision", "recall", "f1", "specificity")
