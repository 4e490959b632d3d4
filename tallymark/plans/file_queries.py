"""Queries on whole files: their coverage, reading them in pieces, stores and streams of what is found; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import coverage, intervals, packages, structure
from ..sources import landed, pieces
from ..streaming import workflow
from ..streaming.store import FindingsStore
from .shared import new_path
from .tables import line_tasks, order_index, table

QUERIES, SQL = {}, {}
#: Bytes of text that one task writes, about, of files that have to be in order.
PART_BYTES = 32 << 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def flags_as_files(spark, d):
    """Order lines as rows of three files, one a return flag; orders are groups."""
    at = (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("long")
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("file_id"), at.alias("input_index"), at.alias("row_number"), F.col("l_orderkey").cast("string").alias("group_raw"),
        F.col("l_linenumber").cast("string").alias("ordinal_raw"), F.col("l_linestatus").alias("text"),
    )


_FLAGS = """idx AS (SELECT l_orderkey AS grp, max(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1), files AS (SELECT DISTINCT l_returnflag AS file_id FROM lineitem),
  rows AS (SELECT l_returnflag AS file_id, l_orderkey AS grp, l_linenumber::BIGINT AS ord, l_linestatus AS text FROM lineitem),
  gone AS (SELECT file_id, grp, ord FROM (SELECT file_id, grp, unnest(range(1, n + 1)) AS ord FROM idx, files) ANTI JOIN rows USING (file_id, grp, ord)),
  gaps AS (SELECT file_id, grp, min(ord) AS first, max(ord) AS last, count(*) AS size FROM
    (SELECT *, ord - row_number() OVER (PARTITION BY file_id, grp ORDER BY ord) AS island FROM gone) GROUP BY file_id, grp, island)"""


@query(f"WITH {_FLAGS} SELECT file_id, grp, first, last, size::BIGINT AS size FROM gaps")
def missing_by_file(spark, d):
    """Every file against every order: what it lacks, by bitmaps."""
    sizes, many = order_index(spark, d), line_tasks(spark, d)
    return coverage.missing_runs(structure.keyed(flags_as_files(spark, d), sizes, many=many), sizes, many=many)


@query(f"""WITH {_FLAGS}, scope AS (SELECT o_orderkey AS grp FROM orders WHERE o_orderstatus = 'F'),
  told AS (SELECT *, grp IN (FROM scope) AS inside FROM rows),
  want AS (SELECT sum(n)::BIGINT AS n FROM idx WHERE grp IN (FROM scope)),
  c AS (SELECT file_id, count(*) AS total_rows, count(DISTINCT (grp, ord)) FILTER (inside) AS covered, count(DISTINCT (grp, ord)) FILTER (NOT inside) AS outside FROM told GROUP BY 1)
  SELECT file_id, total_rows::BIGINT AS total_rows, total_rows::BIGINT AS valid_rows, n AS expected_ids, covered::BIGINT AS covered_ids, (n - covered)::BIGINT AS missing_ids, outside::BIGINT AS out_of_scope_ids,
    (total_rows - covered - outside)::BIGINT AS repeated_rows, round((covered * 100 / n)::DECIMAL(20,10), 2)::DOUBLE AS coverage_percent FROM c, want""")
def coverage_by_file(spark, d):
    """Counts of each file against the finished orders, as bits."""
    sizes = order_index(spark, d)
    scope = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("grp"))
    return coverage.coverage(structure.keyed(flags_as_files(spark, d), sizes, scope, line_tasks(spark, d)), sizes, scope)


@query(f"""WITH {_FLAGS}, dup AS (SELECT file_id, grp, ord, count(*) AS c FROM rows GROUP BY ALL HAVING count(*) > 1),
  want AS (SELECT sum(n)::BIGINT AS n FROM idx), d AS (SELECT file_id, count(*) AS ids, sum(c - 1) AS extra FROM dup GROUP BY 1),
  g AS (SELECT file_id, sum(size) AS missing, count(DISTINCT grp) AS groups FROM gaps GROUP BY 1), r AS (SELECT file_id, count(*) AS total_rows FROM rows GROUP BY 1)
  SELECT file_id, total_rows::BIGINT AS total_rows, n AS expected_ids, (n - missing)::BIGINT AS covered_ids, missing::BIGINT AS missing_ids, round(((n - missing) * 100 / n)::DECIMAL(20,10), 2)::DOUBLE AS coverage_percent,
    coalesce(ids, 0)::BIGINT AS duplicate_ids, coalesce(extra, 0)::BIGINT AS duplicate_rows, (groups + coalesce(ids, 0))::BIGINT AS structural_findings, false AS structurally_complete
  FROM r JOIN g USING (file_id) LEFT JOIN d USING (file_id), want""")
def complete_audit(spark, d):
    """The audit of three files that claim to be complete, one summary row each."""
    report = A.audit(flags_as_files(spark, d), order_index(spark, d), many=line_tasks(spark, d))
    return report.summary.select(
        "file_id", "total_rows", "expected_ids", "covered_ids", "missing_ids", "coverage_percent", "duplicate_ids", "duplicate_rows", "structural_findings", "structurally_complete"
    )


def _quoted(column):
    return F.concat(F.lit('"'), F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, ''))::BIGINT AS n FROM documents")
def delimited_ranges(spark, d):
    """Documents as delimited files, texts with all their lines and quotes, read again in ranges."""
    path = new_path(spark, "delimited")
    table(spark, d, "documents").select(F.concat_ws(",", _quoted(F.col("doc_id")), F.coalesce("lang", F.lit("")), _quoted(F.col("text"))).alias("value")).write.text(path)
    cell = [F.get("cells", F.lit(k)) for k in range(3)]
    records = pieces.read_records(spark, path, ",").records
    return records.select(cell[0].alias("doc_id"), cell[1].alias("lang"), F.md5(cell[2]).alias("text_md5"), F.length(cell[2]).cast("long").alias("n"))


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE lang IS NOT NULL)
  SELECT lang, CASE WHEN lang = 'en' THEN 'quote_in_bare_cell' ELSE 'text_after_quote' END AS error, min(n)::BIGINT AS record FROM r WHERE doc_id % 97 = 96 GROUP BY 1""")
def delimited_faults(spark, d):
    """A file of each language in which some records break a rule: it is refused for the first of them, by its number."""
    path = new_path(spark, "delimited")
    broken = F.when(F.col("doc_id") % 97 != 96, F.lit("")).when(F.col("lang") == "en", F.lit(',a "so-called" cell')).otherwise(F.lit("x"))
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    value = F.concat(F.col("doc_id").cast("string"), F.lit(","), _quoted(F.col("text")), broken)
    # one file a language, in order; its size sets the number of its parts, so no task holds a language
    many = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    rows = docs.select("doc_id", "lang", value.alias("value")).repartitionByRange(many, "lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    rows.select("lang", "value").write.partitionBy("lang").text(path)
    faults = pieces.read_records(spark, path, ",", parts=True).faults
    return faults.select(F.regexp_extract("file_id", "lang=([^/]*)$", 1).alias("lang"), "error", "record")


_LANDED = """answers AS (SELECT conv_id + 1 AS grp, count(*) AS n, count(DISTINCT turn) AS turns, min(turn) AS low, max(turn) AS high, bool_and(coalesce(trim(text), '') <> '') AS told FROM conversations GROUP BY 1),
  bad AS (SELECT grp FROM answers WHERE n > 286 OR turns < n OR low < 0 OR high > 285 OR NOT told)"""


def _land(spark, d):
    """Conversations as answers of a service, landed in two drops; the second sends a fifth of the groups again, with a mark."""
    landed.register(spark)
    path = new_path(spark, "landed")
    turns = table(spark, d, "conversations")

    def answers(text):
        item = F.struct((F.col("turn") + 1).cast("int").alias("ayah_number"), text.alias("translation_text"))
        # the texts of one answer of the service, which holds 286 at most
        return turns.groupBy((F.col("conv_id") + 1).cast("long").alias("grp")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("answer")).withColumn("book", F.lit(7).cast("long"))

    answers(F.col("text")).write.format(landed.FORMAT).mode("append").save(path)
    answers(F.concat("text", F.lit(" *"))).where("grp % 5 = 0").write.format(landed.FORMAT).mode("append").save(path)
    return path


@query(f"""WITH {_LANDED} SELECT conv_id + 1 AS grp, (turn + 1)::BIGINT AS ord, CASE WHEN conv_id % 5 = 4 THEN text || ' *' ELSE text END AS html, CASE WHEN conv_id % 5 = 4 THEN 1 ELSE 0 END::BIGINT AS drop, NULL::VARCHAR AS error
    FROM conversations WHERE conv_id + 1 NOT IN (FROM bad) AND conv_id + 1 >= 3
  UNION ALL SELECT grp, NULL, NULL, CASE WHEN grp % 5 = 0 THEN 1 ELSE 0 END::BIGINT, 'invalid_identifier_or_text' FROM bad WHERE grp >= 3""")
def landed_answers(spark, d):
    """The last answer of each group by the data source, which takes the filter on groups and opens no other files."""
    path = _land(spark, d)
    read = landed.pushing(spark).read.format(landed.PUSHING).load(path).where("grp >= 3")
    return landed.newest(read).select("grp", "ord", "html", "drop", "error")


@query(f"""WITH {_LANDED}, sent AS (SELECT conv_id + 1 AS grp, 0 AS drop FROM conversations WHERE conv_id + 1 NOT IN (FROM bad) UNION ALL SELECT conv_id + 1, 1 FROM conversations WHERE conv_id % 5 = 4 AND conv_id + 1 NOT IN (FROM bad))
  SELECT drop::BIGINT AS drop, count(*)::BIGINT AS texts, count(DISTINCT grp)::BIGINT AS groups FROM sent GROUP BY 1""")
def landed_stream(spark, d):
    """The drops as a stream, read to its end."""
    path = _land(spark, d)
    base = new_path(spark, "landed-stream")

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    stream = spark.readStream.format(landed.FORMAT).load(path)
    stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").where("error IS NULL")
    return rows.groupBy("drop").agg(F.count("*").alias("texts"), F.countDistinct("grp").alias("groups"))


@query("""SELECT user_id AS file_id, event_type AS layer, count(*)::BIGINT AS findings, sum(event_id)::BIGINT AS ids, CASE WHEN user_id % 3 = 0 AND event_type IN ('click', 'error') THEN 1 ELSE 0 END AS "commit"
  FROM events WHERE NOT (user_id % 3 = 0 AND event_type IN ('click', 'error') AND event_id % 2 = 1) GROUP BY 1, 2, 5""")
def rerun_findings(spark, d):
    """Findings of a first run, of which a second one replaces two layers of some files; a third broke off before its manifest."""
    events = table(spark, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("layer"), "event_id")
    store = FindingsStore(spark, new_path(spark, "findings"))
    store.commit(events, events)
    again = events.where("file_id % 3 = 0 AND layer IN ('click', 'error')")
    store.commit(again.where("event_id % 2 = 0"), again)
    store._stage(events.limit(0), events, 2, None)
    return store.read().groupBy("file_id", "layer", "commit").agg(F.count("*").alias("findings"), F.sum("event_id").alias("ids"))


def _review_messages(spark, d):
    """Events as messages about the case of their user: sign-ups assign, clicks submit, purchases approve, the rest returns."""
    kind = F.when(F.col("event_type") == "signup", "assign").when(F.col("event_type") == "click", "submit").otherwise("judge")
    decision = F.when(kind == "submit", F.element_at(F.array(*[F.lit(x) for x in workflow.DECISIONS]), (F.col("event_id") % 3 + 1).cast("int")))
    verdict = F.when(kind == "judge", F.when(F.col("event_type") == "purchase", "approved").otherwise("returned"))
    note = F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("note "), F.col("event_id").cast("string")))
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("case_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("message_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"),
        decision.alias("decision"), verdict.alias("verdict"), note.alias("note"), F.when(F.col("user_id") % 4 == 0, "high").otherwise("low").alias("severity"),
    )


_REVIEW = """WITH RECURSIVE m AS (SELECT user_id::VARCHAR AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts AS moment,
    CASE event_type WHEN 'signup' THEN 'assign' WHEN 'click' THEN 'submit' ELSE 'judge' END AS kind, ['accept', 'reject', 'refer'][event_id % 3 + 1] AS decision,
    CASE WHEN event_type = 'purchase' THEN 'approved' ELSE 'returned' END AS verdict, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'note ' || event_id END AS note, user_id % 4 = 0 AS high FROM events),
  s AS (SELECT case_id, 0::BIGINT AS n, 'unassigned' AS stage, NULL::VARCHAR AS decision, NULL::VARCHAR AS note, NULL::TIMESTAMP AS sent, NULL::VARCHAR AS verdict, NULL::VARCHAR AS vnote, NULL::TIMESTAMP AS judged,
      0 AS applied, 0 AS skipped, 0 AS refused FROM (SELECT DISTINCT case_id FROM m)
    UNION ALL SELECT case_id, n, CASE WHEN o <> 'applied' THEN stage WHEN kind = 'assign' THEN 'assigned' WHEN kind = 'submit' THEN 'submitted' ELSE mverdict END,
      CASE WHEN o <> 'applied' OR kind = 'judge' THEN decision WHEN kind = 'submit' THEN mdecision END, CASE WHEN o <> 'applied' OR kind = 'judge' THEN note WHEN kind = 'submit' THEN mnote END,
      CASE WHEN o <> 'applied' OR kind = 'judge' THEN sent WHEN kind = 'submit' THEN moment END, CASE WHEN o <> 'applied' OR kind = 'submit' THEN verdict WHEN kind = 'judge' THEN mverdict END,
      CASE WHEN o <> 'applied' OR kind = 'submit' THEN vnote WHEN kind = 'judge' THEN mnote END, CASE WHEN o <> 'applied' OR kind = 'submit' THEN judged WHEN kind = 'judge' THEN moment END,
      applied + (o = 'applied')::INT, skipped + (o = 'skipped')::INT, refused + (o = 'refused')::INT
    FROM (SELECT s.case_id, m.n, s.stage, s.decision, s.note, sent, s.verdict, vnote, judged, applied, skipped, refused, kind, moment, m.decision AS mdecision, m.verdict AS mverdict, m.note AS mnote,
        CASE kind WHEN 'assign' THEN CASE WHEN stage IN ('unassigned', 'assigned', 'returned') THEN 'applied' ELSE 'refused' END
          WHEN 'submit' THEN CASE WHEN stage = 'unassigned' OR m.note = '' THEN 'refused' WHEN stage = 'approved' OR coalesce(moment <= sent, false) THEN 'skipped' ELSE 'applied' END
          ELSE CASE WHEN stage NOT IN ('submitted', 'approved', 'returned') OR s.decision IS NULL THEN 'refused'
            WHEN m.note = '' AND (m.verdict = 'returned' OR (s.decision = 'reject' AND high)) THEN 'refused' WHEN coalesce(judged > moment, false) THEN 'skipped' ELSE 'applied' END END AS o
      FROM s JOIN m ON m.case_id = s.case_id AND m.n = s.n + 1))
  SELECT case_id, stage, decision, note, verdict, vnote AS verdict_note, applied::BIGINT AS applied, skipped::BIGINT AS skipped, refused::BIGINT AS refused
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC) AS k FROM s) WHERE k = 1"""
_REVIEWED = ["case_id", "stage", "decision", "note", "verdict", "verdict_note", "applied", "skipped", "refused"]


@query(_REVIEW)
def review_cases(spark, d):
    """What each case comes to after all its messages, by the rules for submissions and verdicts."""
    return workflow.reviewed(_review_messages(spark, d)).select(*_REVIEWED)


@query(_REVIEW)
def stream_reviews(spark, d):
    """The same as a stateful stream over messages that come in the order of their ids, each sent twice."""
    own = workflow.stateful(spark)
    base = new_path(spark, "reviews")
    rows = _review_messages(own, d)
    # a message far ahead, so that the watermark passes all others
    end = rows.agg(F.lit("end").alias("case_id"), F.lit("end").alias("message_id"), F.lit("none").alias("kind"), (F.max("at") + F.expr("interval 900 days")).alias("at"))
    rows.unionByName(rows).write.parquet(f"{base}/in")

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    def run():
        stream = workflow.reviewed(own.readStream.schema(rows.schema).parquet(f"{base}/in"), "800 days")
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    run()
    end.write.mode("append").parquet(f"{base}/in")
    run()
    return workflow.last(own.read.option("basePath", f"{base}/out").parquet(f"{base}/out")).select(*_REVIEWED)


_SPANS = """p AS (SELECT l_partkey % 10 AS grp, l_orderkey AS ord, l_linenumber FROM lineitem),
  i AS (SELECT o_custkey % 10 AS grp, o_orderkey AS first, o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 2000 ELSE o_orderkey % 5 END AS last FROM orders)"""


def _spans(spark, d):
    points = table(spark, d, "lineitem").select((F.col("l_partkey") % 10).alias("grp"), F.col("l_orderkey").alias("ord"))
    wide = F.when(F.col("o_orderkey") % 50 == 0, 2000).otherwise(F.col("o_orderkey") % 5)
    return points, table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("grp"), F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + wide).alias("last"))


@query(f"WITH {_SPANS} SELECT grp, count(*)::BIGINT AS rows, count(*) FILTER (EXISTS (SELECT 1 FROM i WHERE i.grp = p.grp AND p.ord BETWEEN i.first AND i.last))::BIGINT AS inside FROM p GROUP BY 1")
def rows_in_intervals(spark, d):
    """Order lines inside any of their group's many intervals, which overlap."""
    points, spans = _spans(spark, d)
    return intervals.marked(points, spans, ["grp"], "ord", "inside").groupBy("grp").agg(F.count("*").alias("rows"), F.count_if("inside").alias("inside"))


@query(f"WITH {_SPANS} SELECT p.grp AS grp, count(*)::BIGINT AS pairs, sum(p.ord - i.first)::BIGINT AS distance FROM p JOIN i ON i.grp = p.grp AND p.ord BETWEEN i.first AND i.last GROUP BY 1")
def interval_pairs(spark, d):
    """Every pair of a line and an interval of its group that holds it."""
    points, spans = _spans(spark, d)
    return intervals.joined(points, spans, ["grp"], "ord").groupBy("grp").agg(F.count("*").alias("pairs"), F.sum(F.col("ord") - F.col("first")).alias("distance"))


def _packages(spark, d):
    """A submission of each user with an item for each of the user's events; those of eight users in ten break a rule."""
    k = F.col("user_id") % 10
    item = F.struct(F.sha2(F.col("event_id").cast("string"), 256).alias("fingerprint"), F.col("event_type").alias("decision"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
    users = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    text = lambda wrong, at, right: F.when(k == at, F.lit(wrong)).otherwise(F.lit(right))
    made = F.to_json(F.struct(
        text("another", 1, packages.FORMAT).alias("format"), F.when(k == 2, 7).otherwise(1).alias("version"), text("letter", 3, "submission").alias("kind"), text("short", 4, "0" * 16).alias("projectId"),
        F.lit("a" * 64).alias("runKey"), F.struct(F.when(k == 5, F.lit("nobody")).otherwise(F.concat(F.lit("m-"), F.lpad(F.col("user_id").cast("string"), 8, "0"))).alias("memberId")).alias("from"),
        F.when(k != 6, F.col("items")).alias("items"),
    ))
    content = F.when(k == 7, F.substring(made, 1, 50)).when(k == 8, F.concat(made, F.repeat(F.lit(" "), packages.MOST_BYTES))).otherwise(made)
    return users.select(F.col("user_id").cast("string").alias("name"), F.encode(content, "UTF-8").alias("content"))


@query("""SELECT user_id::VARCHAR AS name, CASE user_id % 10 WHEN 1 THEN 'not_team_file' WHEN 2 THEN 'version' WHEN 3 THEN 'kind' WHEN 4 THEN 'ids' WHEN 5 THEN 'from' WHEN 6 THEN 'shape' WHEN 7 THEN 'invalid_json' WHEN 8 THEN 'too_large' END AS refusal
  FROM (SELECT DISTINCT user_id FROM events)""")
def package_refusals(spark, d):
    """Each user's package with what it is refused for."""
    return packages.parsed(_packages(spark, d)).select("name", "refusal")


@query("""SELECT 'm-' || lpad(user_id::VARCHAR, 8, '0') AS reviewer_id, sha256(event_id::VARCHAR) AS fingerprint, event_type AS decision, 'note ' || event_id AS note FROM events WHERE user_id % 10 IN (0, 9)""")
def package_items(spark, d):
    """The items of the packages that aren't refused."""
    return packages.items(packages.parsed(_packages(spark, d))).select("reviewer_id", "fingerprint", "decision", "note")
