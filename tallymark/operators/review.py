"""Review decisions, case progress, execution states, gates, provenance, run manifest and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

INSPECTED = ("structural", "comparison")
DECISIONS = ("accept", "reject", "refer")
KEPT_UNAPPLIED = 500
HISTORY = 12
#: Keywords that are broadcast; with more of them the questions' words are moved.
SMALL_ENTRIES = 100_000
TEACHING, TEACHING_MARK = "synthetic-teaching", "SYNTHETIC TRAINING TEXT"
_HEX64 = "^[a-f0-9]{64}$"


def fingerprint(findings: DataFrame, file_sha256: str | None = None) -> DataFrame:
    """Findings with the digest that decisions bind to; file-wide and duplicate ones bind to the file's bytes too.

    Ids and emission order are no evidence; the rows, identifiers and evidence are.
    """
    told = F.to_json(F.struct("code", "type", "severity", "ids", "row_numbers", "evidence"))
    wide = (F.col("type") == "structural") & ((F.size("row_numbers") == 0) | (F.col("code") == "duplicate_id"))
    if file_sha256 is None:
        file = F.lit("")
    else:
        file = F.when(wide, F.lit(file_sha256)).otherwise("")
    return findings.withColumn("fingerprint", F.sha2(F.concat_ws("|", file, told), 256))


def valid_decisions(decisions: DataFrame) -> DataFrame:
    """Saved decisions with a well-formed fingerprint, a known decision and a reason."""
    fine = F.col("fingerprint").rlike(_HEX64) & F.col("decision").isin(*DECISIONS) & (F.length(T.trimmed(F.coalesce("note", F.lit("")))) > 0)
    return decisions.where(fine)


def parsed_store(stores: DataFrame) -> DataFrame:
    """Rows (store, corrupt, fingerprint, decision, note, saved_at) of stores (store, raw): a JSON object of decisions by fingerprint.

    Text that is no such object is corrupt, told by one row without a fingerprint; entries
    that aren't well-formed are left out.
    """
    entry = "struct<decision: string, note: string, savedAt: string>"
    known = stores.withColumn("m", F.from_json("raw", f"map<string, {entry}>"))
    blank = F.coalesce(F.trim("raw"), F.lit("")) == ""
    corrupt = ~blank & (F.col("m").isNull() | ~F.trim("raw").startswith("{"))
    bad = known.where(corrupt).select("store", F.lit(True).alias("corrupt"), *[F.lit(None).cast("string").alias(c) for c in ("fingerprint", "decision", "note", "saved_at")])
    rows = known.where(~blank & ~corrupt).select("store", F.lit(False).alias("corrupt"), F.explode("m").alias("fingerprint", "e"))
    rows = rows.select("store", "corrupt", "fingerprint", "e.decision", "e.note", F.col("e.savedAt").alias("saved_at"))
    return valid_decisions(rows).unionByName(bad)


def review_identity(reports: DataFrame) -> DataFrame:
    """Reports with ``identity``: a digest of scope, languages and the reference's identity. Files are no part of it, so reviews outlive them."""
    parts = ["schema", "scope", "language", "source_kind", "book", "title", "edition", "reference_language", "author", "publisher"]
    given = [F.col(c) if c in reports.columns else F.lit(None).cast("string").alias(c) for c in parts]
    return reports.withColumn("identity", F.sha2(F.to_json(F.struct(*given), {"ignoreNullFields": "false"}), 256))


def merged_store(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both stores by fingerprint; the current one wins."""
    both = current.withColumn("__old", F.lit(0)).unionByName(legacy.withColumn("__old", F.lit(1)))
    first = Window.partitionBy("fingerprint").orderBy("__old", F.col("saved_at").desc_nulls_last(), "decision")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__old")


def applied(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with the decision of their fingerprint; one decision may settle several findings."""
    return findings.join(decisions.select("fingerprint", "decision", "note", "saved_at"), "fingerprint", "left")


def unapplied(decisions: DataFrame, findings: DataFrame, limit: int = KEPT_UNAPPLIED) -> DataFrame:
    """The newest decisions that match no finding: what a store keeps of the past."""
    rest = decisions.join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return rest.orderBy(F.col("saved_at").desc_nulls_last(), "fingerprint").limit(limit)


def from_other_file(decision_sha: Column, current_sha: Column) -> Column:
    """Whether a decision was made on a file of other content; an unknown origin isn't another one."""
    return F.coalesce(decision_sha.rlike(_HEX64) & current_sha.rlike(_HEX64) & (decision_sha != current_sha), F.lit(False))


def resolution(type_: Column, decision: Column) -> Column:
    """What became of a case; findings of other types are no cases."""
    return (
        F.when(~type_.isin(*INSPECTED), "evidence_signal_not_counted").when(decision == "accept", "resolved_needs_correction")
        .when(decision == "reject", "resolved_closed").when(decision == "refer", "unresolved_referred").otherwise("unresolved")
    )


def progress(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts of cases by resolution, of findings (type, decision)."""
    state = resolution(F.col("type"), F.col("decision"))
    case = F.col("type").isin(*INSPECTED)
    decided = F.coalesce(F.col("decision").isin("accept", "reject"), F.lit(False))
    return findings.withColumn("__s", state).groupBy(*by).agg(
        F.count_if(case).alias("cases"), F.count_if(case & decided).alias("resolved"),
        F.count_if(F.col("__s") == "resolved_needs_correction").alias("accepted"), F.count_if(F.col("__s") == "resolved_closed").alias("closed"),
        F.count_if(F.col("__s") == "unresolved_referred").alias("referred"), F.count_if(F.col("__s") == "unresolved").alias("undecided"),
        F.count_if(~case).alias("evidence_signals"), F.count_if(~case & ~decided).alias("evidence_unresolved"),
    )


def run_state(runs: DataFrame) -> DataFrame:
    """Runs (requested, skipped, cancelled, failed, eligible, processed, incomplete, truncated) with their state for the reader."""
    c = F.col
    state = (
        F.when(~c("requested"), "not_requested").when(c("skipped"), "not_run").when(c("cancelled"), "cancelled").when(c("failed"), "failed")
        .when((c("eligible") == 0) & (c("processed") == 0), "no_pairs").when(c("processed") == 0, "failed")
        .when(c("processed") < c("eligible"), "partial").when(c("incomplete"), "inconsistent").when(c("truncated") > 0, "truncated").otherwise("complete")
    )
    return runs.withColumn("run_state", state)


def layer_state(runs: DataFrame) -> DataFrame:
    """The same runs with their state for the record, whose tests come in another order, and their issues."""
    c = F.col
    issues = F.array_compact(
        F.array(
            F.when((c("processed") > 0) & ~c("requested"), "results_without_execution"),
            F.when((c("processed") > 0) & (c("processed") == c("eligible")) & c("incomplete"), "explicit_incomplete"),
            F.when(c("reported") != c("processed"), "reported_processed_mismatch") if "reported" in runs.columns else F.lit(None).cast("string"),
        )
    )
    state = (
        F.when(F.size("issues") > 0, "inconsistent").when(~c("requested"), "not_requested").when(c("cancelled"), "cancelled").when(c("failed"), "failed")
        .when(c("skipped"), "not_run").when(c("eligible") == 0, "no_pairs").when(c("processed") == 0, "not_run")
        .when(c("processed") < c("eligible"), "partial").when(c("truncated") > 0, "truncated").otherwise("complete")
    )
    return runs.withColumn("issues", issues).withColumn("layer_state", state)


def gates(dossier: DataFrame) -> DataFrame:
    """Rows (..., gate, status) of dossiers, one a gate.

    A dossier has complete_scope, structural, identity_known, uncovered, mismatched,
    limited, run_state, unresolved, accepted, and optionally manifest_inconsistent,
    revision_open, team_total, team_approved and team_manager (null: not part of it).
    """
    c = F.col
    hold, note = F.lit("hold"), F.lit("recorded")
    run = (
        F.when(c("run_state").isin("partial", "inconsistent", "cancelled", "failed", "not_run"), hold)
        .when(c("run_state").isin("no_pairs", "truncated"), "limited").otherwise(note)
    )
    base = [
        ("scope", F.when(c("complete_scope"), note).otherwise("limited")),
        ("structure", F.when(c("structural") > 0, hold).otherwise("passed")),
        ("source_identity", F.when(c("identity_known"), note).otherwise(hold)),
        ("source_authentication", F.lit("required")),
        ("source_coverage", F.when((c("uncovered") > 0) | (c("mismatched") > 0), hold).when(c("limited"), "limited").otherwise(note)),
        ("ai_execution", run),
        ("case_resolution", F.when(c("unresolved") > 0, hold).when(c("limited"), "limited").otherwise(note)),
        ("corrections", F.when(c("accepted") > 0, hold).otherwise(note)),
    ]
    more = {
        "run_integrity": ("manifest_inconsistent", F.when(c("manifest_inconsistent"), hold).otherwise(note) if "manifest_inconsistent" in dossier.columns else None),
        "revision_followup": ("revision_open", F.when(c("revision_open") > 0, hold).otherwise(note) if "revision_open" in dossier.columns else None),
        "team_oversight": ("team_total", F.when(~c("team_manager") | (c("team_approved") < c("team_total")), hold).otherwise(note) if "team_total" in dossier.columns else None),
    }
    listed = [F.struct(F.lit(i).alias("place"), F.lit(g).alias("gate"), s.alias("status"), F.lit(True).alias("part")) for i, (g, s) in enumerate(base)]
    for i, (g, (needs, s)) in enumerate(more.items(), len(base)):
        if s is not None:
            listed.append(F.struct(F.lit(i).alias("place"), F.lit(g).alias("gate"), s.alias("status"), c(needs).isNotNull().alias("part")))
    listed.append(F.struct(F.lit(99).alias("place"), F.lit("expert_signoff").alias("gate"), F.lit("required").alias("status"), F.lit(True).alias("part")))
    return dossier.select("*", F.inline(F.array(*listed))).where("part").drop("part")


def verdict(gated: DataFrame, by: list[str]) -> DataFrame:
    """needs_work where any gate holds; the rest is ready for a human, never certified."""
    return gated.groupBy(*by).agg(F.when(F.max(F.col("status") == "hold"), "needs_work").otherwise("ready_for_human_review").alias("verdict")).withColumn("certificate", F.lit(False))


# --- provenance -----------------------------------------------------------------------------


def official_url(url: Column, host: str | Column) -> Column:
    """The path of an https URL of the host without port, user, query or fragment; null otherwise."""
    host = F.lit(host) if isinstance(host, str) else host
    pattern = F.concat(F.lit("^https://"), F.replace(host, F.lit("."), F.lit("[.]")), F.lit(r"(/[^?#\s]*)$"))
    return F.when(F.rlike(url, pattern), F.call_function("regexp_extract", url, pattern, F.lit(1)))


def iso_round_trip(text: Column) -> Column:
    """Whether a text is an ISO timestamp with zone that names a real time."""
    return F.coalesce(T.iso_time(text).isNotNull(), F.lit(False))


#: What a retrieved row can fail, in the order of the checks.
ROW_FAILURES = (
    "invalid_global_provenance", "reference_id_invalid", "reference_id_duplicate", "reference_book_mismatch", "reference_locator_mismatch",
    "reference_source_url_invalid", "reference_retrieval_time_invalid", "reference_row_not_verified", "reference_source_kind_mismatch",
    "normalized_hash_invalid", "raw_hash_invalid", "reference_text_empty", "normalized_hash_mismatch", "raw_hash_mismatch",
)


def retrieved_rows_checked(rows: DataFrame, host: str, book: int, source_kind: str, sound: bool) -> DataFrame:
    """Keyed retrieved rows with their failures; a row without any is eligible. Authority is never asserted.

    Rows bring book, locator, source_url, retrieved_at, verification_status, source_kind,
    normalized_sha256, raw_sha256 and optionally raw_text; hashes are computed again.
    """
    c = F.col
    sha = "(?i)^[a-f0-9]{64}$"
    counted = _with_claims(rows)
    copies = c("__claims")
    path = official_url(c("source_url"), host)
    one, all_ = F.concat(F.lit(f"/v1/translation/{book}/"), c("grp"), F.lit("/"), c("ord")), F.concat(F.lit(f"/v1/translation/{book}/"), c("grp"))
    text = T.meaningful(c("text"))
    hashed, raw = c("normalized_sha256").rlike(sha), c("raw_sha256").rlike(sha)
    given = c("raw_text") if "raw_text" in rows.columns else F.lit(None).cast("string")
    tests = (
        F.lit(not sound), ~c("valid"), c("valid") & (copies > 1), ~c("book").eqNullSafe(F.lit(book)), ~c("locator").eqNullSafe(c("id")),
        ~F.coalesce((path == one) | (path == all_), F.lit(False)), ~iso_round_trip(c("retrieved_at")), ~c("verification_status").eqNullSafe(F.lit("verified")),
        c("source_kind").isNotNull() & (c("source_kind") != source_kind), ~hashed, ~raw, ~text,
        text & hashed & (F.sha2("text", 256) != F.lower("normalized_sha256")), given.isNotNull() & raw & (F.sha2(given, 256) != F.lower("raw_sha256")),
    )
    failures = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), name) for name, t in zip(ROW_FAILURES, tests, strict=True)]))
    out = counted.withColumn("failures", failures).drop("__claims")
    return out.withColumn("eligible", F.size("failures") == 0).withColumn("scholarly_approval", F.lit("none"))


def _with_claims(rows: DataFrame) -> DataFrame:
    """Keyed rows with ``__claims``: how many valid ones have their identifier, counted before the join; rows without one are spread over all tasks."""
    claimed = rows.where("valid").groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__claims"))
    spread = F.coalesce("id", F.concat(F.lit("#"), F.xxhash64("row_number", "group_raw", "ordinal_raw").cast("string")))
    return rows.withColumn("__id", spread).join(claimed, "__id", "left").drop("__id")


def comparable(rows: DataFrame) -> DataFrame:
    """Keyed reference rows with can_compare and why not: an identifier of their own and a text are all that it takes."""
    out = _with_claims(rows)
    told = T.meaningful(F.col("text"))
    problem = F.when(~F.col("valid"), "comparison_id_invalid").when(F.col("__claims") > 1, "comparison_id_duplicate").when(~told, "comparison_text_empty")
    return out.withColumn("comparison_problem", problem).withColumn("can_compare", problem.isNull()).drop("__claims")


def declared_rows_checked(rows: DataFrame, source_kind: str, synthetic: bool = False) -> DataFrame:
    """Keyed rows of an uploaded or a teaching reference with their standing. No declaration makes a source a verified one.

    A teaching reference is consistent if it says that it is synthetic and every row bears
    the teaching mark; that is one aggregate over all rows. Its rows may be inspected for
    teaching; all others, and those of uploads, for experimental comparison only.
    """
    out = comparable(rows)
    if source_kind == TEACHING:
        marked = F.coalesce(F.col("text").startswith(TEACHING_MARK), F.lit(False))
        all_marked = rows.agg(F.coalesce(F.bool_and(marked), F.lit(False)).alias("sound"))  # one row
        out = out.join(F.broadcast(all_marked.withColumn("sound", F.col("sound") & F.lit(synthetic))), how="cross")
        authority = F.when(F.col("sound"), "authored-teaching-only").otherwise("unverified-teaching-claim")
    else:
        out = out.withColumn("sound", F.lit(False))
        authority = F.lit("user-declared")
    eligible = F.when(~F.col("can_compare"), "not-eligible").when(F.col("sound"), "teaching-inspection-only").otherwise("experimental-text-comparison-only")
    return out.select(
        "*", F.when(F.col("sound"), "verified").otherwise("unverified").alias("status"), authority.alias("authority"), eligible.alias("eligibility"),
        F.lit("none").alias("scholarly_approval"),
    )


def attributions(sources: DataFrame) -> DataFrame:
    """Sources (author, translator, publisher, edition) with what each says: recorded but unchecked, or unknown."""
    author = F.coalesce(F.nullif(T.known_attribution(F.col("author")), F.lit("")), F.nullif(T.known_attribution(F.col("translator")), F.lit("")))
    known = {"author": author} | {c: F.nullif(T.known_attribution(F.col(c)), F.lit("")) for c in ("publisher", "edition")}
    rest = [c for c in sources.columns if c not in ("author", "translator", "publisher", "edition")]
    status = [F.when(v.isNotNull(), "recorded-unchecked").otherwise("unknown").alias(f"{c}_status") for c, v in known.items()]
    return sources.select(*rest, *[v.alias(c) for c, v in known.items()], *status)


# --- manifest and history ---------------------------------------------------------------------


def source_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of keyed rows (with in_scope): read, valid, invalid, out of scope, empty, identifiers, copies, usable."""
    told = T.meaningful(F.col("text"))
    ids = rows.where("in_scope").groupBy(*by, "id").agg(F.count("*").alias("n"), F.max(told).alias("told"))
    per_id = ids.groupBy(*by).agg(
        F.count("*").alias("unique_ids"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.count_if((F.col("n") == 1) & F.col("told")).alias("usable_ids")
    )
    per_row = rows.groupBy(*by).agg(
        F.count("*").alias("read"), F.count_if("in_scope").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("valid") & ~F.col("in_scope")).alias("out_of_scope"), F.count_if(~told).alias("empty"),
    )
    return per_row.join(per_id, by, "left").fillna(0, ["unique_ids", "duplicate_rows", "usable_ids"])


def change_reasons(runs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Runs (input_sha, output_sha, context_sha, method, scope, counts, layers) with why each differs from the one before."""
    before = Window.partitionBy(*by).orderBy(order)
    kinds = {"input_sha": "input", "output_sha": "output", "context_sha": "context", "method": "method", "scope": "scope", "counts": "coverage", "layers": "execution"}
    changed = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.lag(c).over(before)), f"{k}_changed") for c, k in kinds.items() if c in runs.columns])
    )
    first = F.row_number().over(before) == 1
    reasons = F.when(first, F.array(F.lit("first_run"))).when(F.size(changed) == 0, F.array(F.lit("same_evidence"))).otherwise(changed)
    return runs.withColumn("change_reasons", reasons)


def history(first: DataFrame, second: DataFrame, by: list[str], limit: int = HISTORY) -> DataFrame:
    """Two histories (run_id, created_at, ...) by run, the second's entry winning; the newest runs, oldest first."""
    both = first.withColumn("__s", F.lit(0)).unionByName(second.withColumn("__s", F.lit(1)))
    once = Window.partitionBy(*by, "run_id").orderBy(F.col("__s").desc(), F.col("created_at").desc())
    newest = Window.partitionBy(*by).orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    out = both.withColumn("__n", F.row_number().over(once)).where("__n = 1").withColumn("age", F.row_number().over(newest))
    return out.where(F.col("age") <= limit).drop("__n", "__s")


# --- retrieval --------------------------------------------------------------------------------


def best_entry(questions: DataFrame, entries: DataFrame, step: int = 1) -> DataFrame:
    """The entry of each question: entries (entry, place, boundary, keyword, steps and optionally title and reading), questions (question_id, text).

    A phrase in the text scores 3; a keyword of one word 1, if a stemmed word of the text is
    its stem or begins with it (with a long stem, or with a short ending); a title equal to
    the whole text 5. An entry of the current step gets half a point more. Any boundary
    entry that matches comes before all others; ties go to the first. Words meet keywords by
    their beginnings and phrases by what joins their first two words, so both are equi-joins.

    ``reading`` says how a phrase is looked for: anywhere in the folded text (null), in whole
    words of it ("words"), or as it is written, but for case ("letters").
    """
    reading = F.col("reading") if "reading" in entries.columns else F.lit(None).cast("string")
    asked = questions.select("question_id", T.folded(F.col("text")).alias("form"), F.lower("text").alias("written")).where("form <> ''")
    listed = entries.select("entry", "place", "boundary", "steps", T.folded(F.col("keyword")).alias("keyword"), reading.alias("reading"), F.lower("keyword").alias("as_written")).where("keyword <> ''").distinct()
    small = F.broadcast if listed.count() <= SMALL_ENTRIES else lambda side: side
    words = asked.select("question_id", F.explode(F.array_distinct(F.transform(F.split("form", " "), T.stem))).alias("word"))
    # every beginning that a keyword's stem may be: long ones, or those that leave a short ending
    starts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.when((n >= 4) | (F.length("word") - n <= 2), F.left("word", n)))
    words = words.select("question_id", F.explode(F.array_compact(starts)).alias("stem"))
    single = listed.where(~F.contains("keyword", F.lit(" "))).withColumn("stem", T.stem(F.col("keyword")))
    # two words may have one beginning, but few are those of a keyword
    hits = words.join(small(single), "stem").select("question_id", "entry", "place", "boundary", "steps", "keyword", F.lit(1).alias("points")).distinct()
    # a phrase within a text has the end of its first word and the start of its second where two words meet
    seam = lambda a, b: F.concat(F.right(a, F.lit(1)), F.lit(" "), F.left(b, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(0), F.size("all") - 2), lambda i: seam(F.get("all", i), F.get("all", i + 1)))
    seams = asked.withColumn("all", F.split("form", " ")).where(F.size("all") > 1).select("question_id", "form", "written", F.explode(F.array_distinct(pairs)).alias("seam"))
    phrases = listed.where(F.contains("keyword", F.lit(" "))).withColumn("parts", F.split("keyword", " "))
    phrases = phrases.withColumn("seam", seam(F.get("parts", 0), F.get("parts", 1)))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    within = F.when(F.col("reading") == "words", F.contains(spaced(F.col("form")), spaced(F.col("keyword")))).when(F.col("reading") == "letters", F.contains("written", F.col("as_written")))
    found = seams.join(small(phrases), "seam").where(within.otherwise(F.contains("form", F.col("keyword"))))
    hits = hits.unionByName(found.select("question_id", "entry", "place", "boundary", "steps", "keyword", F.lit(3).alias("points")))
    if "title" in entries.columns:
        titles = entries.select("entry", "place", "boundary", "steps", T.folded(F.col("title")).alias("form")).where("form <> ''").distinct()
        titled = asked.join(titles, "form").select("question_id", "entry", "place", "boundary", "steps", F.lit("").alias("keyword"), F.lit(5).alias("points"))
        hits = hits.unionByName(titled)
    scored = hits.groupBy("question_id", "entry", "place", "boundary").agg(
        (F.sum("points") + F.when(F.max(F.array_contains("steps", step)), 0.5).otherwise(0.0)).alias("score")
    )
    rank = F.struct(F.col("boundary").cast("int"), F.when(F.col("boundary"), 0.0).otherwise(F.col("score")), -F.col("place"))
    best = scored.groupBy("question_id").agg(F.max_by(F.struct("entry", "score"), rank).alias("best"))
    out = questions.join(best, "question_id", "left")
    return out.select("question_id", F.coalesce("best.entry", F.lit("fallback")).alias("entry"), F.col("best").isNotNull().alias("matched"))
