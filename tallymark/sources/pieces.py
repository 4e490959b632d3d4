"""Delimited files of any size under the strict rules, read in ranges.

Spark's text source cuts files into ranges of bytes at line feeds. As long as a file keeps the
rules, every quote opens or closes a cell (a doubled one does both), so a range begins inside
a quoted cell if the quotes before it are odd in number: a running sum over one row a range.
Each range is then parsed by itself; one that begins or ends inside a cell is given the quote
that it lacks. A first pass counts quotes, a second one records up to the first fault, and
running sums number the records for a third. The lines at both ends of a range that are parts
of one record go to one place by where it begins, so only what crosses a border is moved.

Results are those of the one-task parser whatever the size of the ranges: the same records
with the same numbers, or the same fault in the same record, which refuses its whole file.
A record has to fit in memory, a file needn't.

A folder of Spark's part files can be read as one file that is cut between lines: the number of
a part is the high end of where its ranges begin, so all else is as in a file of one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from ..plans.shipping import ship
from .delimited import detect, records_of
from .matrix import MAX_ROWS, Layout, Malformed

#: Ranges up to which their table is broadcast (some 200 bytes each); files beyond need larger ranges.
MOST_RANGES = 200_000
#: Characters from which a file's delimiter is found, and those that are parsed at once.
HEAD, TOGETHER = 1 << 20, 1 << 20
#: What a part's number is multiplied by where its ranges begin; no part is as large.
PART = 1 << 40

_COUNTED = "file_id string, start long, quotes long, bad long, head string"
_CHECKED = "file_id string, start long, ended long, meets boolean, error string, fault long"
_RECORDS = "file_id string, start long, record long, cells array<string>, piece string, crosses long"


def _lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Rows (file_id, start, line): lines in the order of each range, null where they are no UTF-8."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    file_id, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if parts:
        # cheap functions, as they run for every line
        name = F.substring_index(file_id, "/", -1)
        number = F.substring_index(F.substr(name, F.lit(len("part-") + 1)), "-", 1).cast("long")
        start = F.when(name.startswith("part-"), number * PART + start).otherwise(F.raise_error(F.concat(F.lit("no part of Spark's: "), name)))
        file_id = F.left(file_id, F.length(file_id) - F.length(name) - 1)
    return text.select(file_id.alias("file_id"), start.alias("start"), F.when(F.is_valid_utf8("value"), F.col("value")).alias("line"))


def _by_range(batches: Iterator) -> Iterator:
    """(first batch of the range, key columns' values, lines) of runs of lines of one range; keys come before ``line``."""
    import numpy as np

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            keys = tuple(batch.column(k)[int(a)].as_py() for k in range(batch.num_columns - 1))
            yield keys != before, keys, batch.column(batch.num_columns - 1).slice(int(a), int(b - a))
            before = keys


def _whole(batches: Iterator, begin, line, end) -> Iterator:
    """Results of ``begin(keys)``, ``line(state, text)`` for each line, and ``end(state)`` for each range."""
    state = None
    for new, keys, lines in _by_range(batches):
        if new:
            if state is not None:
                yield from end(state)
            state = begin(keys)
        for text in lines.to_pylist():
            yield from line(state, text)
    if state is not None:
        yield from end(state)


def _batched(rows: Iterator, kinds: list[tuple]) -> Iterator:
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + (sum(map(len, row[3])) if len(row) > 3 and isinstance(row[3], list) else 0)
        if len(held) >= 4096 or size > 8 * TOGETHER:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], [n for n, _ in kinds])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def _kinds(schema: str) -> list[tuple]:
    import pyarrow as pa

    types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    return [(n, types[t]) for n, t in (c.split() for c in schema.split(", "))]


def _counted(lines: DataFrame, heads: bool) -> DataFrame:
    """One row a range: its quotes, lines that are no UTF-8, and, if asked for, the head of the file or part that it is the first of."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        first = lambda start: heads and start % PART == 0

        def rows() -> Iterator:
            state = None
            for new, (file_id, start), block in _by_range(batches):
                if new:
                    if state is not None:
                        yield (*state[:4], "\n".join(state[4]) if first(state[1]) else None)
                    state = [file_id, start, 0, 0, [], 0]
                state[2] += pc.sum(pc.count_substring(block, '"')).as_py() or 0
                state[3] += block.null_count
                if first(start) and state[5] < HEAD:
                    for text in block.to_pylist():
                        state[4].append(text or "")
                        state[5] += len(text or "") + 1
                        if state[5] >= HEAD:
                            break
            if state is not None:
                yield (*state[:4], "\n".join(state[4]) if first(state[1]) else None)

        yield from _batched(rows(), _kinds(_COUNTED))

    return lines.mapInArrow(run, _COUNTED)


class _Range:
    """A range as it is read: lines that make whole records are parsed when there are enough of them."""

    def __init__(self, keys: tuple):
        self.file_id, self.start, self.delimiter, self.inside, self.base, self.chain = keys
        self.carried = self.inside  # the lines so far belong to a record from before
        self.held, self.size, self.safe = [], 0, 0
        self.ended, self.fault = 0, None
        self.meets = False  # whether a record ends with a line

    def take(self, text: str) -> bool:
        """One more line; whether enough whole records are held to parse them."""
        self.held.append(text)
        self.size += len(text) + 1
        if text.count('"') % 2:
            self.inside = not self.inside
        if not self.inside:
            self.safe, self.meets = len(self.held), True
        return not self.inside and self.size >= TOGETHER


def _delimiter(file_id: str, head: str) -> str:
    return "\t" if file_id.lower().endswith(".tsv") else detect(head)


def _checked(lines: DataFrame) -> DataFrame:
    """One row a range of lines (file_id, start, delimiter, inside, base, chain, line): records that end in it, or its first fault."""

    def parsed(state: _Range, opened: bool) -> None:
        """Parse what is held; ``opened``: the last record goes on in the next range."""
        if state.fault is None and state.held:
            text = ('"' if state.carried else "") + "".join(t + "\n" for t in state.held) + ('"' if opened else "")
            try:
                state.ended += len(records_of(text, state.delimiter)) - opened
            except Malformed as e:
                state.fault = (e.code, state.ended + int(e.detail))
        state.carried, state.held, state.size = False, [], 0

    def line(state: _Range, text: str) -> Iterator:
        if state.fault is None and state.take(text):
            parsed(state, False)
        yield from ()

    def end(state: _Range) -> Iterator:
        parsed(state, state.inside)
        yield (state.file_id, state.start, state.ended, state.meets, *(state.fault or (None, None)))

    def run(batches: Iterator) -> Iterator:
        yield from _batched(_whole(batches, _Range, line, end), _kinds(_CHECKED))

    return lines.mapInArrow(run, _CHECKED)


def _parsed(lines: DataFrame) -> DataFrame:
    """Records of ranges of files without faults; pieces of those that cross a border, by the range where they begin."""

    def whole(state: _Range, n: int) -> Iterator:
        """Records of the first n lines held."""
        text = "".join(t + "\n" for t in state.held[:n])
        del state.held[:n]
        state.size, state.safe = sum(len(t) + 1 for t in state.held), 0
        for cells in records_of(text, state.delimiter):
            state.ended += 1
            yield (state.file_id, state.start, state.base + state.ended, cells, None, None)

    def line(state: _Range, text: str) -> Iterator:
        full = state.take(text)
        if state.carried and not state.inside:
            # ends what began before; more records may end in this line
            piece = "".join(t + "\n" for t in state.held)
            yield (state.file_id, state.start, None, None, piece, state.chain)
            state.ended += len(records_of('"' + piece, state.delimiter))
            state.carried, state.held, state.size, state.safe = False, [], 0, 0
        elif full:
            yield from whole(state, len(state.held))

    def end(state: _Range) -> Iterator:
        if state.safe and not state.carried:
            yield from whole(state, state.safe)
        if state.held:
            piece = "".join(t + "\n" for t in state.held)
            if state.carried:
                yield (state.file_id, state.start, None, None, piece, state.chain)
            else:
                yield (state.file_id, state.start, state.base + state.ended + 1, None, piece, state.start)

    def run(batches: Iterator) -> Iterator:
        yield from _batched(_whole(batches, _Range, line, end), _kinds(_RECORDS))

    return lines.mapInArrow(run, _RECORDS)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records (file_id, start, record, cells) of the pieces that a border cut."""
    by_border = pieces.groupBy("file_id", "crosses", "delimiter").agg(
        F.min("record").alias("first"), F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("text")
    )

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator:
            for batch in batches:
                for r in batch.to_pylist():
                    for k, cells in enumerate(records_of(r["text"], r["delimiter"])):
                        yield (r["file_id"], r["start"], r["first"] + k, cells)

        yield from _batched(rows(), _kinds(_RECORDS)[:4])

    return by_border.mapInArrow(run, ", ".join(_RECORDS.split(", ")[:4]))


class Records:
    """``records`` (file_id, start, record, cells) of the files that keep the rules, ``faults`` (file_id, error, record) of the others.

    ``start`` is where the range begins in which a record does. A fault's record is null if it concerns no record.
    """

    def __init__(self, records: DataFrame, faults: DataFrame):
        self.records, self.faults = records, faults


def read_records(spark: SparkSession, path: str, delimiter: str | None = None, parts: bool = False) -> Records:
    """The records of all delimited files under the path; the delimiter is found for each file, unless it is given.

    With ``parts`` each folder is one file, in the parts that Spark wrote it in, by their numbers.
    """
    ship(spark)
    lines = _lines(spark, path, parts)
    counted = written(_counted(lines, delimiter is None), "ranges")
    if counted.count() > MOST_RANGES:
        raise ValueError(f"over {MOST_RANGES} ranges: raise spark.sql.files.maxPartitionBytes")
    if parts and counted.groupBy("file_id", "start").count().where("count > 1").head(1):
        raise ValueError("two parts of one number in a folder")
    # one row a range
    before = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    if delimiter is None:
        # a file's first part may be shorter than its head
        heads = counted.where("head IS NOT NULL").withColumn("at", F.coalesce(F.sum(F.length("head") + 1).over(before), F.lit(0))).where(F.col("at") < HEAD)
        heads = heads.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "head"))), lambda x: x["head"]), "\n").alias("head"))
        heads = heads.select("file_id", F.udf(_delimiter)("file_id", "head").alias("delimiter"))
    else:
        heads = counted.select("file_id", F.lit(delimiter).alias("delimiter")).distinct()
    states = counted.select("file_id", "start", "bad", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"), ((F.sum("quotes").over(Window.partitionBy("file_id")) % 2) == 1).alias("unclosed"))
    states = written(states.join(heads, "file_id"), "range-states")
    readable = states.join(states.where("bad > 0").select("file_id").distinct(), "file_id", "left_anti")

    def with_state(known: DataFrame) -> DataFrame:
        out = lines.join(F.broadcast(known.select("file_id", "start", "delimiter", "inside", "base", "chain")), ["file_id", "start"])
        return out.select("file_id", "start", "delimiter", "inside", "base", "chain", "line")

    checked = _checked(with_state(readable.withColumns({c: F.lit(0).cast("long") for c in ("base", "chain")})))
    numbered = F.coalesce(F.sum("ended").over(before), F.lit(0)).cast("long")
    checked = checked.join(readable.select("file_id", "start", "delimiter", "inside", "unclosed"), ["file_id", "start"])
    # where the record begins that is open at a range's start: the last range before that isn't wholly inside a cell
    chain = F.last(F.when(F.col("meets") | ~F.col("inside"), F.col("start")), ignorenulls=True).over(before)
    checked = written(checked.withColumn("base", numbered).withColumn("chain", F.coalesce(chain, F.lit(0).cast("long"))), "ranges-checked")
    told = checked.groupBy("file_id").agg(
        F.min_by(F.struct("error", (F.col("base") + F.col("fault")).alias("record")), F.when(F.col("error").isNotNull(), F.col("start"))).alias("first"),
        F.max("unclosed").alias("unclosed"), (F.sum("ended") + 1).alias("open"),
    )
    fault = F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("unclosed"), F.struct(F.lit("unclosed_quote").alias("error"), F.col("open").alias("record")))
    faults = told.select("file_id", fault.alias("f")).where("f IS NOT NULL").select("file_id", "f.error", "f.record")
    # Spark's scans pass over empty files
    names = {re.sub(r"^(\w+):///", r"\1:/", f.rpartition("/")[0] if parts else f) for f in lines.inputFiles()}
    listed = spark.createDataFrame([(f,) for f in sorted(names)], "file_id string")
    none = listed.join(counted.select(F.regexp_replace("file_id", r"^(\w+):///", "$1:/").alias("file_id")).distinct(), "file_id", "left_anti").select("file_id", F.lit("empty_file").alias("error"), F.lit(None).cast("long").alias("record"))
    unread = states.where("bad > 0").select("file_id", F.lit("not_utf8").alias("error"), F.lit(None).cast("long").alias("record")).distinct()
    clean = checked.join(faults.select("file_id"), "file_id", "left_anti")
    parsed = _parsed(with_state(clean))
    pieces = parsed.where("piece IS NOT NULL").join(F.broadcast(clean.select("file_id", "delimiter").distinct()), "file_id")
    whole = parsed.where("piece IS NULL").select("file_id", "start", "record", "cells")
    return Records(whole.unionByName(_joined(pieces)), faults.unionByName(unread).unionByName(none))


def _layouts(records: DataFrame, mapping: dict | None) -> DataFrame:
    """Rows (file_id, layout, error, warnings): where the columns of each file are, from its first records."""
    filled = F.exists("cells", lambda c: F.length(F.trim(c)) > 0)
    lead = records.where(filled).groupBy("file_id").agg(F.min("record").alias("lead"))
    near = records.join(F.broadcast(lead), "file_id").where(F.col("record").between(F.col("lead") - 1, F.col("lead") + 50))
    sample = near.groupBy("file_id", "lead").agg(F.array_sort(F.collect_list(F.struct("record", "cells"))).alias("sample"))
    schema = "file_id string, layout string, error string, warnings array<string>"

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator:
            for batch in batches:
                for r in batch.to_pylist():
                    listed = [x["cells"] for x in r["sample"] if x["record"] >= r["lead"]]
                    try:
                        layout = Layout(listed[0], listed[1:], mapping, r["lead"] - 1)
                        yield (r["file_id"], layout.to_json(), None, layout.warnings)
                    except Malformed as e:
                        yield (r["file_id"], None, e.code, [])

        yield from _batched(rows(), _kinds(schema))

    return sample.mapInArrow(run, schema)


def read_rows(spark: SparkSession, path: str, mapping: dict | None = None, strict: bool = False) -> DataFrame:
    """Numbered rows of all delimited files under the path, as ``files.read_files`` gives them, and an error row for each file refused.

    ``strict`` adds the limits on rows, columns and text, which refuse large files.
    """
    read = read_records(spark, path)
    records = written(read.records, "records")
    found = written(_layouts(records, mapping), "layouts")  # one row a file, and files are no more than ranges
    schema = "file_id string, start long, record long, error string, group_raw string, ordinal_raw string, text string, raw_type string"
    columns = ("group_raw", "ordinal_raw", "text", "raw_type")

    def run(batches: Iterator) -> Iterator:
        layouts: dict[str, Layout] = {}

        def rows() -> Iterator:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["layout"] not in layouts:
                        layouts.clear()
                        layouts[r["layout"]] = Layout.from_json(r["layout"])
                    layout = layouts[r["layout"]]
                    if r["record"] <= layout.before:
                        continue
                    at = (r["file_id"], r["start"], r["record"])
                    try:
                        row = layout.row(r["cells"], r["record"], strict)
                    except Malformed as e:
                        yield (*at, e.code, None, None, None, None)
                        continue
                    if row is not None:
                        yield (*at, None, *[row[c] for c in columns])

        yield from _batched(rows(), _kinds(schema))

    known = F.broadcast(found.where("layout IS NOT NULL").select("file_id", "layout"))
    told = records.join(known, "file_id").select("file_id", "start", "record", "cells", "layout").mapInArrow(run, schema)
    per_range = written(
        told.groupBy("file_id", "start").agg(
            F.count_if(F.col("error").isNull()).alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("record", "error"))).alias("fault")
        ), "rows-by-range",
    )
    per_file = per_range.groupBy("file_id").agg(F.sum("n").alias("n"), F.min("fault").alias("fault"))
    per_file = found.join(per_file, "file_id", "left")
    n = F.coalesce("n", F.lit(0))
    error = F.coalesce("error", "fault.error", F.when(n == 0, F.lit("no_data_rows")), F.when(F.lit(strict) & (n > MAX_ROWS), F.lit("too_many_rows")))
    per_file = written(per_file.select("file_id", error.alias("error"), "warnings"), "files")
    # files without any record that isn't blank
    nothing = records.select("file_id").distinct().join(found, "file_id", "left_anti").select("file_id", F.lit("empty_file").alias("error"))
    refused = read.faults.select("file_id", "error").unionByName(nothing).unionByName(per_file.where("error IS NOT NULL").select("file_id", "error"))
    before = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("file_id", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    kept = told.join(F.broadcast(per_file.where("error IS NULL").select("file_id", "warnings")), "file_id").join(F.broadcast(offsets), ["file_id", "start"])
    within = F.row_number().over(Window.partitionBy("file_id", "start").orderBy("record")) - 1
    rows = kept.select("file_id", F.lit(None).cast("string").alias("error"), "warnings", (F.col("offset") + within).cast("long").alias("input_index"), F.col("record").alias("row_number"), *columns)
    empty = {c: F.lit(None).cast("string") for c in columns}
    errors = refused.select("file_id", "error", F.array().cast("array<string>").alias("warnings"), *[F.lit(None).cast("long").alias(c) for c in ("input_index", "row_number")], *[v.alias(k) for k, v in empty.items()])
    return rows.unionByName(errors)
