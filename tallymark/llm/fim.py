"""Fill-in-middle transformation: texts cut at two ranks, their three parts dealt anew.

The units of a text lie in an indexable skip list. Its lowest lane has a node for every unit,
each lane above one for FAN nodes of the lane below, and every node carries its width in units
and in code points. A rank is reached from the top: nodes are passed while the units so far
don't exceed it, then the search goes one lane down; the code points passed are where to cut.
A cut touches at most FAN nodes a lane, however long the text.

Units are code points, or run from one match of a pattern to the next; what lies before the
first match belongs to the first unit. The draws of a text come from a digest of its doc_id.

A null text is empty, and an empty text is plain: its output is the text itself. So is a text
that holds one of the marks, as it couldn't be rebuilt. A null doc_id draws by the empty
string; rows that share an id draw alike; repeated rows give repeated rows; an empty table
gives none. Texts of any length are cut whole. Other columns pass through, whatever their
names; one named ``fim`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import columns_of, ready, sliced, table

#: Nodes of a lane under one node of the lane above.
FAN = 32
#: Before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = "1"
#: Texts in a hundred that are cut, and those of them whose suffix comes first.
CUT, SUFFIX_FIRST = 90, 20

_FIM = "n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Units of one text, from the width of each in code points."""

    def __init__(self, points: np.ndarray):
        self.lanes = [(np.ones(len(points), np.int64), np.asarray(points, np.int64))]
        while len(self.lanes[-1][0]) > FAN:
            starts = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(np.add.reduceat(width, starts) for width in self.lanes[-1]))

    def seek(self, rank: int) -> int:
        """Code points before the unit of that rank, which is at most the number of units."""
        node = units = points = 0
        for unit_widths, point_widths in reversed(self.lanes):
            ends = units + np.cumsum(unit_widths[node : node + FAN])
            passed = int(np.searchsorted(ends, rank, side="right"))
            if passed:
                units = int(ends[passed - 1])
                points += int(point_widths[node : node + passed].sum())
            node = (node + passed) * FAN
        return points


def widths(text: str, units: regex.Pattern | None = None) -> np.ndarray:
    """The code points of each unit of the text, in order."""
    if units is None or not text:
        return np.ones(len(text), np.int64)
    starts = np.fromiter((m.start() for m in units.finditer(text)), np.int64)
    return np.diff(np.r_[0, starts[1:], len(text)])


def transform(
    docs: DataFrame, keep: list[str] | None = None, units: str | None = None, seed: str = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``) and ``fim``: struct of n units, form, prefix_chars, middle_chars, output.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); widths are
    code points, null if plain. ``units`` is a pattern, null for code points. Of a hundred texts
    ``cut`` are cut, and of a hundred cut ones ``suffix_first`` take the spm form.
    """
    ready(docs.sparkSession)
    kept = docs.select(*[f"`{c.replace('`', '``')}`" for c in (docs.columns if keep is None else keep) if c != "fim"])
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]
    sent = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in kept.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.array(*draws).alias("draws"))

    def parted(text: str, draw: list[int], pattern: regex.Pattern | None) -> dict:
        listed = SkipList(widths(text, pattern))
        n = len(listed.lanes[0][0])
        if not text or any(m in text for m in marks) or draw[2] % 100 >= cut:
            return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
        first, second = (listed.seek(rank) for rank in sorted(d % (n + 1) for d in draw[:2]))
        prefix, middle, suffix = marks[0] + text[:first], marks[2] + text[first:second], marks[1] + text[second:]
        spm = draw[3] % 100 < suffix_first
        output = suffix + prefix + middle if spm else prefix + suffix + middle
        return {"n": n, "form": "spm" if spm else "psm", "prefix_chars": first, "middle_chars": second - first, "output": output}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pattern = regex.compile(units) if units is not None else None
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for batch in sliced(batches):
            texts, drawn = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = [parted(t or "", d, pattern) for t, d in zip(texts, drawn, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["row", "fim"])

    schema = StructType([StructField("row", kept.schema), StructField("fim", StructType.fromDDL(_FIM))])
    return sent.mapInArrow(run, schema).select(*columns_of("row", kept), "fim")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of.

    No text that was cut holds a mark, and no mark ends as another begins, so the first
    match of each is the one that was set.
    """
    quoted = [f"\\Q{m}\\E" for m in marks]

    def parts(second: int) -> tuple[Column, Column, Column]:
        """The three parts in their order, of which the second follows that mark."""
        first, rest = (F.split(output, quoted[second], 2)[k] for k in (0, 1))
        return first, *[F.split(rest, quoted[2], 2)[k] for k in (0, 1)]

    prefix, suffix, middle = parts(1)
    psm = F.concat(F.substr(prefix, F.lit(len(marks[0]) + 1)), middle, suffix)
    suffix, prefix, middle = parts(0)
    spm = F.concat(prefix, middle, F.substr(suffix, F.lit(len(marks[1]) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text"), keep=["doc_id"])
    told = [F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    again = restored(F.col("fim.output"), F.col("fim.form"))
    return out.select("doc_id", *told, F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
ranks AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS r2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, least(r1, r2) AS a, greatest(r1, r2) - least(r1, r2) AS m, substring(text, 1, least(r1, r2)) AS prefix,
    substring(text, least(r1, r2) + 1, greatest(r1, r2) - least(r1, r2)) AS middle, substring(text, greatest(r1, r2) + 1) AS suffix FROM ranks)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
