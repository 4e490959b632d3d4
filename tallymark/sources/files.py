"""Numbered files of any supported kind as one DataFrame of rows, read on the executors.

Files come through Spark's binary reader, so any store works; each is parsed whole by one
task. A file that can't be read without a guess gives one row with its error code and
nothing else: an explicit abstention.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from . import delimited, workbook, xml
from .matrix import Malformed, looks_like_table, rows_from_matrix

MAX_BYTES = 25 << 20
SCHEMA = (
    "file_id string, sha256 string, error string, warnings array<string>, input_index long, row_number long, "
    "group_raw string, ordinal_raw string, text string, raw_type string"
)
KINDS = ("csv", "tsv", "txt", "xml", "xlsx")


def parse_file(name: str, content: bytes, mapping: dict | None = None, strict: bool = True, sheet: str | None = None) -> tuple[list[dict], list[str]]:
    """Rows and warnings of one file, by its extension; raises Malformed."""
    kind = name.rpartition(".")[2].lower()
    if kind not in KINDS:
        raise Malformed("unsupported_kind", kind)
    if strict and len(content) > MAX_BYTES:
        raise Malformed("file_too_large")
    if not content:
        raise Malformed("empty_file")
    if kind == "xlsx":
        return rows_from_matrix(workbook.matrix(content, sheet), mapping, strict)
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Malformed("not_utf8") from e
    if kind == "xml":
        rows, warnings = rows_from_matrix(xml.matrix(text.removeprefix("﻿")), mapping, strict)
        return rows, warnings + (["passages_without_group"] if any(not r["group_raw"] for r in rows) else [])
    return rows_from_matrix(delimited.parse(text, "\t" if kind == "tsv" else None), mapping, strict)


def read_files(spark: SparkSession, path: str, mapping: dict | None = None, strict: bool = True, sheet: str | None = None) -> DataFrame:
    """Rows of all supported files under the path, and an error row for each file that was refused."""
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = parse_files(found.select("path", "content"), mapping, strict, sheet)
    # Spark's scans pass over empty files, which are refused like others
    listed = spark.createDataFrame([(re.sub(r"^(\w+):///", r"\1:/", f),) for f in found.inputFiles()], "path string")
    empty = listed.join(found.select("path"), "path", "left_anti").withColumn("content", F.lit(b""))
    return rows.unionByName(parse_files(empty, mapping, strict, sheet))


def parse_files(files: DataFrame, mapping: dict | None = None, strict: bool = True, sheet: str | None = None) -> DataFrame:
    """Rows of files (path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "long": pa.int64()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
        for batch in batches:
            for path, content in zip(*[batch.column(k).to_pylist() for k in (0, 1)], strict=True):
                content = content or b""
                base = {"file_id": path, "sha256": hashlib.sha256(content).hexdigest(), "error": None}
                try:
                    rows, warnings = parse_file(path, content, mapping, strict, sheet)
                    out = [base | {"warnings": warnings, "input_index": i} | r for i, r in enumerate(rows)]
                except Malformed as e:
                    out = [base | {"error": e.code, "warnings": []}]
                yield pa.RecordBatch.from_pylist(out, schema)

    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*KINDS))
    return wanted.select("path", "content").mapInArrow(run, SCHEMA)


def read_clean(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Large, well-formed delimited files by Spark's own reader, which splits nothing but fails on malformed records."""
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


PREVIEW = "file_id string, error string, delimiter string, table boolean, place int, cells array<string>"


def preview(files: DataFrame, most: int = 20) -> DataFrame:
    """The first records of files (path, content) as they are, with the delimiter found and whether they look like a table with headings.

    Nothing is mapped or refused for its columns; a file that can't be read gives its error.
    """
    ship(files.sparkSession)

    def first(name: str, content: bytes) -> tuple[str | None, list[list]]:
        kind = name.rpartition(".")[2].lower()
        if kind == "xlsx":
            return None, workbook.matrix(content)[:most]
        try:
            text = content.decode("utf-8").removeprefix("﻿")
        except UnicodeDecodeError as e:
            raise Malformed("not_utf8") from e
        if kind == "xml":
            return None, xml.matrix(text)[:most]
        delimiter = "\t" if kind == "tsv" else delimited.detect(text)
        return delimiter, delimited.parse(text, delimiter, most)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        columns = [("file_id", pa.string()), ("error", pa.string()), ("delimiter", pa.string()), ("table", pa.bool_()), ("place", pa.int32()), ("cells", pa.list_(pa.string()))]
        for batch in batches:
            out = []
            for path, content in zip(*[batch.column(k).to_pylist() for k in (0, 1)], strict=True):
                try:
                    delimiter, records = first(path, content or b"")
                except Malformed as e:
                    out.append({"file_id": path, "error": e.code})
                    continue
                seems = bool(records) and looks_like_table([str(x or "") for x in records[0]])
                for i, r in enumerate(records):
                    out.append({"file_id": path, "delimiter": delimiter, "table": seems, "place": i, "cells": [None if x is None else str(x) for x in r]})
            yield pa.RecordBatch.from_pylist(out, pa.schema(columns))

    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*KINDS))
    return wanted.select("path", "content").mapInArrow(run, PREVIEW)


class ParseWorkbook:
    """A table function for SQL: the cells of a workbook's first sheet, one row a cell that isn't empty."""

    def eval(self, content):
        if content is not None:
            for i, row in enumerate(workbook.matrix(bytes(content))):
                for j, cell in enumerate(row):
                    if cell is not None:
                        yield i, j, str(cell)


def register(spark: SparkSession) -> None:
    """Make ``parse_workbook(content)`` known to SQL, as a table function."""
    ship(spark)
    spark.udtf.register("parse_workbook", F.udtf(ParseWorkbook, returnType="row int, column int, value string"))
