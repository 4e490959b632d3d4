"""A data source for landed answers of a reference service: batch, stream and write, in numbered drops.

A drop is a folder ``drop=N`` of files, each the service's answer for one group of a book, as
it was sent. A writer's tasks write files of their own names; the driver lists those that
count in the drop's manifest, which is written last and moved into place, so what failed,
was tried twice or isn't finished is never read. Drops are never changed. A stream's offset
is the number of the last drop, and filters on book, group and drop are taken by the source:
they choose files by the manifests, and what they leave out isn't opened.

An answer is a JSON list of objects with ``ayah_number`` and ``translation_text``. One that
isn't, is empty or over long, repeats a number, or has a number or text that can't be used,
gives one row with its error instead, as its other texts can't be trusted either.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..plans.shipping import ship

FORMAT, PUSHING = "landed_answers", "landed_answers_pushing"
SCHEMA = "drop long, book long, grp long, ord long, html string, error string, answer_sha256 string"
#: Fixed value: the most texts of one answer.
MOST_TEXTS = 286
#: Bytes of answers that a task reads, about.
TASK_BYTES = 32 << 20

_MANIFEST = "_manifest.json"


def _store(path: str):
    """The file system of a path and the path in it; any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _drops(path: str) -> list[int]:
    """The numbers of finished drops."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    named = {int(x.base_name[5:]): x.path for x in found if x.base_name.startswith("drop=") and x.base_name[5:].isdigit()}
    return sorted(n for n, at in named.items() if store.get_file_info(posixpath.join(at, _MANIFEST)).type == fs.FileType.File)


def _files(path: str, drop: int) -> list[dict]:
    store, root = _store(path)
    with store.open_input_stream(posixpath.join(root, f"drop={drop}", _MANIFEST)) as f:
        return [x | {"drop": drop} for x in json.loads(f.read())]


def answered(content: bytes) -> tuple[list[tuple[int, str]], str | None]:
    """(number, text) of each text of an answer, or what makes it unusable."""
    try:
        items = json.loads(content)
    except ValueError:
        return [], "not_json"
    if not isinstance(items, list) or not items:
        return [], "no_texts"
    if len(items) > MOST_TEXTS:
        return [], "too_many_texts"
    out: dict[int, str] = {}
    for x in items:
        n, text = (x.get("ayah_number"), x.get("translation_text")) if isinstance(x, dict) else (None, None)
        if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= MOST_TEXTS or n in out or not isinstance(text, str) or not text.strip():
            return [], "invalid_identifier_or_text"
        out[n] = text
    return list(out.items()), None


@dataclass
class Answers(InputPartition):
    files: list[dict]


def _partitions(files: list[dict]) -> list[Answers]:
    """Files in parts of bounded size, in the order of the manifests."""
    parts: list[Answers] = []
    size = TASK_BYTES
    for f in files:
        if size + f["bytes"] > TASK_BYTES:
            parts.append(Answers([]))
            size = 0
        parts[-1].files.append(f)
        size += f["bytes"]
    return parts


def _rows(path: str, part: Answers) -> Iterator[tuple]:
    store, root = _store(path)
    for f in part.files:
        with store.open_input_stream(posixpath.join(root, f"drop={f['drop']}", f["name"])) as file:
            content = file.read()
        texts, error = answered(content)
        sha = hashlib.sha256(content).hexdigest()
        for n, text in texts:
            yield f["drop"], f["book"], f["grp"], n, text, None, sha
        if error:
            yield f["drop"], f["book"], f["grp"], None, None, error, sha


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.taken = path, []

    def partitions(self) -> list[Answers]:
        files = [f for n in _drops(self.path) if self._fits({"drop": n}) for f in _files(self.path, n)]
        return _partitions([f for f in files if self._fits(f)])

    def _fits(self, known: dict) -> bool:
        return all(test(known[c]) for c, test in self.taken if c in known)

    def read(self, part: Answers) -> Iterator[tuple]:
        return _rows(self.path, part)


class _PushingReader(_Reader):
    """Also takes filters; Spark refuses a reader that does unless its setting allows it, so this one is apart."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        tests = {
            EqualTo: lambda v: lambda x: x == v, In: lambda v: lambda x: x in v, GreaterThan: lambda v: lambda x: x > v, GreaterThanOrEqual: lambda v: lambda x: x >= v,
            LessThan: lambda v: lambda x: x < v, LessThanOrEqual: lambda v: lambda x: x <= v,
        }
        for f in filters:
            name = getattr(f, "attribute", ())
            if type(f) in tests and name in (("book",), ("grp",), ("drop",)) and f.value is not None:
                self.taken.append((name[0], tests[type(f)](f.value)))
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"drop": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"drop": max(_drops(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Answers]:
        return _partitions([f for n in _drops(self.path) if start["drop"] < n <= end["drop"] for f in _files(self.path, n)])

    def read(self, part: Answers) -> Iterator[tuple]:
        return _rows(self.path, part)


@dataclass
class _Landed(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceWriter):
    """Lands rows (book, grp, answer) as a new drop."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.at = path, [names.index(c) for c in ("book", "grp", "answer")]
        store, root = _store(path)
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        # a drop that broke off keeps its number to itself
        self.drop = 1 + max((int(x.base_name[5:]) for x in found if x.base_name.startswith("drop=") and x.base_name[5:].isdigit()), default=-1)
        store.create_dir(posixpath.join(root, f"drop={self.drop}"), recursive=True)

    def write(self, rows: Iterator) -> _Landed:
        store, root = _store(self.path)
        out = []
        for row in rows:
            book, grp, answer = (row[k] for k in self.at)
            content = (answer or "").encode()
            name = f"book={book}-group={grp}-{uuid.uuid4().hex}.json"
            with store.open_output_stream(posixpath.join(root, f"drop={self.drop}", name)) as f:
                f.write(content)
            out.append({"book": book, "grp": grp, "name": name, "bytes": len(content)})
        return _Landed(out)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        folder = posixpath.join(root, f"drop={self.drop}")
        listed = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: (f["book"], f["grp"], f["name"]))
        with store.open_output_stream(posixpath.join(folder, "_manifest.unfinished")) as f:
            f.write(json.dumps(listed).encode())
        store.move(posixpath.join(folder, "_manifest.unfinished"), posixpath.join(folder, _MANIFEST))

    def abort(self, messages: list) -> None:
        """What was written is listed nowhere, so nothing has to go."""


class LandedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.fieldNames())


class PushingAnswers(LandedAnswers):
    """The source with its filters, for sessions that ask for them."""

    @classmethod
    def name(cls) -> str:
        return PUSHING

    def reader(self, schema) -> DataSourceReader:
        return _PushingReader(self.options["path"])


def register(spark: SparkSession, source: type[DataSource] = LandedAnswers) -> None:
    """Make the format known to the session's readers and writers."""
    ship(spark)
    try:
        spark.dataSource.register(source)
    except AnalysisException as e:  # known already
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def pushing(spark: SparkSession) -> SparkSession:
    """A session beside the given one that knows the source by PUSHING and lets it take filters; the given one keeps its settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register(own, PushingAnswers)
    return own


def newest(answers: DataFrame) -> DataFrame:
    """Rows of each group's last drop, found by group without moving texts: one row a group and drop."""
    last = answers.select("book", "grp", "drop").groupBy("book", "grp").agg(F.max("drop").alias("drop"))
    return answers.join(last, ["book", "grp", "drop"], "left_semi")


def changed(answers: DataFrame) -> DataFrame:
    """Rows (book, grp, drop, answer_sha256) of answers that differ from the group's answer in the drop before."""
    one = answers.select("book", "grp", "drop", "answer_sha256").distinct()
    before = F.lag("answer_sha256").over(Window.partitionBy("book", "grp").orderBy("drop"))
    return one.withColumn("before", before).where("before <> answer_sha256").drop("before")
