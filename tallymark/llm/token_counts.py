"""Token counts with a digest cache: each distinct text is encoded once for each tokenizer version.

The cache is a folder of Parquet segments with rows (version, digest, n_tokens): the digest of
a tokenizer's file, library and settings, and that of a normalised text. A run joins the
digests of its texts to the stored counts, encodes what isn't there, once for each distinct
text, appends that as a segment of its own and takes every count from the cache. A row of a
segment is true whatever else was written, so a run that breaks off, or two at once, do no
harm: what both have stored is read once.

Rows are narrow but for the texts to encode. Where these are few, they are picked out before
anything moves; otherwise texts are combined by digest on the map side first. Digests that
very many rows share are counted, and their counts broadcast (at most HOT_SHARES of them);
the rest is joined by digest, so no group of copies meets in one task.

A null text is the empty text, with no tokens; bytes that are no UTF-8 count as the
replacement character. Long texts are encoded in parts, cut only between a character that is
no white space and a single space before another one, where the tokenizer's pattern always
cuts. Special strings in texts are special tokens, which is the library's default. Repeated
rows give repeated rows, an empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, _shared_folder, ready, sliced, table

#: Tokens beyond which a text is over the limit.
LIMIT = 512
#: Code points of a part, at least, and of the parts that are encoded at once.
PART, TOGETHER = 1 << 18, 1 << 20
#: Distinct misses up to which their digests are broadcast (some 15 MB).
FEW = 100_000
#: A digest is hot if its rows are over one in so many, and over this number.
HOT_SHARES, HOT_ROWS = 10_000, 10_000

_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
_STORED = "version string, digest binary, n_tokens long"


class Cache:
    """Stored counts under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` None: a new, empty cache in the session's shared folder."""
        self.spark = spark
        self.path = (path or f"{_shared_folder(spark)}/token-counts-{uuid.uuid4().hex}").rstrip("/")

    def _empty(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return not store.exists(path) or not store.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segment=*/version=*/*.parquet"))

    def read(self) -> DataFrame:
        """Rows (version, digest, n_tokens), one for each pair of digests."""
        if self._empty():
            return self.spark.createDataFrame([], _STORED)
        stored = self.spark.read.schema(_STORED + ", segment string").option("basePath", self.path).parquet(f"{self.path}/segment=*")
        return stored.groupBy("version", "digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        """Store rows (version, digest, n_tokens) as a new segment."""
        counts.write.partitionBy("version").parquet(f"{self.path}/segment={uuid.uuid4().hex}")

    def compact(self) -> None:
        """One segment in place of all: the new one is whole before an old one goes. No other run may read meanwhile."""
        if self._empty():
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [x.getPath() for x in store.listStatus(path(self.path))]
        self.append(self.read())
        for segment in old:
            store.delete(segment, True)


class Encoder:
    """The library's tokenizer from the content of its file."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            encoded = self.tokenizer.encode_batch_fast([t for _, t in held], add_special_tokens=False)
            for (k, _), e in zip(held, encoded, strict=True):
                out[k] += len(e.ids)
            held.clear()

        for k, text in enumerate(texts):
            for part in parts(text):
                held.append((k, part))
                size += len(part)
                if size >= TOGETHER:
                    flush()
                    size = 0
        flush()
        return out


def parts(text: str) -> Iterator[str]:
    """The text in parts whose tokens are those of the whole text."""
    at = 0
    while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def version(content: str) -> str:
    """The digest of what a count depends on besides the text."""
    import tokenizers

    told = f"{hashlib.sha256(content.encode()).hexdigest()}|tokenizers {tokenizers.__version__}|no added tokens, special strings found, whole texts"
    return hashlib.sha256(told.encode()).hexdigest()


def normalised(text: Column) -> Column:
    """What is encoded and digested; nothing that a byte-level tokenizer would tell apart is changed."""
    return F.coalesce(F.make_valid_utf8(text.cast("string")), F.lit(""))


_encoders: dict[str, Encoder] = {}


def _encoded(texts: DataFrame, content: str, mark: str) -> DataFrame:
    """Rows (version, digest, n_tokens) of rows (digest, text)."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(content)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if mark not in _encoders:
            _encoders[mark] = Encoder(sent.value)
        for batch in sliced(batches):
            n = batch.num_rows
            counts = _encoders[mark].counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([mark] * n, pa.string()), batch.column(0), pa.array(counts, pa.int64())], ["version", "digest", "n_tokens"])

    return texts.mapInArrow(run, _STORED)


def _digested(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, digest), texts normalised."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def fill(docs: DataFrame, path: str, cache: Cache, keys: DataFrame | None = None) -> str:
    """Encode the distinct texts of ``docs`` that the cache doesn't hold, and append them; the tokenizer's version."""
    ready(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        content = file.read()
    mark = version(content)
    rows = _digested(docs)
    if keys is None:
        keys = rows.select("digest").distinct()
    stored = cache.read().where(F.col("version") == mark)
    missing = Written(keys.select("digest", F.lit(mark).alias("version")).join(stored, ["version", "digest"], "left_anti").select("digest"), "token-misses")
    n = missing.df.count()
    if n:
        texts = rows.select("digest", "text")
        if n <= FEW:
            texts = texts.join(F.broadcast(missing.df), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n > FEW:
            texts = texts.join(missing.df, "digest", "left_semi")
        cache.append(_encoded(texts.select("digest", "text"), content, mark))
    missing.drop()
    return mark


def count(docs: DataFrame, path: str, cache: Cache, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) of rows (doc_id, text)."""
    rows = _digested(docs).select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    keys = Written(rows.groupBy("digest").agg(F.count("*").alias("copies")), "token-digests").df
    mark = fill(docs, path, cache, keys)
    stored = cache.read().where(F.col("version") == mark).select("digest", "n_tokens")
    # a digest is one of at most HOT_SHARES that are as frequent
    most = max(HOT_ROWS, (keys.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARES)
    hot = stored.join(F.broadcast(keys.where(F.col("copies") > most).select("digest")), "digest", "left_semi").withColumnRenamed("n_tokens", "known")
    rows = rows.join(F.broadcast(hot), "digest", "left")
    # rows whose count is known go anywhere: their keys are shorter than a digest, so they meet none
    key = F.when(F.col("known").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.monotonically_increasing_id())))
    joined = rows.withColumn("key", key).join(stored.withColumnRenamed("digest", "key"), "key", "left")
    tokens = F.coalesce("known", "n_tokens")
    return joined.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a cache that starts empty, so that the work doesn't depend on earlier runs."""
    return count(table(spark, sf_dir, "documents"), default_path(), Cache(spark))
