"""What the corpus operators share: reading, batches, cutting lineage, rows beside their columns, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.plans.shipping import ship

#: Rows of an Arrow batch that a function turns into Python objects at once; Spark bounds the batch by its bytes.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the given folder, read by Spark from any store it knows."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Ready the session for Python functions; its settings stay as they are."""
    ship(spark)


def sliced(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def beside(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of an operator can meet one of theirs."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def columns_of(row: str, docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct named ``row``, some replaced."""
    return [instead[c].alias(c) if c in instead else F.col(row)[c].alias(c) for c in docs.columns]


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session that has none gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tallymark-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, its lineage cut; an executor's loss doesn't harm it."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A table in the shared folder: ``df`` reads it, ``drop`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{_shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is read often and lives as long as the result."""
    return Written(df, name).df


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): rows (id, component).

    ``component`` is the smallest id that links reach. Ids without links aren't returned.
    Large-star and small-star steps alternate until the edges no longer change; each is one
    exchange of narrow rows and a window by node, which spills where a node has very many
    edges, and nothing but one checksum of the edges reaches the driver. A round's table is
    deleted after the next. Nulls and self-links are ignored.
    """
    edges = Written(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges"
    )
    by_node = Window.partitionBy("u")
    before = None
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        large = both.withColumn("m", F.least(F.min("v").over(by_node), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.withColumn("m", F.min("v").over(by_node))
        small = low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u > v").distinct()
        after = Written(small, "edges")
        edges.drop()
        edges = after
        now = tuple(edges.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            found = edges.df
            return found.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                found.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = now
