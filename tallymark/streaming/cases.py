"""Streams of the review workflow: result chunks, the state of each case, upserts of findings.

The batch operators define the results; a stream run to its end gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship

# What each message does to a case in each stage.
MOVES = {
    ("unassigned", "assign"): "assigned",
    ("assigned", "assign"): "assigned",
    ("returned", "assign"): "assigned",
    ("assigned", "submit"): "submitted",
    ("returned", "submit"): "submitted",
    ("submitted", "approve"): "approved",
    ("submitted", "return"): "returned",
    ("approved", "return"): "returned",
    ("returned", "approve"): "approved",
}
CASE = "case_id string, stage string, at timestamp, applied long, refused long"


def chunks(results: DataFrame, key: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Appended results, the first of each key within the watermark; what came before a failure stays."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def moved(stage: str, last, messages) -> tuple[str, object, int, int]:
    """A case after messages (kind, time) in time order; stale and impossible ones are refused."""
    applied = refused = 0
    for kind, at in messages:
        to = MOVES.get((stage, kind))
        if to is None or (last is not None and at <= last):
            refused += 1
        else:
            stage, last, applied = to, at, applied + 1
    return stage, last, applied, refused


def case_states(messages: DataFrame) -> DataFrame:
    """The state of each case (case_id, kind, at) after its messages: a stateful operator on a stream, a fold otherwise."""
    ship(messages.sparkSession)
    if not messages.isStreaming:
        return _folded(messages)

    def step(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        stage, last, applied, refused = state.get if state.exists else ("unassigned", None, 0, 0)
        last = None if last is None else pd.Timestamp(last)
        rows = [r for f in frames for r in zip(f["kind"], f["at"], strict=True)]
        stage, last, a, r = moved(stage, last, sorted(rows, key=lambda x: (x[1], x[0])))
        applied, refused = applied + a, refused + r
        state.update((stage, None if last is None else last.to_pydatetime(), applied, refused))
        yield pd.DataFrame({"case_id": [key[0]], "stage": [stage], "at": [last], "applied": [applied], "refused": [refused]})

    kept = "stage string, at timestamp, applied long, refused long"
    return messages.groupBy("case_id").applyInPandasWithState(step, CASE, kept, "update", "NoTimeout")


def _folded(messages: DataFrame) -> DataFrame:
    """The same by a fold over each case's messages in the JVM; a case has few messages."""
    ordered = messages.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("m"))
    start = F.struct(F.lit("unassigned").alias("stage"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

    def step(acc, m):
        to = F.lit(None).cast("string")
        for (stage, kind), target in MOVES.items():
            to = F.when((acc["stage"] == stage) & (m["kind"] == kind), target).otherwise(to)
        fits = to.isNotNull() & (acc["at"].isNull() | (m["at"] > acc["at"]))
        done = F.struct(to.alias("stage"), m["at"].alias("at"), (acc["applied"] + 1).alias("applied"), acc["refused"].alias("refused"))
        not_done = F.struct(acc["stage"].alias("stage"), acc["at"].alias("at"), acc["applied"].alias("applied"), (acc["refused"] + 1).alias("refused"))
        return F.when(fits, done).otherwise(not_done)

    out = ordered.select("case_id", F.aggregate("m", start, step).alias("s"))
    return out.select("case_id", "s.stage", "s.at", "s.applied", "s.refused")


def upsert(target: str, key: list[str], order: str, buckets: int = 64):
    """A foreachBatch function: Parquet tables of the latest row of each key, one a bucket of keys; only buckets with news are rewritten.

    A bucket's versions are numbered by batch. A batch that comes again writes the same
    version from the one before it; the versions that no batch can ask for again go. A
    bucket whose earlier version can't be read raises an error, as its state would be lost.
    """
    from pyspark.sql import Window

    def versions(spark, bucket: int) -> tuple[object, list[int]]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={bucket}")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = _finished(spark, store, path) if store.exists(path) else []
        return store, sorted(int(n[1:]) for n in names if n[1:].isdigit())

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            for row in placed.select("__bucket").distinct().collect():  # at most ``buckets``
                number = row["__bucket"]
                store, known = versions(spark, number)
                before = [v for v in known if v < epoch]
                news = placed.where(F.col("__bucket") == number).drop("__bucket")
                if before:
                    news = spark.read.parquet(f"{target}/bucket={number}/v{before[-1]}").unionByName(news)
                newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
                latest = news.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
                latest.coalesce(1).write.mode("overwrite").parquet(f"{target}/bucket={number}/v{epoch}")
                for old in before[:-1]:
                    store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket={number}/v{old}"), True)
        finally:
            placed.unpersist()

    return write


def _finished(spark, store, bucket) -> list[str]:
    """The versions of a bucket whose write came to its end."""
    found = [s.getPath() for s in store.listStatus(bucket)]
    return [p.getName() for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def upserted(spark, target: str) -> DataFrame:
    """The rows that ``upsert`` keeps: the newest version of each bucket."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for bucket in store.listStatus(path):
        names = _finished(spark, store, bucket.getPath())
        newest = max((int(n[1:]) for n in names if n[1:].isdigit()), default=None)
        if newest is not None:
            found.append(f"{bucket.getPath()}/v{newest}")
    return spark.read.parquet(*found)
