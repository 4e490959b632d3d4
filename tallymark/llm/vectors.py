"""What vector searches share: which vectors take part, and blocks of them.

A vector takes part if its id and all its components are there and finite. A repeated id
counts once, with the smallest of its vectors. Vectors of different lengths compare as if
the shorter were filled with zeros; blocks hold vectors of about one length, so that one
overlong vector widens no other's block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERY = 20
K = 20
#: Length up to which a block has its full number of rows; blocks of longer vectors have fewer.
USUAL = 128


def valid(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """Rows (vec_id long, embedding array) that take part."""
    fine = "embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    rows = vectors.where(fine)
    if not zero:
        rows = rows.where("exists(embedding, x -> x <> 0)")
    rows = rows.selectExpr("cast(vec_id as long) vec_id", "embedding")
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def pack(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix).tobytes()


def to_matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as doubles, filled with zeros to the longest."""
    got = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    size = np.diff(got.offsets.to_numpy())
    first, last = got.offsets[0].as_py(), got.offsets[len(got)].as_py()
    flat = got.values.to_numpy(zero_copy_only=False)[first:last]
    matrix = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    matrix[np.repeat(np.arange(len(size)), size), at] = flat
    return matrix


def width_class() -> Column:
    """Vectors of up to twice the length share a class."""
    return F.ceil(F.log2(F.greatest(F.size("embedding"), F.lit(1)).cast("double"))).cast("int")


def blocked(rows: DataFrame, by: str, block_rows: int, build: Callable, schema: str) -> tuple[DataFrame, int]:
    """Rows (block int, ...) of ``build(ids, matrix, by)`` for each block of ``rows`` (vec_id, embedding, by), and how many there are.

    Rows of one value of ``by`` (a number of few values) and of one class of lengths are
    dealt to blocks by a hash of their id. The counts by value are all that the driver sees.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("wide", width_class())
    plan, n = [], 0
    for r in sorted(rows.groupBy(by, "wide").count().collect()):
        most = max(1, block_rows * USUAL // max(USUAL, 1 << r["wide"]))
        parts = -(-r["count"] // most)
        plan.append((r[by], r["wide"], n, parts))
        n += parts
    placed = rows.join(F.broadcast(spark.createDataFrame(plan, f"{by} int, wide int, first int, parts int")), [by, "wide"])
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block")

    def one(key, group):
        import pyarrow as pa

        ids = group.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        made = build(ids[order], to_matrix(group.column("embedding"))[order], group.column(by)[0].as_py())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())} | {k: pa.array([v]) for k, v in made.items()})

    return placed.select(block, by, "vec_id", "embedding").groupBy("block").applyInArrow(one, f"block int, {schema}"), n
