"""Approximate nearest neighbours by a few stable projections and a kd-tree.

Rows are projected on ``PROJECTIONS`` normal directions, a 2-stable family: the squared
projected distance of two points over their squared distance follows a chi-square law. A
kd-tree over the projected points has two levels. Its upper splits are medians of a bounded
sample (``SAMPLE`` rows) and divide all rows into blocks; within a block, medians of its own
rows go on down to small leaves. A query visits the blocks in the order of their projected
distance, in rounds that double, and within a block the leaves in the same way; their rows
are verified by true inner products. Its k best rows so far go along from block to block. It
stops once the projected distance of what comes next, over the distance of its k-th best
row, passes the chi-square quantile at ``CONFIDENCE``: a nearer row still unseen is then that
unlikely. So blocks stay where they are, queries move to those they can't rule out, and on
clustered vectors those are few. A block that very many queries visit is read by several
tasks.

The largest inner product is the smallest distance after one more coordinate makes all
rows equally long and the query is scaled to that length. Equal vectors of a block are
one point of the tree that keeps its k + 1 smallest ids, which is all a result can hold.

Vectors that are null, zero or hold null or non-finite components take no part, nor do
rows without an id; a repeated id counts once (with the smallest vector); shorter vectors
are filled with zeros. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, sliced, table, written
from .vectors import EVERY, K, blocked, pack, to_matrix, valid

PROJECTIONS = 8
LEAF = 64
CONFIDENCE = 0.95
SEED = 20_260_101
#: Leaves of the first round of verification in a block.
FIRST = 8
#: Rows that the upper splits are fitted on: their projections are all that the driver sees of rows.
SAMPLE = 16_384
#: Rows of a block, and most leaves of the upper tree: what is broadcast of a leaf's blocks is their boxes.
BLOCK_ROWS, MOST_LEAVES = 8192, 1 << 16
#: Visits of a block that one task takes.
VISITS = 4096


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable of an even number m of degrees stays below with probability p."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dims: int) -> np.ndarray:
    """The projections of all blocks and queries: one more coordinate and dims; a longer vector's begin like a shorter's."""
    return np.random.default_rng(SEED).standard_normal((dims + 1, PROJECTIONS))


def projected(matrix: np.ndarray, longest: float) -> np.ndarray:
    """The rows' projections, once one more coordinate makes their squared length ``longest``."""
    lines = directions(matrix.shape[1])
    more = np.sqrt(np.maximum(longest - (matrix**2).sum(axis=1), 0))
    return more[:, None] * lines[0] + matrix @ lines[1:]


def upper_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Splits (axis, value) in heap order: medians of the widest axis, until there are as many leaves (a power of two)."""
    splits, parts = [], [points]
    while len(parts) < leaves:
        below = []
        for p in parts:
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            splits.append((axis, value))
            below += [p[p[:, axis] < value], p[p[:, axis] >= value]]
        parts = below
    return splits


def leaf_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of the upper tree that each point falls in."""
    node = np.zeros(len(points), np.int64)
    axis, value = np.array([a for a, _ in splits], np.int64), np.array([v for _, v in splits])
    depth = (len(splits) + 1).bit_length() - 1
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - len(splits)


def tree_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in the order of a kd-tree's leaves: split at a median of the widest axis, at whole leaves."""
    order = np.arange(len(points))
    todo = [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            continue
        part = points[order[a:b]]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        middle = -(-(b - a) // (2 * leaf)) * leaf
        if middle >= b - a:
            middle = leaf
        order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
        todo += [(a, a + middle), (a + middle, b)]
    return order


def index(ids: np.ndarray, matrix: np.ndarray, longest: float) -> dict:
    """The tree of a block: distinct vectors in leaf order, their ids, and the leaves' boxes."""
    matrix = matrix + 0.0  # no negative zeros, so equal vectors have equal bytes
    _, first, same = np.unique(matrix, axis=0, return_index=True, return_inverse=True)
    same = same.reshape(-1)
    vectors = matrix[first]
    order = np.argsort(same, kind="stable")  # ids ascend within a vector
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    kept = order[place <= K]
    points = projected(vectors, longest)
    by_leaf = tree_order(points)
    points, vectors = points[by_leaf], vectors[by_leaf]
    where = np.empty(len(by_leaf), np.int64)
    where[by_leaf] = np.arange(len(by_leaf))
    cuts = np.arange(0, len(points), LEAF)
    low = np.minimum.reduceat(points, cuts)
    high = np.maximum.reduceat(points, cuts)
    return {
        "dims": matrix.shape[1], "rows": len(ids), "vectors": pack(vectors), "low": pack(low), "high": pack(high), "longest": longest,
        "ids": pack(ids[kept].astype(np.int64)), "of": pack(where[same[kept]]),
    }


def box_distances(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distances [query, box]."""
    near = np.zeros((len(at), len(low)))
    for m in range(PROJECTIONS):
        x = at[:, m : m + 1]
        near += np.maximum(0, np.maximum(low[:, m] - x, x - high[:, m])) ** 2
    return near


def _queries(matrix: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The factor that gives each query the common length, and its projections then."""
    scale = np.sqrt(longest / (matrix**2).sum(axis=1))
    return scale, (matrix * scale[:, None]) @ directions(matrix.shape[1])[1:]


def match(block: dict, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (query_id, vec_id, score) of the k best rows found in the block for each query, but itself, and of rows verified.

    ``floor`` is the score of each query's k-th best row so far.
    """
    longest = block["longest"]
    scale, at = _queries(q, longest)
    d = min(block["dims"], q.shape[1])  # beyond, one side is zero
    vectors = np.frombuffer(block["vectors"]).reshape(-1, block["dims"])[:, :d]
    q = q[:, :d]
    low, high = (np.frombuffer(block[x]).reshape(-1, PROJECTIONS) for x in ("low", "high"))
    nq, leaves = len(q_ids), len(low)
    near = box_distances(at, low, high)
    order = np.argsort(near, axis=1)
    near = np.take_along_axis(near, order, axis=1)
    keep = k + 1  # a query's own row is among them
    best = np.full((nq, keep), -np.inf)
    best_at = np.full((nq, keep), -1)
    seen = np.zeros(nq, np.int64)
    bound = chi_square_quantile(CONFIDENCE, PROJECTIONS)
    done, width = 0, FIRST
    active = np.flatnonzero(near[:, 0] < bound * (2 * longest - 2 * scale * floor))
    while len(active) and done < leaves:
        to = min(leaves, done + width)
        mine = order[active, done:to]
        got = np.full((len(active), to - done, LEAF), -np.inf)
        rows = np.argsort(mine, axis=None, kind="stable")
        leaf = mine.reshape(-1)[rows]
        cuts = np.r_[np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), len(leaf)]
        flat = got.reshape(-1, LEAF)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = vectors[leaf[a] * LEAF : (leaf[a] + 1) * LEAF]
            flat[rows[a:b], : len(part)] = q[active[rows[a:b] // (to - done)]] @ part.T
        seen[active] += (got > -np.inf).sum(axis=(1, 2))
        place = (mine[:, :, None] * LEAF + np.arange(LEAF)).reshape(len(active), -1)
        score = np.concatenate([best[active], got.reshape(len(active), -1)], axis=1)
        place = np.concatenate([best_at[active], place], axis=1)
        top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        best[active] = score = np.take_along_axis(score, top, axis=1)
        best_at[active] = np.take_along_axis(place, top, axis=1)
        done, width = to, width * 2
        if done < leaves:
            distance2 = 2 * longest - 2 * scale[active] * np.maximum(score.min(axis=1), floor[active])
            active = active[near[active, done] < bound * distance2]
    # exact scores, summed in one order whatever the block; equal vectors bring all their ids
    ids, of = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["of"], np.int64)
    by = np.argsort(of, kind="stable")
    first = np.searchsorted(of[by], np.arange(len(vectors) + 1))
    who, slot = np.nonzero(best > -np.inf)
    found = best_at[who, slot]
    score = np.zeros(len(who))
    for j in range(d):
        score += q[who, j] * vectors[found, j]
    size = first[found + 1] - first[found]
    member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[found], size)
    who, score, v = np.repeat(who, size), np.repeat(score, size), ids[by[member]]
    other = v != q_ids[who]
    who, score, v = who[other], score[other], v[other]
    ranked = np.lexsort((v, -score, who))
    who, score, v = who[ranked], score[ranked], v[ranked]
    top = np.arange(len(who)) - np.searchsorted(who, who) < k
    return q_ids[who[top]], v[top], score[top], seen


def _indexed(rows: DataFrame, block_rows: int) -> tuple[DataFrame, float, int]:
    """Rows (block, low, high, data) of the two levels of the tree, the largest squared length, and how many rows there are."""
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = rows.select(squared.alias("s")).agg(F.count("*"), F.max("s")).first()
    longest = float(longest or 1.0)
    leaves = 1
    while leaves * block_rows < n and leaves < MOST_LEAVES:
        leaves *= 2

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(projected(to_matrix(batch.column(1)), longest)), pa.list_(pa.float64()))], ["point"])

    splits: list[tuple[int, float]] = []
    if leaves > 1:
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding")
        points = np.array([r["point"] for r in some.mapInArrow(project, "point array<double>").collect()])
        splits = upper_tree(points, leaves)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            leaf = leaf_of(projected(to_matrix(batch.column(1)), longest), splits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], ["vec_id", "embedding", "leaf"])

    def build(ids: np.ndarray, matrix: np.ndarray, _) -> dict:
        made = index(ids, matrix, longest)
        low, high = (np.frombuffer(made[x]).reshape(-1, PROJECTIONS) for x in ("low", "high"))
        return {"low": low.min(axis=0).tolist(), "high": high.max(axis=0).tolist(), "data": pickle.dumps(made)}

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = written(rows.mapInArrow(place, f"vec_id long, embedding {kind}, leaf int"), "placed")
    blocks, _ = blocked(placed, "leaf", block_rows, build, "low array<double>, high array<double>, data binary")
    return written(blocks, "blocks"), longest, n


def _visits(state: DataFrame, boxes: tuple, longest: float, done: int, width: int, k: int) -> DataFrame:
    """Rows (block, query_id, embedding, floor): the next blocks of the queries that their test doesn't stop."""
    shared = state.sparkSession.sparkContext.broadcast(boxes)
    bound = chi_square_quantile(CONFIDENCE, PROJECTIONS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number, low, high = shared.value
        for batch in sliced(batches):
            scale, at = _queries(to_matrix(batch.column(1)), longest)
            floor = batch.column(2).to_numpy()
            near = box_distances(at, low, high)
            order = np.argsort(near, axis=1, kind="stable")[:, done : done + width]
            near = np.take_along_axis(near, order, axis=1)
            row, slot = np.nonzero(near < bound * (2 * longest - 2 * scale * floor)[:, None])
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(number[order[row, slot]], pa.int32()), *picked.columns[:3]], ["block", "query_id", "embedding", "floor"])

    kind = state.schema["embedding"].dataType.simpleString()
    return state.select("query_id", "embedding", "floor").mapInArrow(run, f"block int, query_id long, embedding {kind}, floor double")


def _verified(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score, seen): the best rows of each visit, and one row without vec_id that counts what it verified."""
    spark = visits.sparkSession
    counts = visits.groupBy("block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
    counts = written(counts, "visited")
    part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")
    asked = visits.join(F.broadcast(counts), "block").select("block", part, F.lit(1).alias("kind"), "query_id", "embedding", "floor")
    held = blocks.join(F.broadcast(counts), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "data")
    both = held.unionByName(asked, allowMissingColumns=True).select("block", "part", "kind", "data", "query_id", "embedding", "floor")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = None
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (kinds[1:] == 0) | (kinds[1:] != kinds[:-1])])
            for a, b in zip(cuts, [*cuts[1:], len(kinds)], strict=True):
                if kinds[a] == 0:
                    block = pickle.loads(batch.column(3)[a].as_py())
                    continue
                for piece in sliced([batch.slice(a, b - a)], 1024):
                    ids = piece.column(4).to_numpy()
                    q, v, s, seen = match(block, ids, to_matrix(piece.column(5)), piece.column(6).to_numpy(), k)
                    columns = [np.r_[q, ids], pa.array(np.r_[v, ids], mask=np.r_[np.zeros(len(q), bool), np.ones(len(ids), bool)])]
                    columns += [np.r_[s, np.zeros(len(ids))], np.r_[np.zeros(len(q), np.int64), seen]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["query_id", "vec_id", "score", "seen"])

    return both.mapInArrow(run, "query_id long, vec_id long, score double, seen long")


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, verified): the k nearest rows found, k at most 20; ``verified`` counts the rows compared."""
    if k > K:
        raise ValueError(f"the index keeps the ids that {K} neighbours need")
    spark = vectors.sparkSession
    ready(spark)
    rows = written(valid(vectors, zero=False), "vectors")
    blocks, longest, n = _indexed(rows, block_rows)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    if not n:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("verified"))
    # the blocks' boxes, 132 bytes each, of which there are no more than the upper tree's leaves and what splits them
    found = sorted(tuple(r) for r in blocks.select("block", "low", "high").collect())
    boxes = (np.array([b for b, *_ in found], np.int32), np.array([x for _, x, _ in found]), np.array([x for *_, x in found]))
    best, done, width = None, 0, 1
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    while done < len(found):
        if best is None:
            state = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            floors = best.where("vec_id IS NOT NULL").groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(f"c >= {k}")
            state = asked.join(floors, "query_id", "left").select("query_id", "embedding", F.coalesce("s", F.lit(float("-inf"))).alias("floor"))
        visits = written(_visits(state, boxes, longest, done, width, k), "visits")
        done, width = done + width, width * 2
        if visits.isEmpty():
            break
        got = _verified(visits, blocks, k)
        got = got if best is None else best.unionByName(got)
        rank = F.row_number().over(by_score)
        top = got.where("vec_id IS NOT NULL").withColumn("rank", rank).where(f"rank <= {k}").drop("rank")
        seen = got.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("seen").alias("seen"))
        seen = seen.select("query_id", F.lit(None).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), "seen")
        best = written(top.unionByName(seen), "best")
    counted = best.where("vec_id IS NULL").select("query_id", F.col("seen").alias("verified"))
    out = best.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(by_score)).join(counted, "query_id")
    return out.select("query_id", "rank", "vec_id", "score", "verified")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
