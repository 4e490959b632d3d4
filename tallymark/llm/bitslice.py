"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to floor(64 x). A block of rows is indexed by bit slices: one
bitmap over the rows for each bit of each attribute. For a query, the slices of every
attribute times the query's weight - multiples are made once a block, with shifts and
bitmap additions - are added pairwise by ripple-carry bitmap arithmetic until one sliced
score is left. Rows are then selected from the most significant slice downward: a slice
either keeps the k best within the rows that have the bit, or takes all of those and goes
on among the others. Rows left equal at the boundary are resolved by their smaller id, so
the result is exact.

All queries meet all rows, in a grid: a cell holds a bounded group of query blocks and reads
its index blocks one after another, keeping each query's k best so far. There are as many
cells as keep the cluster busy, and no more, dealt evenly to partitions, several to one
where there are very many; an index block moves once for each group of queries.

Vectors that are null or hold nulls or non-finite components take no part, nor do rows
without an id; a repeated id counts once (with the smallest vector); shorter vectors are
filled with zeros. Rows and queries with components beyond 2**20 quanta are scored apart in
whole numbers of any size; only a score among the results that doesn't fit a long raises
an error. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, table, written
from .vectors import EVERY, K, blocked, pack, valid

QUANTUM = 64
#: Bits of a query's weight that one table of multiples covers.
DIGIT = 5
#: Queries whose sums are made at once; their slices stay in cache.
AT_ONCE = 4


#: Quanta from which a component is too large for the slices.
WIDE = 1 << 20
#: Rows of an index block and of a query block, and query blocks of a cell.
INDEX_ROWS, QUERY_ROWS, TOGETHER = 8192, 512, 64


def quantise(matrix: np.ndarray) -> np.ndarray:
    """Whole quanta, as doubles: exact, as a product with 64 and a floor are."""
    return np.floor(QUANTUM * matrix.astype(np.float64))


def slices(values: np.ndarray) -> np.ndarray:
    """Bit slices [bit, column, word] of columns of non-negative integers; bit r of word w is row 64 w + r."""
    n, d = values.shape
    bits = max(1, int(values.max(initial=0)).bit_length())
    out = np.zeros((bits, d, -(-n // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[b, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of sliced numbers [bit, ..., word], a bit longer."""
    out = np.empty((len(a) + 1, *a.shape[1:]), np.uint64)
    carry = np.zeros(a.shape[1:], np.uint64)
    for i in range(len(a)):
        x = a[i] ^ b[i]
        np.bitwise_xor(x, carry, out=out[i])
        x &= carry
        carry = a[i] & b[i]
        carry |= x
    out[-1] = carry
    return out


def multiples(base: np.ndarray, most: int) -> np.ndarray:
    """Sliced 0..most times each column: [bit, multiple * columns + column, word]."""
    bits, d, words = base.shape
    wide = bits + max(1, most.bit_length())
    one = np.zeros((wide, d, words), np.uint64)
    one[:bits] = base
    rows = [np.zeros((wide, d, words), np.uint64)]
    for _ in range(most):
        rows.append(add(rows[-1], one)[:wide])
    return np.concatenate(rows, axis=1)


def select(score: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps [query, word] of each query's k best valid rows, rows of equal score by place."""
    sure = np.zeros_like(valid)
    open_ = valid.copy()
    for i in range(len(score) - 1, -1, -1):
        bit = open_ & score[i]
        count = np.bitwise_count(sure | bit).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(count <= k, sure | bit, sure)
        open_ = np.where(count > k, bit, np.where(count == k, np.uint64(0), open_ & ~score[i]))
    # what is open now has one score: the first rows fill up
    need = k - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
    for q in np.flatnonzero((need > 0) & open_.any(axis=1)):
        first = np.flatnonzero(np.unpackbits(open_[q].view(np.uint8), bitorder="little"))[: need[q]]
        np.bitwise_or.at(sure[q], first >> 6, np.uint64(1) << (first & 63).astype(np.uint64))
    return sure


def index(ids: np.ndarray, matrix: np.ndarray) -> dict:
    """The sliced block; attributes are stored over their smallest value. Wide rows are kept aside."""
    whole = quantise(matrix)
    wide = np.abs(whole).max(axis=1) >= WIDE
    near = whole[~wide].astype(np.int64)
    low = near.min(axis=0) if len(near) else np.zeros(whole.shape[1], np.int64)
    return {
        "dims": whole.shape[1], "ids": pack(ids[~wide].astype(np.int64)), "low": pack(low), "slices": pack(slices(near - low)),
        "wide_ids": pack(ids[wide].astype(np.int64)), "wide": pack(whole[wide]),
    }


def queries(ids: np.ndarray, matrix: np.ndarray) -> dict:
    return {"dims": matrix.shape[1], "ids": pack(ids.astype(np.int64)), "weights": pack(quantise(matrix))}


def _whole(matrix: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's numbers of any size."""
    return np.array([[int(x) for x in row] for row in matrix], object).reshape(matrix.shape)


def _apart(ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score): the k best of the rows for each query, but itself, by exact products."""
    out = []
    rows = _whole(rows)
    for q, w in zip(q_ids.tolist(), _whole(weights), strict=True):
        scored = sorted((-s, v) for s, v in zip(rows.dot(w).tolist(), ids.tolist(), strict=True) if v != q)
        out += [(q, v, -s) for s, v in scored[:k]]
    return out


def _values(base: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """The quanta of a sliced block again, as doubles."""
    out = np.repeat(low[None].astype(np.float64), n, axis=0)
    for b in range(len(base)):
        out += np.unpackbits(base[b].view(np.uint8), axis=1, bitorder="little")[:, :n].T.astype(np.float64) * 2.0**b
    return out


def match(block: dict, asked: dict, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query_id, vec_id, score): the k best rows of the block for each query, but itself."""
    ids, low = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["low"], np.int64)
    q_ids = np.frombuffer(asked["ids"], np.int64)
    weights = np.frombuffer(asked["weights"]).reshape(len(q_ids), -1)
    wide_ids = np.frombuffer(block["wide_ids"], np.int64)
    base = np.frombuffer(block["slices"], np.uint64).reshape(-1, block["dims"], -(-len(ids) // 64)) if len(ids) else np.zeros((1, block["dims"], 0), np.uint64)
    d = min(block["dims"], weights.shape[1])  # beyond, one side is zero
    base, low, weights = base[:, :d], low[:d], weights[:, :d]
    far = np.abs(weights).max(axis=1) >= WIDE
    out = []
    if len(wide_ids):
        out += _apart(wide_ids, np.frombuffer(block["wide"]).reshape(len(wide_ids), -1)[:, :d], q_ids, weights, k)
    if len(ids) and far.any():
        out += _apart(ids, _values(base, low, len(ids)), q_ids[far], weights[far], k)
    q, v, s = _sliced(ids, low, base, q_ids[~far], weights[~far].astype(np.int64), k) if len(ids) else (np.empty(0, np.int64),) * 3
    more = list(zip(*out, strict=True)) or [(), (), ()]
    return np.r_[q, np.array(more[0], np.int64)], np.r_[v, np.array(more[1], np.int64)], [*s.tolist(), *more[2]]


def _sliced(ids: np.ndarray, low: np.ndarray, base: np.ndarray, q_ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (query_id, vec_id, score) of the sliced rows; all sums fit a long."""
    d, words = base.shape[1:]
    base = np.ascontiguousarray(base)
    top = (1 << len(base)) - 1
    most = int(np.abs(weights).max(initial=0))
    digits = max(1, -(-most.bit_length() // DIGIT))
    reach = min(most, (1 << DIGIT) - 1)
    # a negative weight takes the complement of the slices: w u = |w| (top - u) - |w| top
    table_ = np.concatenate([multiples(base, reach), multiples(~base, reach)], axis=1)
    step = (reach + 1) * d
    rest = (weights * low).sum(axis=1) - (np.where(weights < 0, -weights, 0) * top).sum(axis=1)
    every = np.zeros(words * 64, np.uint8)
    every[: len(ids)] = 1
    every = np.packbits(every, bitorder="little").view(np.uint64)
    own = np.searchsorted(ids, q_ids)
    has_own = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids)
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(q_ids), AT_ONCE):
        w = weights[a : a + AT_ONCE]
        n = len(w)
        size, sign = np.abs(w), (w < 0) * step
        terms = []
        for j in range(digits):
            digit = (size >> (DIGIT * j)) & ((1 << DIGIT) - 1)
            got = table_[:, sign + digit * d + np.arange(d)]
            if j:
                got = np.concatenate([np.zeros((DIGIT * j, *got.shape[1:]), np.uint64), got])
            terms.append(got)
        wide = max(map(len, terms))
        total = np.concatenate([np.pad(t, ((0, wide - len(t)), (0, 0), (0, 0), (0, 0))) for t in terms], axis=2) if digits > 1 else terms[0]
        while total.shape[2] > 1:
            if total.shape[2] % 2:
                total = np.pad(total, ((0, 0), (0, 0), (0, 1), (0, 0)))
            half = total.shape[2] // 2
            total = add(total[:, :, :half], total[:, :, half:])
        total = total[:, :, 0]
        valid_ = np.repeat(every[None], n, axis=0)
        mine = np.flatnonzero(has_own[a : a + n])
        at = own[a + mine]
        valid_[mine, at >> 6] &= ~(np.uint64(1) << (at & 63).astype(np.uint64))
        chosen = select(total, valid_, k)
        q, r = np.nonzero(np.unpackbits(chosen.view(np.uint8), axis=1, bitorder="little"))
        shift = (r & 63).astype(np.uint64)
        score = np.zeros(len(q), np.int64)
        for i in range(len(total)):
            score += ((total[i, q, r >> 6] >> shift) & np.uint64(1)).astype(np.int64) << i
        out_q.append(q_ids[a + q])
        out_v.append(ids[r])
        out_s.append(score + rest[a + q])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_v]), np.concatenate([none, *out_s])


def _best(q: np.ndarray, v: np.ndarray, s: list[int], k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The k best rows of each query among those found."""
    value = np.array(s, np.int64 if all(-(2**63) < x < 2**63 for x in s) else object)
    order = np.lexsort((v, q)) if len(q) else np.empty(0, np.int64)
    order = order[np.argsort(-value[order], kind="stable")]
    order = order[np.argsort(q[order], kind="stable")]
    q, v, value = q[order], v[order], value[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], v[top], value[top].tolist()


def _cells(batches: Iterator, k: int) -> Iterator:
    """From rows (cell, kind, data) sorted by cell, query blocks (kind 0) before index blocks: each cell's best rows."""
    import pickle

    import pyarrow as pa

    def out(best: dict) -> Iterator:
        for q, v, s in best.values():
            if any(not -(2**63) <= x < 2**63 for x in s):
                raise ArithmeticError("components are too large: a score doesn't fit a long")
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    cell, asked, best = None, [], {}
    for batch in batches:
        for i in range(batch.num_rows):
            here, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if here != cell:
                yield from out(best)
                cell, asked, best = here, [], {}
            data = pickle.loads(batch.column(2)[i].as_py())
            if kind == 0:
                asked.append(data)
                continue
            for j, one in enumerate(asked):
                q, v, s = match(data, one, k)
                if j in best:
                    q, v, s = np.r_[best[j][0], q], np.r_[best[j][1], v], best[j][2] + s
                best[j] = _best(q, v, s, k)
    yield from out(best)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS, together: int = TOGETHER) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the exact k best rows by quantised inner product."""
    import pickle

    spark = vectors.sparkSession
    ready(spark)
    rows = written(valid(vectors), "vectors").withColumn("leaf", F.lit(0))

    def of(build):
        return lambda ids, matrix, _: {"data": pickle.dumps(build(ids, matrix))}

    left, n_index = blocked(rows, "leaf", index_rows, of(index), "data binary")
    right, n_query = blocked(rows.where(F.col("vec_id") % every == 0), "leaf", query_rows, of(queries), "data binary")
    # the grid: few groups of queries, and index groups until there is work for all
    busy = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    across = max(1, -(-n_query // together))
    down = max(1, min(n_index, -(-busy // across)))
    across = max(across, min(n_query, -(-busy // down)))
    cell = F.col("down") * across + F.col("across")
    left = left.select((F.col("block") % down).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"), "data")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"), (F.col("block") % across).alias("across"), "data")
    both = right.select(cell.alias("cell"), F.lit(0).alias("kind"), "data").unionByName(left.select(cell.alias("cell"), F.lit(1).alias("kind"), "data"))
    parts = min(down * across, 8 * busy)
    both = both.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", "kind")
    found = both.mapInArrow(lambda it: _cells(it, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
