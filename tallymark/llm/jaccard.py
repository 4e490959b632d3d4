"""Exact Jaccard join of documents on word shingles, by T-occurrence search.

1. A text becomes its set of distinct shingles, 64-bit hashes made in numpy over whole
   batches. Equal sets are one class, kept once from here on.
2. A table of document frequencies by hash bucket (summed over all documents; its size is
   bounded) orders shingles from rare to frequent. Two sets that reach the threshold share a
   shingle among the first few of each in that order, and a known number of them, so only
   those are posted, by shingle, with their places in the order.
3. A short list of postings gives all its pairs. A pair goes on if the short lists it meets
   in, and as many long ones as both sets are in, make up the number that its sizes ask for.
4. What meets in long lists only is found by its first common shingle: behind it, both sets
   must hold enough for the overlap. Postings with enough behind them for a set of their own
   size are chained by size, others are tied to a smaller set that they could reach. So no
   list, however hot, gives more rows than it has, and sets that share a form only, with
   rarer shingles before it, aren't tied.
5. Connected candidates are a group. A group of one block is a tile. In a larger one the
   blocks are searched first, then the least sets of what was linked, until these fit one
   block; at last, what is outside the group's largest component meets all of the group,
   block by block. No link between blocks is lost, and a hot group of near copies, which
   the first searches connect, costs no more than its rows.
6. Within a tile, an inverted index over the whole sets answers a T-occurrence search for
   each document by DivideSkip: its short lists are merged into counts, its long lists are
   probed by binary search for those documents that can still reach the overlap T. A tile
   returns a spanning forest of its links, which has the same components as all of them.

A null or empty text has an empty set and links with nothing. Repeated rows are copies: a
class of its own with one member each. Rows of one id with different texts belong to their
texts' classes. A null id gets a null component unless its text has a copy with an id. An
empty table gives no rows. Two shingles with one 64-bit hash count as equal; for a pair of
documents of a thousand shingles that chance is under 1e-13.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, columns_of, components, ready, sliced, table, written

WORDS = 4
#: Two sets link from so many hundredths of their union.
PERCENT = 85
#: Bits of the table of document frequencies: 2**20 counters, with over a million documents up to 2**24 (64 MB).
TABLE_BITS, MOST_BITS = 20, 24
#: Longest list that gives all its pairs.
SHORT = 16
#: Postings of a long list that are held at once.
HELD = 1 << 17
#: Sets and shingles in a block of a large group.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Bits of the filter of texts that are candidates.
FILTER_BITS = 24
#: Bytes of text that are hashed at once.
CHUNK = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the bytes, and where each begins."""
    b = _LOWER[np.frombuffer(data, np.uint8)]
    space = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(b) + 1)
    total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)
    before = np.where(start > 0, total[np.maximum(start - 1, 0)], np.uint64(0))
    value = (total[end - 1] - before) * down[start] if len(start) else np.empty(0, np.uint64)
    return _mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, and the number of words of each text."""
    out, counts = [], np.zeros(len(texts), np.int64)
    data, first, size = [], 0, 0

    def flush(to: int) -> None:
        nonlocal data, first, size
        if data:
            ends = np.cumsum([len(x) + 1 for x in data])
            h, start = _word_hashes(b" ".join(data))
            counts[first:to] += np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(data))
            out.append(h)
        data, first, size = [], to, 0

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK:  # alone, cut at white space
            flush(i)
            at = 0
            while at < len(raw):
                to = at + CHUNK
                while to < len(raw) and not _IS_SPACE[raw[to]]:
                    to += 1
                h, _ = _word_hashes(raw[at:to])
                counts[i] += len(h)
                out.append(h)
                at = to
            first = i + 1
            continue
        if size + len(raw) > CHUNK:
            flush(i)
        data.append(raw)
        size += len(raw) + 1
    flush(len(texts))
    return np.concatenate([np.empty(0, np.uint64), *out]), counts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    acc = h.copy()
    for k in range(1, words):
        acc[: len(h) - k] = _mix(acc[: len(h) - k] * np.uint64(0x2545F4914F6CDD1D) + h[k:])
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            sets.append(np.unique(acc[end - n : end - words + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for w in h[end - n : end]:
                x = _mix(x * np.uint64(0xD1342543DE82EF95) + w)
            sets.append(x)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shared shingles that sets of sizes n and m need to link."""
    return -(-(percent * (n + m)) // (100 + percent))


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-(percent * n) // 100) + 1


def _frequencies(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Document frequencies by bucket of the hash: a table of bounded size, summed over all documents."""
    pieces, width = 64, (1 << bits) // 64

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << bits, np.int64)
        for batch in sliced(batches):
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            if sets:
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), 1)
        parts = total.reshape(pieces, width)
        some = [k for k in range(pieces) if parts[k].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([zlib.compress(parts[k].astype(np.uint32).tobytes(), 1) for k in some], pa.binary())], ["piece", "counts"]
        )

    def add(key, group):
        import pyarrow as pa

        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.int64) for x in group.column("counts"))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "piece int, counts binary")
    rows = rows.groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    out = np.zeros((pieces, width), np.int64)
    for r in rows:
        out[r["piece"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (doc_id, key, n, f1, f2, prefix): the text's hash, the set's size and fingerprint, and its rarest shingles in their order."""
    bits = min(MOST_BITS, max(TABLE_BITS, int(docs.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(_frequencies(docs, words, bits), 2**32 - 1).astype(np.uint32))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        often = shared.value
        for batch in sliced(batches):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            n = np.array([len(s) for s in sets], np.int64)
            take = np.where(n > 0, prefix_size(n, percent), 0)
            prints, rare = np.zeros((2, len(sets)), np.uint64), []
            for i, s in enumerate(sets):
                if len(s):
                    prints[0, i] = _mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    prints[1, i] = np.bitwise_xor.reduce(_mix(s + np.uint64(0x14057B7EF767814F)))
                    rare.append(s[np.argsort(often[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[: take[i]]])
            flat = _signed(np.concatenate([np.empty(0, np.uint64), *rare]))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(_signed(prints[0])), pa.array(_signed(prints[1])), lists],
                ["doc_id", "key", "n", "f1", "f2", "prefix"],
            )

    return docs.select("doc_id", _key(), "text").mapInArrow(run, "doc_id long, key long, n long, f1 long, f2 long, prefix array<long>")


def _key() -> Column:
    return F.xxhash64("text").alias("key")


def _met(batches: Iterator, percent: int) -> Iterator:
    """From postings (h, n, place, node) sorted by h and n: rows (kind, a, b, n, m, c).

    Kind 0 are the pairs of short lists, kind 1 the ties of long ones, and kind 2 says in how
    many long lists a node is. A long list of more than ``HELD`` rows is read in parts; of
    those before, one set of each size that others can be tied to is kept.
    """
    held = np.empty((0, 5), np.int64)  # the last list so far; the last column tells its own rows from kept ones
    going_on = False
    for batch in batches:
        rows = np.stack([*[batch.column(k).to_numpy() for k in range(4)], np.ones(batch.num_rows, np.int64)], axis=1)
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        yield from _lists(rows[:last], going_on, percent)
        going_on &= not last
        held = rows[last:]
        if len(held) > HELD:
            yield from _lists(held, True, percent)
            fine = held[_reaches_own_size(held[:, 1], held[:, 2], percent)]
            held = fine[np.r_[fine[1:, 1] != fine[:-1, 1], True]] if len(fine) else held[-1:]
            held = held.copy()
            held[:, 4] = 0
            going_on = True
    yield from _lists(held, going_on, percent)


def _reaches_own_size(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set has enough shingles from this place on for the overlap with a set of its size."""
    return n - place >= least_overlap(n, n, percent)


def _lists(rows: np.ndarray, first_is_long: bool, percent: int) -> Iterator:
    """Pairs, ties and memberships of lists (h, n, place, node, own), sorted by h and n."""
    import pyarrow as pa

    def out(kind: int, a, b, n, m, c=None) -> pa.RecordBatch:
        columns = [np.asarray(x, np.int64) for x in (a, b, n, m, np.ones(len(a), np.int64) if c is None else c)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *map(pa.array, columns)], ["kind", "a", "b", "n", "m", "c"])

    if not len(rows):
        return
    start = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    size = np.diff(np.r_[start, len(rows)])
    is_long = size > SHORT
    is_long[0] |= first_is_long
    of = np.repeat(np.arange(len(start)), size)
    long = rows[is_long[of]]
    if len(long):
        which = of[is_long[of]]
        own = long[long[:, 4] == 1, 3]
        if len(own):
            node, times = np.unique(own, return_counts=True)
            zero = np.zeros(len(node))
            yield out(2, node, zero, zero, zero, times)
        n, node = long[:, 1], long[:, 3]
        fine = _reaches_own_size(n, long[:, 2], percent)
        s = np.flatnonzero(fine)
        near = np.flatnonzero((which[s[1:]] == which[s[:-1]]) & (100 * n[s[:-1]] >= percent * n[s[1:]]))
        if len(near):
            a, b = node[s[near]], node[s[near + 1]]
            zero = np.zeros(len(a))
            yield out(1, np.minimum(a, b), np.maximum(a, b), zero, zero)
        # the largest set among the chained ones that what is behind a place could still reach
        rest = np.flatnonzero(~fine & (long[:, 4] == 1))
        if len(rest) and len(s):
            most = (100 + percent) * (n[rest] - long[rest, 2]) // percent - n[rest]
            wide = int(n.max()) + 2
            at = np.searchsorted(which[s] * wide + n[s], which[rest] * wide + np.clip(most, 0, wide - 1), side="right") - 1
            ok = np.flatnonzero(at >= 0)
            ok = ok[(which[s[at[ok]]] == which[rest[ok]]) & (100 * n[s[at[ok]]] >= percent * n[rest[ok]])]
            if len(ok):
                a, b = node[s[at[ok]]], node[rest[ok]]
                zero = np.zeros(len(a))
                yield out(1, np.minimum(a, b), np.maximum(a, b), zero, zero)
    rows = rows[~is_long[of]]
    for d in range(1, min(SHORT, len(rows))):
        k = np.flatnonzero(rows[d:, 0] == rows[:-d, 0])
        if not len(k):
            break
        n, m = rows[k, 1], rows[k + d, 1]
        close = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        k, n, m = k[close], n[close], m[close]
        if len(k):
            a, b = rows[k, 3], rows[k + d, 3]
            flip = a > b
            yield out(0, np.where(flip, b, a), np.where(flip, a, b), np.where(flip, m, n), np.where(flip, n, m))


def divide_skip(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets (none empty): pairs of their places."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    size = np.diff(np.r_[start, len(tokens)])
    number = np.empty(len(tokens), np.int64)
    number[order] = np.repeat(np.arange(len(start)), size)
    ends = np.cumsum(n)
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    forest = []
    for x in range(m):
        lists = number[ends[x] - n[x] : ends[x]]
        lists = lists[size[lists] > 1]
        need = least_overlap(n[x], n, percent)
        least = -(-percent * int(n[x]) // 100)  # against any partner
        if len(lists) < least:
            continue
        # the longest lists, fewer than the least overlap, are probed instead of merged
        lists = lists[np.argsort(size[lists], kind="stable")]
        skip = int(np.count_nonzero(size[lists] > 8))
        skip = min(skip, least - 1, int(least / (0.05 * np.log2(size[lists[-1]] + 1) + 1)))
        short, probed = lists[: len(lists) - skip], lists[len(lists) - skip :]
        c = size[short]
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[short], c)
        count = np.bincount(owner[at], minlength=m)
        close = 100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])
        y = np.flatnonzero(close & (count + skip >= need))
        y = y[y > x]
        for k in probed:
            if not len(y):
                break
            members = owner[start[k] : start[k] + size[k]]
            found = np.minimum(np.searchsorted(members, y), len(members) - 1)
            count[y] += members[found] == y
            skip -= 1
            y = y[count[y] + skip >= need[y]]
        for z in y.tolist():
            a, b = find(x), find(z)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((x, z))
    return forest


def _tiles(batches: Iterator, percent: int) -> Iterator:
    """From rows (tile, node, set) sorted by tile: links (a, b) within the tiles.

    Whole tiles are searched together up to a block: what links across tiles is a link all
    the same.
    """
    import pyarrow as pa

    def out(nodes, sets) -> pa.RecordBatch:
        found = divide_skip(sets, percent) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    nodes, sets, total, last = [], [], 0, None
    for batch in batches:
        for key, node, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if key != last:
                if len(nodes) >= BLOCK or total >= BLOCK_SHINGLES:
                    yield out(nodes, sets)
                    nodes, sets, total = [], [], 0
                last = key
            s = np.frombuffer(data, np.uint64)
            if len(s):
                nodes.append(node)
                sets.append(s)
                total += len(s)
    yield out(nodes, sets)


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """2**24 bits (2 MB), of which those of the wanted keys are set: what has an unset one isn't wanted."""
    bit = F.pmod("key", F.lit(1 << FILTER_BITS)) + 1
    rows = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8).reshape(-1, 4096)
    for r in rows.collect():
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Rows (node, group, n, data): the shingles of the wanted texts (doc_id, key, node, group) as bytes.

    A filter of fixed size keeps nearly all others from being read and moved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            bit = np.mod(batch.column(1).to_numpy(), 1 << FILTER_BITS)
            batch = batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "data"])

    found = docs.select("doc_id", _key(), "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, key long, n long, data binary")
    return found.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("node", "group", "n", "data")


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the tiles of ``rows`` (tile long, node, data), as a table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("tile", "node", "data").repartition(parts, "tile").sortWithinPartitions("tile")
    return written(rows.mapInArrow(lambda it: _tiles(it, percent), "a long, b long"), "links")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (group, count, blocks) of ``rows`` (group, node, n)."""
    size = rows.groupBy("group").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return size.select("group", "count", blocks.alias("blocks"))


def _own(seed: str) -> Column:
    """The block of a node among ``blocks``."""
    return F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("blocks")).cast("int")


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (id, component) of the sets that link, by all links within the groups of ``sets`` or as many as connect the same."""
    blocks = written(_blocks(sets.select("group", "n")).where("blocks > 1"), "blocks")
    placed = sets.join(blocks, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    links = _searched(placed.withColumn("tile", F.xxhash64("group", _own("block"))), percent)
    kin = components(links)
    if blocks.isEmpty():
        return kin
    large = sets.select("group", "node", "n").join(blocks, "group", "left_semi")
    data = sets.join(blocks, "group", "left_semi").select("node", "data")

    def named() -> DataFrame:
        own = kin.withColumnRenamed("id", "node")
        return written(large.join(own, "node", "left").select("group", "node", "n", F.coalesce("component", "node").alias("kin")), "kin")

    turn, now = 0, named()
    while True:
        # the least node of each component stands for it, until those of a group fit one block
        heads = now.where("node = kin")
        before, blocks = blocks, written(_blocks(heads), "blocks")
        again = before.where("blocks > 1").join(blocks.select("group", F.col("blocks").alias("left"), F.col("count").alias("heads")), "group")
        again = written(again.where("left < blocks AND heads > 1").select("group", F.col("left").alias("blocks")), "again")
        if again.isEmpty():
            break
        turn += 1
        found = _searched(heads.join(again, "group").select(F.xxhash64("group", _own(f"turn {turn}")).alias("tile"), "node").join(data, "node"), percent)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        kin = components(links)
        now = named()
    sizes = now.groupBy("group", "kin").agg(F.count("*").alias("count")).groupBy("group").agg(F.max(F.struct("count", "kin"))["kin"].alias("most"))
    outside = written(now.join(sizes, "group").where("kin <> most").select("group", "node", "n"), "outside")
    if outside.isEmpty():
        return kin
    of_all, of_outside = (_blocks(x).select("group", F.col("blocks").alias(name)) for x, name in ((now, "all_blocks"), (outside, "out_blocks")))
    counts = written(of_outside.join(of_all, "group"), "blocks")
    mine = outside.join(counts, "group").withColumn("blocks", F.col("out_blocks")).withColumn("o", _own("outside"))
    mine = mine.select("group", "node", "o", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("k"))
    every = now.join(counts, "group").withColumn("blocks", F.col("all_blocks")).withColumn("k", _own("all"))
    every = every.select("group", "node", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("o"), "k")
    tiles = mine.unionByName(every).select(F.xxhash64("group", "o", "k", F.lit("outside")).alias("tile"), "node").distinct()
    return components(links.unionByName(_searched(tiles.join(data, "node"), percent)))


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (doc_id, key, n, component), one for each row of ``docs``; ``key`` is the hash of its text."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows = written(_prefixes(docs, words, percent), "prefixes")
    same = ["n", "f1", "f2"]
    # copies are put together before anything is shuffled
    reps = rows.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min_by(F.struct("key", "prefix"), "doc_id").alias("of"))
    reps = written(reps.where("least IS NOT NULL").select(*same, "least", "of.key", "of.prefix", F.monotonically_increasing_id().alias("node")), "sets")
    postings = reps.select(F.posexplode("prefix").alias("place", "h"), "node", "n").select("h", "n", F.col("place").cast("long"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = postings.repartition(parts, "h").sortWithinPartitions("h", "n")
    met = written(
        postings.mapInArrow(lambda it: _met(it, percent), "kind tinyint, a long, b long, n long, m long, c long")
        .groupBy("kind", "a", "b", "n", "m").agg(F.sum("c").alias("c")), "met",
    )
    long = met.where("kind = 2").select(F.col("a").alias("id"), "c")
    pairs = met.where("kind = 0")
    for side in ("a", "b"):
        pairs = pairs.join(long.select(F.col("id").alias(side), F.col("c").alias(f"long_{side}")), side, "left")
    pairs = pairs.where(f"c + least(coalesce(long_a, 0), coalesce(long_b, 0)) >= {_needed('n', 'm', percent)}").select("a", "b")
    group = components(pairs.unionByName(met.where("kind = 1").select("a", "b")))
    wanted = group.join(reps.select(F.col("node").alias("id"), F.col("least").alias("doc_id"), "key"), "id")
    wanted = written(wanted.select("doc_id", "key", F.col("id").alias("node"), F.col("component").alias("group")), "wanted")
    linked = _linked(written(_sets(docs, wanted, words), "candidates"), percent)
    linked = reps.select(*same, "node", "least").join(linked, reps["node"] == F.col("id"), "left")
    linked = written(linked.select(*same, "least", F.coalesce("component", "node").alias("component")), "linked")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    # a table of its own, so that adaptive execution can split a text that very many rows have
    found = written(linked.join(smallest, "component").select(*same, "smallest"), "components")
    some = rows.where("n > 0").select("doc_id", "key", *same).join(found, same, "left").select("doc_id", "key", "n", F.col("smallest").alias("component"))
    return some.unionByName(rows.where("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component")))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``."""
    return _classes(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _needed(n: str, m: str, percent: int) -> str:
    """SQL for how many shingles a linked pair shares among its rarest ones, at least.

    Those of the set whose part ends first all lie in the other's part; its rest holds
    ceil(percent n / 100) - 1 shingles.
    """
    total = f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"
    return f"greatest(1, {total} - greatest(({percent} * {n} + 99) div 100, ({percent} * {m} + 99) div 100) + 1)"


def dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of one document, the smallest id, of each component.

    Rows of another id in a component go; empty texts, null ids and repeated rows of the
    document that stays all stay. Of rows that share an id, only those go whose own text
    has a smaller document.
    """
    gone = _classes(docs, words, percent).where("doc_id <> component").select("doc_id", "key").distinct()
    rows = docs.select(beside(docs).alias("row"))
    match = (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("key"))
    return rows.join(gone, match, "left_anti").select(*columns_of("row", docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
