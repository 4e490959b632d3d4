"""Toxicity by a linear classifier with a counterfactual penalty.

Features are the words of a text and their prefixes, each counted once a text; those that
tell the labels apart best in the labelled sample (by the likelihood ratio) are kept.
Beside the logistic loss, the fit pays for every change of score that comes from swapping
an identity term in a labelled sentence for another of its group, so that neutral mentions
of a group do not score as toxic.

The sample is bounded by ``SAMPLE`` (rows of labels, outside the held-out fold); scoring
covers every text in full. Empty and null texts get the score of a text without features.
Repeated rows give repeated rows and an empty table gives none; without usable labels
every score is 0. A null doc_id belongs to the fold of the empty text. Labels, lang, source and doc_id are no inputs of a
score; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, ready, sliced, table
from .learning import fold, labelled_sample

#: Most labelled rows that the fit sees.
SAMPLE = 12_000
FEATURES = 2_000
#: A feature is kept if its likelihood ratio against the labels is as large as this.
LEAST_RATIO = 15.0
PENALTY = 5.0
RIDGE = 0.5
PREFIXES = (4, 5, 6)
CACHE_WORDS = 300_000

#: Identity terms by group; a swap stays within a group.
IDENTITY = (
    ("man", "woman", "men", "women", "boy", "girl", "male", "female", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "russian", "polish"),
    ("young", "old", "elderly", "teenage", "disabled", "blind", "deaf", "immigrant", "refugee"),
    ("homme", "femme", "juif", "musulman", "hombre", "mujer", "mann", "frau", "jude", "moslem"),
)
_GROUP = {w: g for g in IDENTITY for w in g}
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> tuple[str, ...]:
    """The word and its prefixes; a mark keeps a prefix apart from a word spelled like it."""
    return (word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n])


def swapped(words: list[str], seed: int) -> list[str]:
    """The words with each identity term replaced by another of its group."""
    draw = random.Random(seed)
    return [draw.choice([x for x in _GROUP[w] if x != w]) if w in _GROUP else w for w in words]


class Reader:
    """Gives texts their feature numbers; remembers words up to a bound."""

    def __init__(self, names: list[str], cache: int = CACHE_WORDS):
        self.number = {x: i for i, x in enumerate(names)}
        self.limit, self.known = cache, {}

    def ids(self, words) -> list[int]:
        found: set[int] = set()
        if len(self.known) > self.limit:
            self.known = {}
        known, number = self.known, self.number
        for w in set(words):
            got = known.get(w)
            if got is None:
                got = known[w] = tuple([number[f] for f in features_of(w) if f in number])
            if got:
                found.update(got)
        return sorted(found)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _feature_table(sample: DataFrame, n: int, n_toxic: int) -> list[str]:
    """The best features by the likelihood ratio of the sample's counts, and all identity terms."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(seen)
            columns = [names, [seen[x] for x in names], [toxic[x] for x in names]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["f", "n", "t"])

        for batch in sliced(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = {f for w in set(words_of(text)) for f in features_of(w)}
                seen.update(got)
                if label:
                    toxic.update(got)
            if len(seen) > 500_000:
                yield out()
                seen, toxic = Counter(), Counter()
        yield out()

    counts = sample.select("text", "label").mapInArrow(run, "f string, n long, t long")
    counts = counts.groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("n >= 5")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = n_toxic / n
    k, m = F.col("t").cast("double"), F.col("n").cast("double")
    ratio = 2 * (
        part(k, m * rate) + part(m - k, m * (1 - rate)) + part(n_toxic - k, (n - m) * rate) + part((n - m) - (n_toxic - k), (n - m) * (1 - rate))
    )
    best = counts.where(F.col("n") < n).withColumn("g", ratio).where(F.col("g") >= LEAST_RATIO)
    rows = best.orderBy(F.col("g").desc(), "f").limit(FEATURES).collect()
    return list(dict.fromkeys([r["f"] for r in rows] + sorted(_GROUP)))


def _largest(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, d: int) -> float:
    """A bound on the largest eigenvalue of X'X / n for sparse X, by power steps."""
    if not len(col):
        return 0.0
    v, size = np.ones(d + 1), 0.0
    for _ in range(30):
        v = np.bincount(col, value * np.bincount(row, value * v[col], n)[row], d + 1) / n
        size = float(np.linalg.norm(v))
        if size == 0:  # the ones were orthogonal to all: fall back on the longest row
            return float(np.bincount(row, value**2, n).max())
        v /= size
    return 1.2 * size


def fit_weights(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], d: int, penalty: float = PENALTY) -> np.ndarray:
    """Weights and, last, the bias: logistic loss, ridge, and the mean squared change of score over ``pairs``."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((j for r in rows for j in r), np.int64, len(row))
    prow = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(pairs)] or [np.empty(0, np.int64)]).astype(np.int64)
    pcol = np.array([j for a, b in pairs for j in (*a, *b)], np.int64)
    psign = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    m = max(1, len(pairs))
    w = np.zeros(d + 1)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    w[d] = np.log(share / (1 - share))
    ahead, before = w.copy(), w.copy()
    one = np.ones(len(col))
    steep = 0.25 * (_largest(row, col, one, n, d) + 1) + RIDGE / max(n, 1) + 2 * penalty * _largest(prow, pcol, psign, m, d)
    step = 1.0 / steep
    moment = 1.0
    for _ in range(400):  # accelerated gradient descent, restarted when it turns
        z = np.bincount(row, ahead[col], n) + ahead[d]
        err = (1 / (1 + np.exp(-z)) - labels) / max(n, 1)
        grad = np.bincount(col, err[row], d + 1)
        grad[d] += err.sum()
        grad[:d] += RIDGE / max(n, 1) * ahead[:d]
        if len(pcol):
            change = np.bincount(prow, psign * ahead[pcol], m)
            grad += np.bincount(pcol, 2 * penalty / m * psign * change[prow], d + 1)
        before, w = w, ahead - step * grad
        if grad @ (w - before) > 0:
            moment = 1.0
        following = (1 + np.sqrt(1 + 4 * moment**2)) / 2
        ahead = w + (moment - 1) / following * (w - before)
        moment = following
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Feature names and weights (the bias last), from a bounded sample of labelled rows."""
    ready(docs.sparkSession)
    sample = checkpointed(labelled_sample(docs, labels, "toxic", most))
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        w = np.zeros(1)
        w[0] = 30.0 if n_toxic else -30.0
        return [], w
    names = _feature_table(sample, n, n_toxic)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = Reader(names)
        for batch in sliced(batches):
            ids, ours, theirs = [], [], []
            for text in batch.column(1).to_pylist():
                ids.append(reader.ids(words_of(text)))
                a: set[int] = set()
                b: set[int] = set()
                for sentence in _SENTENCE.split((text or "").lower()):
                    words = _WORDS.findall(sentence)
                    if not _GROUP.keys().isdisjoint(words):
                        a.update(reader.ids(words))
                        b.update(reader.ids(swapped(words, len(sentence))))
                ours.append(sorted(a - b))
                theirs.append(sorted(b - a))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, kind), batch.column(2).cast(pa.int32()), pa.array(ours, kind), pa.array(theirs, kind)],
                ["place", "ids", "label", "ours", "theirs"],
            )

    got = sample.mapInArrow(run, "place string, ids array<int>, label int, ours array<int>, theirs array<int>").toArrow()
    got = got.sort_by([("place", "ascending"), ("label", "ascending")])  # the same order, however the rows came
    rows, y = got.column("ids").to_pylist(), got.column("label").to_numpy().astype(float)
    pairs = [(a, b) for a, b in zip(got.column("ours").to_pylist(), got.column("theirs").to_pylist(), strict=True) if a or b]
    return names, fit_weights(rows, y, pairs, len(names))


def scores(texts: list[str | None], reader: Reader, weights: np.ndarray) -> np.ndarray:
    """Scores of the texts, from 0 to 1."""
    ids = [reader.ids(words_of(t)) for t in texts]
    size = [len(x) for x in ids]
    flat = np.fromiter((j for x in ids for j in x), np.int64, sum(size))
    z = weights[-1] + np.bincount(np.repeat(np.arange(len(ids)), size), weights[flat], len(ids))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: tuple[list[str], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, score, predicted), one for each row of ``docs``."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, weights = shared.value
        reader = Reader(names)
        for batch in sliced(batches):
            s = scores(batch.column(1).to_pylist(), reader, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: tuple[list[str], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they were."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, weights = shared.value
        reader = Reader(names)
        for batch in sliced(batches):
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), reader, weights) < threshold))

    # columns go through by place, so that any name will do
    plain = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
