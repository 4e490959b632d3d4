"""Quality by a vote of the nearest labelled texts in a latent-semantic space.

The labelled sample (bounded by ``SAMPLE`` rows, outside the held-out fold) gives a
vocabulary of its most widespread words and word shapes, their weights by entropy, and a
truncated singular value decomposition; its latent vectors are broadcast, a fixed size.
Every document is projected, compared with all labelled vectors by exact cosine products
in blocks, and the labels of its ``NEIGHBOURS`` nearest vote, weighted by similarity.

A word's shape is its letters' classes with repeats taken together ("THERE!!" is "A!");
a few pseudo-terms stand for the number of words, the share of distinct ones and of those
that repeat the word before, so that repetition shows. Empty and null texts have only those. Without usable labels every score
is 0. Repeated rows give repeated rows; an empty table gives none. A null doc_id belongs
to the fold of the empty text. Labels, lang, source and doc_id are no inputs of a score;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, ready, sliced, table
from .learning import fold, labelled_sample

#: Most labelled rows that the fit sees, all of which vote.
SAMPLE = 4_000
TERMS = 4_096
RANK = 32
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Power of the similarity that weighs a vote.
SHARPNESS = 24
CACHE_WORDS = 300_000
#: Least weights of a shape or pseudo-term and of a word; widespread terms have a large entropy.
SHAPE_WEIGHT, WORD_WEIGHT = 0.3, 0.02
#: What a pseudo-term counts.
EXTRA = 20
#: Documents whose products with all labelled vectors are formed at once.
BLOCK = 256

_WORD = re.compile(r"[^\W\d_]+")


def shape(token: str) -> str:
    """Letters by case, digits and repeated signs taken together; of a long shape its signs and how many there are."""
    if token.isalpha():
        return "a" if token.islower() else "A" if token.isupper() and len(token) > 1 else "Aa" if token.istitle() else "aA"
    out = []
    for c in token:
        k = "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out) if len(out) <= 8 else f"{''.join(sorted(set(out)))}~{len(out).bit_length()}"


def terms_of(token: str) -> tuple[str, ...]:
    """The token's shape and all its runs of letters."""
    return ("#" + shape(token), *map(str.lower, _WORD.findall(token)))


def extra_terms(tokens: list[str]) -> list[str]:
    """Terms for the number of words, the share of distinct ones, and of those that repeat the one before."""
    n = len(tokens)
    if not n:
        return ["#n0"]
    again = sum(map(eq, tokens, tokens[1:]))
    return [f"#n{n.bit_length()}", f"#u{8 * len(set(tokens)) // n}", f"#r{0 if not again else 1 + 8 * again // n}"]


class Projector:
    """Vocabulary, term weights and the basis of the latent space."""

    def __init__(self, names: list[str], weights: np.ndarray | None = None, basis: np.ndarray | None = None):
        self.names, self.weights, self.basis = names, weights, basis
        self.number = {x: i for i, x in enumerate(names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays (text, term, count) of the known terms of the texts, ordered by text and term."""
        v = len(self.names)
        number = self.number
        at: list[int] = []
        of: list[int] = []
        times: list[int] = []
        for i, text in enumerate(texts):
            tokens = (text or "").split()
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            known = self.known
            for token, c in Counter(tokens).items():
                got = known.get(token)
                if got is None:
                    got = known[token] = tuple([number[t] for t in terms_of(token) if t in number])
                for j in got:
                    of.append(j)
                    times.append(c)
            for t in extra_terms(tokens):
                if t in number:
                    of.append(number[t])
                    times.append(EXTRA)
            at.append(len(of))
        row = np.repeat(np.arange(len(texts)), np.diff([0, *at]))
        total = np.bincount(row * v + np.array(of, np.int64), np.array(times, np.float64), len(texts) * v)
        some = np.flatnonzero(total)
        return some // v, some % v, total[some]

    def latent(self, n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Unit vectors of n texts in the latent space (zero where a text has no known term)."""
        x = np.log1p(count) * self.weights[term]
        x /= np.maximum(np.sqrt(np.bincount(row, x * x, n)), 1e-9)[row]
        y = np.zeros((n, self.basis.shape[1]))
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            y[row[first]] = np.add.reduceat(x[:, None] * self.basis[term], first, axis=0)
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)


def _vocabulary(sample: DataFrame, most: int) -> list[str]:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                tokens = (text or "").split()
                seen.update({t for w in set(tokens) for t in terms_of(w)} | set(extra_terms(tokens)))
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[x] for x in names], pa.int64())], ["term", "n"])

    counts = sample.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = counts.where("n >= 3").orderBy(F.col("n").desc(), "term").limit(most).collect()
    return [r["term"] for r in rows]


def decompose(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors [term, rank], by random projection and two power steps."""
    rank = min(rank, *x.shape)
    y = x @ np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 8, x.shape[1]))).astype(np.float32)
    for _ in range(2):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple | None:
    """(names, weights, basis, latent vectors, labels) of the labelled sample, or None without labels."""
    ready(docs.sparkSession)
    sample = checkpointed(labelled_sample(docs, labels, "quality", most))
    names = _vocabulary(sample, TERMS)
    if not names:
        return None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = Projector(names)
        for batch in sliced(batches, BLOCK):
            n = batch.num_rows
            row, term, count = reader.counts(batch.column(1).to_pylist())
            to = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(to, pa.array(x)) for x in (term.astype(np.int32), count.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2).cast(pa.int32())], ["place", "ids", "counts", "label"])

    got = sample.mapInArrow(run, "place string, ids array<int>, counts array<float>, label int").toArrow()
    got = got.sort_by([("place", "ascending"), ("label", "ascending")]).combine_chunks()  # the same order, however the rows came
    y = got.column("label").to_numpy().astype(np.float32)
    n, v = len(y), len(names)
    if not n:
        return None
    x = np.zeros((n, v), np.float32)
    for i, (ids, counts) in enumerate(zip(got.column("ids"), got.column("counts"), strict=True)):
        x[i, ids.values.to_numpy()] = counts.values.to_numpy()
    share = x / np.maximum(x.sum(axis=0), 1e-9)
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=0) / np.log(max(n, 2))
    least = np.array([SHAPE_WEIGHT if x.startswith("#") else WORD_WEIGHT for x in names])
    weights = np.maximum(1 - entropy, least).astype(np.float32)
    x = np.log1p(x) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    basis = decompose(x, RANK)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return names, weights, basis, np.ascontiguousarray(z), y


def vote(z: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Shares of label 1 among each row's k nearest vectors, weighted by similarity.

    Similarities are compared to six places; where vectors tie for the last places, each
    counts with an equal part of them, so neither order nor chance decides.
    """
    near = np.round(z.astype(np.float32) @ vectors.T, 6)
    k = min(k, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(near, at, axis=1)
    last = top.min(axis=1)
    value = labels[at].astype(np.float64)
    tied = np.flatnonzero((near == last[:, None]).sum(axis=1) > (top == last[:, None]).sum(axis=1))
    for i in tied:
        value[i, top[i] == last[i]] = labels[near[i] == last[i]].mean()
    weight = np.maximum(top, 0).astype(np.float64) ** SHARPNESS + 1e-9
    return (weight * value).sum(axis=1) / weight.sum(axis=1)


def score(docs: DataFrame, model: tuple | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted), one for each row of ``docs``."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = model_ = None
        if shared.value is not None:
            names, weights, basis, *model_ = shared.value
            reader = Projector(names, weights, basis)
        for batch in sliced(batches, BLOCK):
            s = np.zeros(batch.num_rows)
            if reader:
                s = np.clip(vote(reader.latent(len(s), *reader.counts(batch.column(1).to_pylist())), *model_), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
