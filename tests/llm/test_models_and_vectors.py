from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from tallymark.llm import ann, bitslice, learning, quality, toxicity

from .fixtures import folder

RNG = np.random.default_rng(3)


def vectors(n=400, d=16):
    base = RNG.normal(size=(n, d)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [{"vec_id": i, "embedding": v.tolist(), "label": 0, "block": 7} for i, v in enumerate(base)]
    common = base[5].tolist()
    for i in range(0, n, 3):  # a third of all rows hold one vector
        rows[i]["embedding"] = common
    rows += [
        {"vec_id": n, "embedding": None}, {"vec_id": n + 1, "embedding": [None] * d}, {"vec_id": n + 2, "embedding": [float("nan")] * d},
        {"vec_id": n + 3, "embedding": [float("inf")] + [0.0] * (d - 1)}, {"vec_id": None, "embedding": common}, {"vec_id": n + 20, "embedding": [0.0] * d},
        {"vec_id": n + 21, "embedding": [0.5, 0.5]}, {"vec_id": 7, "embedding": rows[7]["embedding"]},
    ]
    return rows


def usable(rows, zero=True):
    out = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            v = np.array(v + [0.0] * (16 - len(v)), np.float32).astype(float)
            out[r["vec_id"]] = v
    return out


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    rows = vectors()
    return folder(tmp_path_factory.mktemp("vectors"), [], rows), rows


@pytest.mark.parametrize("shape", [{}, {"index_rows": 60, "query_rows": 3, "together": 2}])
def test_bitslice_equals_brute_force(spark, store, shape):
    path, rows = store
    good = usable(rows)
    ids = np.array(sorted(good))
    x = np.floor(64 * np.stack([good[i] for i in ids])).astype(np.int64)
    expect = set()
    for i, q in enumerate(ids):
        if q % 20 == 0:
            scores = x @ x[i]
            order = [j for j in np.lexsort((ids, -scores)) if j != i][:20]
            expect |= {(q, r + 1, ids[j], scores[j]) for r, j in enumerate(order)}
    got = {tuple(r) for r in bitslice.top_k(spark.read.parquet(f"{path}/embeddings.parquet"), **shape).collect()}
    assert got == expect


def test_bitslice_arithmetic():
    a, b = RNG.integers(0, 500, (130, 3)), RNG.integers(0, 500, (130, 3))
    back = lambda s, n: sum(np.unpackbits(s[i].view(np.uint8), axis=1, bitorder="little")[:, :n].astype(np.int64).T << i for i in range(len(s)))
    bits = max(len(bitslice.slices(a)), len(bitslice.slices(b)))
    x, y = (np.pad(s, ((0, bits - len(s)), (0, 0), (0, 0))) for s in (bitslice.slices(a), bitslice.slices(b)))
    assert (back(bitslice.add(x, y), 130) == a + b).all()
    many = bitslice.multiples(x, 6)
    assert all((back(np.ascontiguousarray(many[:, 3 * m : 3 * m + 3]), 130) == m * a).all() for m in range(7))


def test_bitslice_takes_large_weights_and_refuses_too_large():
    m = RNG.normal(size=(50, 8)) * 40
    m[3, 2], m[7] = 2e7, 0.5e5  # too large for slices, not for exact numbers
    q, v, s = bitslice.match(bitslice.index(np.arange(50), m), bitslice.queries(np.arange(50), m), 50)
    whole = [[int(x) for x in row] for row in bitslice.quantise(m)]
    expect = {(i, j, sum(a * b for a, b in zip(whole[i], whole[j], strict=True))) for i in range(50) for j in range(50) if i != j}
    assert set(zip(q.tolist(), v.tolist(), s, strict=True)) == expect


def test_bitslice_raises_only_for_scores_that_fit_no_long(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitslice.top_k(frame([(20, [2e7, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (40, [0.5] * 300)])).collect()
    assert {(r.query_id, r.vec_id): r.score for r in got if r.query_id == 20} == {(20, 2): 64 * 64 * 20_000_000, (20, 40): 32 * 64 * 20_000_000 + 32 * 64, (20, 1): 64 * 64}
    with pytest.raises(Exception, match="fit a long"):
        bitslice.top_k(frame([(20, [1e15]), (1, [1e15])])).collect()


@pytest.mark.parametrize("shape", [{}, {"block_rows": 90}])
def test_ann_recall_and_exact_scores(spark, store, shape):
    path, rows = store
    good = usable(rows, zero=False)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    got = {}
    for r in ann.nearest(spark.read.parquet(f"{path}/embeddings.parquet"), **shape).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for i, q in enumerate(ids):
        if q % 20:
            continue
        mine = sorted(got.pop(q))
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1)) and len(mine) == 20
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        scores = np.zeros(len(ids))
        for d in range(16):
            scores += x[i, d] * x[:, d]
        at = {v: k for k, v in enumerate(ids)}
        assert all(s == scores[at[v]] for _, v, s in mine)
        order = [ids[j] for j in np.lexsort((ids, -scores)) if j != i][:20]
        hit += len(set(order) & {v for _, v, _ in mine})
        total += 20
    assert not got and hit >= 0.9 * total


def test_ann_verifies_few_rows_of_clustered_vectors(spark):
    """Under half of the rows, and recall of 0.9 at least, against brute force."""
    rng = np.random.default_rng(5)
    n, d = 12_000, 32
    centres = rng.normal(size=(60, d)) * 3
    x = centres[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(rows, every=200, block_rows=1000).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.verified))
    hit = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len({v for v, _ in found} & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 60 and hit >= 0.9 * 20 * 60
    assert np.mean([found[0][1] for found in got.values()]) < 0.5 * n


def test_upper_tree_places_all_points():
    points = RNG.normal(size=(5000, ann.PROJECTIONS))
    leaf = ann.leaf_of(points, ann.upper_tree(points[:1000], 16))
    assert leaf.min() == 0 and leaf.max() == 15 and np.bincount(leaf).max() < 1000
    assert (ann.leaf_of(points[:7], []) == 0).all()


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)


def test_tree_has_whole_leaves():
    order = ann.tree_order(RNG.normal(size=(333, 4)), 16)
    assert sorted(order) == list(range(333))


# --- classifiers --------------------------------------------------------------------------------


def corpus(n=600):
    rng = random.Random(8)
    pool = sorted({"".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)})
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(pool) for _ in range(rng.randint(10, 60))]
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["nastyword", "vileness", "nastyish"]))
        if rng.random() < 0.3:
            text.insert(0, rng.choice(["woman", "man", "muslim", "jewish"]))
        if junk:
            text = [w.upper() + "!!" for w in text]
        docs.append({"doc_id": i, "text": " ".join(text), "source": "s", "lang": "en"})
        if i % 3:
            labels.append({"doc_id": i, "quality": int(not junk), "toxic": int(toxic), "text": "clash"})
    docs += [{"doc_id": n, "text": None}, {"doc_id": n + 1, "text": ""}, {"doc_id": None, "text": "no id"}]
    labels += [{"doc_id": 1, "quality": None, "toxic": None}, {"doc_id": None, "quality": 1, "toxic": 1}, dict(labels[0])]
    return docs, labels


@pytest.fixture(scope="module")
def labelled(tmp_path_factory):
    docs, labels = corpus()
    return folder(tmp_path_factory.mktemp("labelled"), docs, [], labels), docs, labels


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, labelled, module, label):
    path, docs, labels = labelled
    truth = {r["doc_id"]: r[label] for r in labels if r["doc_id"] is not None and r[label] is not None}
    got = module.query(spark, path).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    again = {r.doc_id: r.score for r in module.query(spark, path).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_labels_of_the_held_out_fold_change_nothing(spark, labelled, tmp_path):
    path, docs, labels = labelled
    other = [r | {"toxic": 1 - r["toxic"]} if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r for r in labels]
    a = {r.doc_id: r.score for r in toxicity.query(spark, path).collect()}
    b = {r.doc_id: r.score for r in toxicity.query(spark, folder(tmp_path, docs, [], other)).collect()}
    assert a == b


def test_penalty_evens_out_identity_terms():
    """Two identity words, one of which comes with the label: without the penalty it would score."""
    rows = [[0]] * 40 + [[1]] * 40
    labels = np.array([1.0] * 30 + [0.0] * 10 + [1.0] * 10 + [0.0] * 30)
    pairs = [([0], [1]), ([1], [0])] * 20
    free = toxicity.fit_weights(rows, labels, pairs, 2, penalty=0.0)
    held = toxicity.fit_weights(rows, labels, pairs, 2, penalty=5.0)
    assert free[0] - free[1] > 1 and abs(held[0] - held[1]) < 0.1 * (free[0] - free[1])


def test_swaps_stay_in_their_group():
    words = ["the", "muslim", "woman", "ran"]
    got = toxicity.swapped(words, 3)
    assert got[0] == "the" and got[3] == "ran" and got[1] != "muslim" and got[1] in toxicity._GROUP["muslim"] and got[2] in toxicity._GROUP["woman"]


@pytest.mark.parametrize("labels", [[], [{"doc_id": 3, "quality": 1, "toxic": 0}]])
def test_few_or_no_labels(spark, tmp_path, labels):
    path = folder(tmp_path, [{"doc_id": 3, "text": "a b"}, {"doc_id": 4, "text": None}], [], labels)
    for module in (toxicity, quality):
        assert sorted(r.doc_id for r in module.query(spark, path).collect()) == [3, 4]


def test_votes_equal_brute_force():
    z, v, y = RNG.normal(size=(5, 6)), RNG.normal(size=(40, 6)), RNG.integers(0, 2, 40)
    z, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (z, v))
    got = quality.vote(z, v, y, 7)
    for i in range(5):
        near = np.round(v @ z[i], 6)
        top = np.argsort(-near)[:7]
        w = np.maximum(near[top], 0) ** quality.SHARPNESS + 1e-9
        assert got[i] == pytest.approx((w * y[top]).sum() / w.sum(), rel=1e-4)


def test_tied_votes_do_not_depend_on_order():
    """Copies with different labels at the last places count with equal parts of them."""
    v = np.array([[1.0, 0.0]] * 3 + [[0.6, 0.8]] * 6, np.float32)
    y = np.array([1, 1, 0, 1, 0, 0, 1, 0, 0], np.float32)
    z = np.array([[1.0, 0.0]])
    expect = None
    for _ in range(20):
        order = RNG.permutation(len(v))
        got = quality.vote(z, v[order], y[order], 5)[0]
        expect = got if expect is None else expect
        assert got == pytest.approx(expect, abs=1e-12)
    w = np.array([1.0, 1.0, 1.0, 0.6**quality.SHARPNESS, 0.6**quality.SHARPNESS]) + 1e-9
    assert expect == pytest.approx((2 * w[0] + 2 * w[3] / 3) / w.sum(), rel=1e-4)


def test_sample_takes_one_text_an_id(spark):
    """Repeated ids don't lift the bound, and which row comes first doesn't matter."""
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = learning.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(got) == 10 and all(zlib.crc32(str(int(r.text[5:]) % 40).encode()) % 5 for r in got)
    assert {r.text for r in got} == {min(f"text {i}" for i in range(int(r.text[5:]) % 40, 4000, 40)) for r in got}


def test_shapes_and_terms_read_whole_tokens():
    long = "a1" * 40 + "Zq"
    assert quality.shape(long) != quality.shape(long[:64]) and quality.shape("x" * 70 + "!") == "a!"
    assert quality.terms_of("http://foo.bar/Baz")[1:] == ("http", "foo", "bar", "baz")


def test_scores_equal_a_plain_reading_of_the_models(spark, labelled):
    """The whole queries of both classifiers against the fitted model, applied text by text in plain Python."""
    path, docs, _ = labelled
    table = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels")}
    names, w = toxicity.fit(table["documents"], table["labels"])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score, r.predicted) for r in toxicity.query(spark, path).collect())
    expect = []
    for r in docs:
        words = set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))
        have = words | {x[:n] + "*" for x in words for n in toxicity.PREFIXES if len(x) >= n}
        score = 1 / (1 + np.exp(-(w[-1] + sum(w[i] for i, f in enumerate(names) if f in have))))
        expect.append((r["doc_id"] is None, r["doc_id"] or 0, score, int(score >= 0.5)))
    for a, b in zip(got, sorted(expect), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9) and a[3] == b[3]

    names, weights, basis, vectors, y = quality.fit(table["documents"], table["labels"])
    got = {r.doc_id: r.score for r in quality.query(spark, path).collect()}
    for r in docs:
        tokens = (r["text"] or "").split()
        count = dict.fromkeys(names, 0)
        for t in [x for token in tokens for x in quality.terms_of(token)]:
            if t in count:
                count[t] += 1
        for t in quality.extra_terms(tokens):
            if t in count:
                count[t] += quality.EXTRA
        x = np.array([np.log1p(count[n]) * weights[i] for i, n in enumerate(names)])
        z = (x / max(np.linalg.norm(x), 1e-9)) @ basis
        z = z / max(np.linalg.norm(z), 1e-9)
        near = np.round(vectors @ z, 6)
        last = sorted(near, reverse=True)[: quality.NEIGHBOURS][-1]
        above, equal = np.flatnonzero(near > last), np.flatnonzero(near == last)
        room = min(quality.NEIGHBOURS, len(near)) - len(above)
        weight = lambda s: np.maximum(s, 0) ** quality.SHARPNESS + 1e-9
        total = weight(near[above]).sum() + room * weight(last)
        assert got[r["doc_id"]] == pytest.approx(((weight(near[above]) * y[above]).sum() + room * weight(last) * y[equal].mean()) / total, abs=2e-3)
