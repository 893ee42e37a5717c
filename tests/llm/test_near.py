import collections
import math
import random

import numpy as np
import pytest

from pathclear.llm import covertree, jaccard
from pathclear.operators.graph import merge_labels
from tests.llm import rows as R


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows):
    """Links and classes by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or sets[i] and sets[j]
             and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    links = collections.Counter(i for p in pairs for i in p)
    label = merge_labels(len(rows), *(np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ()))))
    least = {}
    for i, k in enumerate(label):
        least[k] = min((x for x in (least.get(k), rows[i][0]) if x is not None), default=None)
    return collections.Counter((rows[i][0], least[label[i]], links[i]) for i in range(len(rows))), len(least)


def near_copies(rng, n, words, edits):
    base = R.words(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = R.words(rng, 1)
        out.append(" ".join(w))
    return out


def rows_of(kind):
    rng = random.Random(7)
    if kind == "edges":
        return [r for r in R.texts() if r[0] not in (5, 6)]
    shared = R.words(rng, 60)
    texts = near_copies(rng, 150, 120, 6) + near_copies(rng, 40, 30, 1) + [f"{R.words(rng, 100)} {shared} {R.words(rng, 100)}" for _ in range(120)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("kind", "small", "block"), [("edges", 64, 512), ("groups", 64, 512), ("groups", 8, 32)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, kind, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", block + 8)
    rows = rows_of(kind)
    want, n = classes(rows)
    got = collections.Counter(tuple(r) for r in jaccard.similarity_join(R.frame(spark, rows)).collect())
    assert got == want
    if small != 8:
        kept = jaccard.one_of_each(R.frame(spark, rows))
        assert kept.columns == R.frame(spark).columns and kept.count() == n


def test_sketches_lose_next_to_nothing():
    def fewer(n):
        """Chance that a pair at the threshold has too few of ``n`` filled bins equal."""
        return sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n + 1) if k < jaccard.LIKELY * n)

    rng = np.random.default_rng(13)
    filled = [np.unique(rng.integers(0, jaccard.BINS, jaccard.SKETCHED)).size for _ in range(2000)]
    assert np.mean([fewer(n) for n in filled]) < 1e-6 and fewer(jaccard.BINS) < 1e-6


def test_long_pairs_just_above_the_threshold(spark):
    rng, rows = random.Random(14), []
    for shingles in range(300, 1001, 10):
        w = R.words(rng, shingles + 4).split()
        least, most = -(-8 * shingles // 9), int(0.918 * shingles)  # shared ones: similarity of 0.80 to 0.85
        new = shingles - (least if shingles % 20 else rng.randint(least, most))
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: len(w) - new] + R.words(rng, new).split()))]
    sets = [shingle_set(t) for _, t in rows]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert min(share) >= 0.8 and max(share) <= 0.86
    got = collections.Counter(tuple(r) for r in jaccard.similarity_join(R.frame(spark, rows)).collect())
    assert got == classes(rows)[0]


def test_empty_tables(spark):
    assert jaccard.similarity_join(R.empty(spark)).count() == 0
    assert jaccard.one_of_each(R.empty(spark)).count() == 0


def test_shingles_do_not_see_their_neighbours():
    rng = random.Random(3)
    texts = [R.words(rng, n) for n in (1, 4, 5, 6, 300)] + ["", " ", "a b", "A  B\n", "a b"]
    gram, edges = jaccard.shingles(texts)
    for t, i, j in zip(texts, edges[:-1], edges[1:], strict=True):
        assert (jaccard.shingles([t])[0] == gram[i:j]).all() and j - i == len(shingle_set(t))


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_trees_find_exactly_the_near_pairs(kind):
    rng = np.random.default_rng(2)
    for threshold in (0.5, 0.93, 0.99):
        n, d = 180, 6
        x = rng.normal(size=(n, d))
        if kind != "random":
            x = x[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * (0.15 if kind == "clusters" else 0)
        x, copies = covertree.unit(x), rng.integers(1, 4, n)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        counts, _, u, v = covertree.block_links(x, None, copies, None, threshold)
        assert (counts == near @ copies).all()
        assert (merge_labels(n, u, v) == merge_labels(n, *np.nonzero(np.triu(near)))).all()
        one, two, u, v = covertree.block_links(x[:80], x[80:], copies[:80], copies[80:], threshold)
        assert (one == near[:80, 80:] @ copies[80:]).all() and (two == near[80:, :80] @ copies[:80]).all()


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 5))
    x = (base[rng.integers(0, 30, 160)] + rng.normal(size=(160, 5)) * rng.choice([0, 0.1], (160, 1))).astype(np.float32)
    label = rng.choice([1, 2], 160, p=[0.8, 0.2])
    rows = [(int(i), [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    one = rows[0][1]
    odd = [(900, None, 1), (901, [0.0] * 5, 1), (902, [1.0, None, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 5, 1), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1),
           (905, [], 1), (906, one, None), (907, one[:3], 1), (908, [c * 3e30 for c in one], rows[0][2]), (909, [-0.0, 0.0, 0.0, 0.0, 1.0], 2),
           (910, [0.0, -0.0, 0.0, 0.0, 1.0], 2)]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, node long, cell string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(frame).collect()}
    good = [(i, v, k) for i, v, k in rows + odd if i < 900 or i in (907, 908, 909, 910)]
    n = len(good)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                p, q = (np.array(good[k][1], np.float32).astype(float) for k in (a, b))
                near[a, b] = p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.93
    labels = merge_labels(n, *np.nonzero(np.triu(near)))
    for a in range(n):
        least = min(good[b][0] for b in range(n) if labels[b] == labels[a])
        assert got[good[a][0]] == (near[a].sum(), least, least == good[a][0])
    assert all(got[i] == (0, i, True) for i in range(900, 907))
    assert covertree.near_vectors(frame.limit(0)).count() == 0


def test_labels_are_told_apart_by_their_value(spark):
    """hash(-1) equals hash(-2) in Python."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 8))
    x = (base[rng.integers(0, 400, 7500)] + rng.normal(size=(7500, 8)) * 0.12).astype(np.float32)
    label = np.r_[np.full(6000, -1), np.full(1500, -2)]
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    unit = covertree.unit(x)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = covertree.near_vectors(frame).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() == near.sum(1)).all() and near.sum() > 50_000
    labels = merge_labels(7500, *np.nonzero(np.triu(near)))
    assert len(got.component_id.unique()) == len(np.unique(labels))
