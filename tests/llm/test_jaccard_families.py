"""Families of one template whose similarity lies near the threshold: exact links, and few pairs that leave the tasks."""

import random

import numpy as np
import pytest

from docaudit.llm import op09_jaccard


def components_of(texts, k, num, den):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def family(rnd, n, shared, own, name):
    """n texts of one template, followed by words of their own; some texts share a part of those."""
    template = [f"{name}{i}" for i in range(shared)]
    out = []
    for i in range(n):
        words = template + [f"{name}x{rnd.randrange(10**9)}" for _ in range(own)]
        if out and rnd.random() < 0.3:
            other = rnd.choice(out).split()
            at = rnd.randrange(own)
            words[shared : shared + at] = other[shared : shared + at]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("own", [32, 36, 40])
@pytest.mark.parametrize("part", [1024, 40])
def test_family_near_the_threshold(spark, monkeypatch, own, part):
    texts = family(random.Random(own), 220, 400, own, "a") + family(random.Random(own + 1), 40, 60, 5, "b") + ["", "one two"]
    monkeypatch.setattr(op09_jaccard, "PART", part)
    sent = []
    verified = op09_jaccard._verified

    def counted(docs, info, edges, *more):
        sent.append(edges.count())
        return verified(docs, info, edges, *more)

    monkeypatch.setattr(op09_jaccard, "_verified", counted)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op09_jaccard.jaccard_classes(d).collect()}
    assert got == dict(enumerate(components_of(texts, 4, 85, 100)))
    assert sum(sent) <= 4 * len(texts)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(op09_jaccard, "COMMON", 3)
    monkeypatch.setattr(op09_jaccard, "CELLS", 64)
    rnd = np.random.default_rng(2)
    for m in (1, 2, 9, 30):
        sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40)).astype(np.uint64)) for _ in range(m)]
        got = op09_jaccard.shared_counts(sets)
        for i in range(m):
            for j in range(m):
                assert i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_exact_forest():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 10, 200, 203, 500)]
    forest = op09_jaccard.exact_forest(sets, 85, 100)
    assert sorted(tuple(sorted(e)) for e in forest) == [(0, 1), (1, 2), (3, 4)]
    assert op09_jaccard.exact_forest(sets[:1], 85, 100) == []
