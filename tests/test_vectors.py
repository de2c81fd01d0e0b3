"""Approximate vector search against the exact one, and the label model against one that holds all vote vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docaudit.operators import retrieval, rules, vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def clustered(spark, n, dim=64, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((n // 50, dim))
    x = centres[rnd.integers(0, len(centres), n)] + 0.6 * rnd.standard_normal((n, dim))
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "label": rnd.integers(0, 2, n).astype("int32"), "embedding": x.tolist()}), SCHEMA)


def recall(got, want):
    both = got.join(want, ["query_id", "vec_id"]).count()
    return both / want.count()


@pytest.mark.parametrize("n", [4_000, 20_000])
def test_recall_and_candidates(spark, n, tmp_path):
    v = clustered(spark, n)
    q = v.where("vec_id % 100 = 0")
    vectors.hash_index(v).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    got, want = vectors.search(q, index, 10), retrieval.knn(q, v, 10)
    assert recall(got, want) >= 0.9
    compared = vectors.candidates(q, index).agg(F.avg("candidates")).first()[0]
    assert compared < 0.75 * n  # of both tables together
    exact = got.join(want.withColumnRenamed("distance", "d"), ["query_id", "vec_id"])
    assert exact.where(F.abs(F.col("d") - F.col("distance")) > 2e-6).count() == 0
    assert got.groupBy("query_id", "vec_id").count().where("count > 1").count() == 0


def test_all_codes_are_the_exact_search(spark):
    v = clustered(spark, 600, dim=12)
    q = v.where("vec_id % 50 = 0")
    for where in (None, ["label"]):
        got = vectors.search(q, vectors.hash_index(v, tables=1, bits=5), 7, where, probes=32, tables=1, bits=5)
        want = retrieval.knn(q, v, 7, where)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect())) == sorted(map(tuple, want.select("query_id", "rank", "vec_id").collect()))
    assert vectors.nearest(q, v, 7, above=10_000).exceptAll(retrieval.knn(q, v, 7)).count() == 0
    assert vectors.nearest(q, v, 7, above=100).groupBy("query_id").count().where("count <> 7").count() == 0


def test_copies_nulls_and_other_dimensions(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(i, 0, one) for i in range(200)] + [(300, 0, None), (301, 0, []), (302, 0, [1.0, 0.0]), (303, 0, [0.0, 0.0, 0.0]), (304, 0, [-1.0, -2.0, -3.0])]
    v = spark.createDataFrame(rows, SCHEMA)
    got = vectors.search(v.where("vec_id in (0, 300, 301, 302)"), vectors.hash_index(v), 5)
    assert [tuple(r) for r in got.select("query_id", "vec_id", "rank").orderBy("rank").collect()] == [(0, i, i) for i in range(1, 6)]
    n = {r.query_id: r.candidates for r in vectors.candidates(v.where("vec_id in (0, 300)"), vectors.hash_index(v)).collect()}
    assert n[0] >= 400 and n[300] == 0
    assert vectors.search(v.limit(0), vectors.hash_index(v), 5).count() == vectors.search(v, vectors.hash_index(v.limit(0)), 5).count() == 0


def plain(votes, k, rounds):
    """Expectation maximisation with all rows at hand."""
    v = np.array(votes)
    acc, prior = [0.7] * v.shape[1], [1 / k] * k
    for _ in range(rounds):
        post = np.zeros((len(v), k))
        for i, row in enumerate(v):
            p = np.array([prior[c] * np.prod([1 if x < 0 else acc[j] if x == c else (1 - acc[j]) / max(1, k - 1) for j, x in enumerate(row)]) for c in range(k)])
            post[i] = p / p.sum()
        acc = [float(np.clip(sum(post[i, row[j]] for i, row in enumerate(v) if row[j] >= 0) / max(1e-9, (v[:, j] >= 0).sum()), 0.05, 0.95)) for j in range(v.shape[1])]
        prior = np.clip(post.mean(axis=0), 1e-3, None)
    return post


def test_label_model(spark):
    rnd = np.random.default_rng(4)
    truth = rnd.integers(0, 3, 400)
    votes = [[-1 if rnd.random() < 0.3 else int(t) if rnd.random() < a else int(rnd.integers(0, 3)) for a in (0.9, 0.7, 0.5, 0.2)] for t in truth]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)] + [(900, None), (901, [])], "doc_id long, votes array<int>")
    got = {r.doc_id: (r.label, r.confidence) for r in rules.label_model(df, 3, 10).collect()}
    post = plain([v for v in votes], 3, 10)
    for i, p in enumerate(post):
        if max(votes[i]) < 0 or np.isclose(p, p.max()).sum() > 1:
            assert i not in got
        else:
            assert got[i][0] == p.argmax() and abs(got[i][1] - p.max()) < 1e-9
    assert 900 not in got and 901 not in got
    assert np.mean([got[i][0] == truth[i] for i in got]) > 0.8
    assert rules.label_model(df.limit(0), 3).count() == 0


def test_label_model_of_very_many_vote_vectors(spark):
    bits = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.pmod(F.floor(F.col("id") / F.pow(F.lit(2), i)), F.lit(2)).cast("int"))
    votes = spark.range(131_072).select("id", bits.alias("votes"))
    got = rules.label_model(votes, 2, 2)
    n = got.count()
    assert 100_000 < n <= 131_072
    ones = F.aggregate("votes", F.lit(0), lambda s, x: s + x)
    assert got.where((ones > 12) & (F.col("label") != 1) | (ones < 5) & (F.col("label") != 0)).count() == 0


def test_votes_of_different_lengths(spark):
    with pytest.raises(ValueError):
        rules.label_model(spark.createDataFrame([([0, 1],), ([0],)], "votes array<int>"), 2)
