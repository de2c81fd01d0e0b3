"""Hybrid retrieval and its blocks: what moves, and results whatever the blocks are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.operators import postings, retrieval


def _tables(spark, n=240):
    words = [f"w{i}" for i in range(40)]
    text = lambda i: " ".join(words[(i * k) % 40] for k in range(1, 3 + i % 9))
    x = np.random.default_rng(3).standard_normal((n, 8)).round(3)
    rows = [(i, [9, 10, None][i % 3], ["ai", "gdpr"][i % 4 == 0], "en", text(i), x[i].tolist()) for i in range(n)]
    passages = spark.createDataFrame(rows, "doc_id long, article int, regulation string, lang string, text string, embedding array<double>")
    chunks = passages.where("doc_id % 10 = 0").withColumn("query_id", F.col("doc_id"))
    applicable = passages.select("doc_id", F.array(F.lit(9), F.lit(10)).alias("articles"))
    return chunks, passages, applicable


def test_hybrid_reads_texts_once_and_from_all_tasks(spark, tmp_path):
    chunks, passages, applicable = _tables(spark)
    path = str(tmp_path / "passages")
    passages.coalesce(1).write.parquet(path)
    out = retrieval.hybrid_retrieve(chunks, spark.read.parquet(path), applicable, regulation="ai")
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    assert {x.nodeName() for x in leaves} == {"InMemoryRelation"}  # no second scan
    assert any("REPARTITION_BY_NUM" in x.treeString() and "embedding" in x.treeString() for x in leaves)  # dealt before they are held
    assert out.groupBy("query_id").count().where("count > 5").count() == 0 and out.count() > 20


def test_knn_spreads_one_filter_value_over_tasks(spark):
    _, passages, _ = _tables(spark, 600)
    v = passages.select(F.col("doc_id").alias("vec_id"), "embedding").repartition(12, "vec_id")
    q = v.where("vec_id % 50 = 0")
    one, dealt = (retrieval.best_hits(retrieval.block_hits(q, v, 5, salts=s), 5) for s in (1, 7))
    assert one.count() == 60 and one.exceptAll(dealt).count() == 0
    assert "salt" in retrieval.knn(q, v, 5)._jdf.queryExecution().optimizedPlan().toString()


def test_nan_vectors_hide_no_others(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [float("nan"), 1.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert [(r.query_id, r.vec_id) for r in retrieval.knn(v.where("vec_id = 0"), v, 2).collect()] == [(0, 1)]


@pytest.mark.parametrize("rare", [0.0, 1 / 64, 2.0])
def test_sums_of_frequent_and_rare_words_agree(rare, monkeypatch):
    monkeypatch.setattr(postings, "RARE", rare)
    monkeypatch.setattr(postings, "PRODUCTS", 50)
    r = np.random.default_rng(1)
    has, asked = r.random((30, 20)) < r.random(20), r.random((20, 9)) < 0.3
    x, w = r.random((30, 20)) * has, r.random((20, 9)) * asked
    (doc, place), (q_at, q_of) = np.nonzero(has), np.nonzero(asked)
    got = postings._sums((30, 9), doc, place, x[has], q_of, q_at, w[asked])
    assert np.allclose(got, x @ w, atol=1e-12)
    none = np.array([], int)
    assert postings._sums((3, 9), none, none, none.astype(float), q_of, q_at, w[asked]).shape == (3, 9)


@pytest.mark.parametrize("held", [0, 7, 1 << 18])
def test_a_task_keeps_the_best_of_its_blocks(spark, held, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 5)
    chunks, passages, _ = _tables(spark)
    p, q = passages.select("doc_id", "article", "text").coalesce(1), chunks.select("query_id", "article", "text")
    want = {tuple(r) for r in postings.bm25_search(q, p, ["article"], 4, whole=True).collect()}
    monkeypatch.setattr(postings, "HELD", held)
    sizes, terms = postings.statistics(p, ["article"], True)
    rows = postings.weights(postings.asked(q, ["article"]), terms, sizes, 2.5, False)
    hits = postings._hits(postings.counted(p, ["article"], True), rows, 4, 1.5, 0.75)
    assert {tuple(r) for r in postings.best(hits, 4).collect()} == want
    if held > 7:
        assert hits.count() <= 24 * 4  # one task, however many blocks


def test_one_partition_makes_no_product_of_tables(spark):
    chunks, passages, _ = _tables(spark)
    out = postings.bm25_search(chunks.select("query_id", "text"), passages.select("doc_id", "text"), [], 4)
    sizes, terms = postings.statistics(passages, [])
    rows = postings.weights(postings.asked(chunks.select("query_id", "text"), []), terms, sizes, 2.5, False)
    for df in (out, rows):
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
