"""Text classifiers: texts are read once, and counts held in their place give the same model."""

from docaudit.operators import classify
from docaudit.plans import catalog

DIR = "/root/testdata/sf0.001"


def _leaves(df):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return {leaves.apply(i).nodeName() for i in range(leaves.size())}


def test_queries_read_texts_once(spark):
    for name in ("chunk_classifier", "document_classifier"):
        assert _leaves(catalog.QUERIES[name](spark, DIR)) == {"InMemoryRelation"}


def test_held_counts_give_the_same_predictions(spark):
    rows = spark.createDataFrame([(i, None if i % 17 == 0 else "" if i % 13 == 0 else f"alpha BETA{i % 5} 'x" if i % 2 else f"gamma, delta {i % 7}", None if i % 19 == 0 else "a" if i % 2 else "g") for i in range(120)], "doc_id long, text string, truth string").repartition(2, "doc_id")
    plain = classify.predict(rows, classify.train(rows.where("doc_id < 90"), "truth"), least=0.6).drop("text")
    held = classify.hashed(rows).drop("text").persist()
    counted = classify.predict(held, classify.train(held.where("doc_id < 90"), "truth"), least=0.6)
    assert counted.columns == plain.columns == ["doc_id", "truth", "label", "confidence", "backend"]
    assert [(r[0], r[2], round(r[3], 9)) for r in counted.orderBy("doc_id").collect()] == [(r[0], r[2], round(r[3], 9)) for r in plain.orderBy("doc_id").collect()]
    assert {r.label for r in counted.where("doc_id in (13, 17, 34)").collect()} == {"unrelated"}
    held.unpersist()


def test_training_leaves_nothing_held(spark):
    rows = spark.createDataFrame([(i, f"alpha {i}" if i % 2 else f"gamma {i}", "a" if i % 2 else "g") for i in range(40)], "doc_id long, text string, truth string")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    classify.train(rows, "truth")
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before
