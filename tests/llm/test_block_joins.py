"""Joins of blocks of vectors: no table on its way through the driver, whatever Spark takes its size for."""

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from docaudit.llm import op05_topk, op12_negatives  # noqa: E402


def plans(spark, run):
    """What run returns, and the final plans of all jobs in it."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    return out, [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]


@pytest.mark.parametrize("query, module", [("op5_top_inner_products", op05_topk), ("op12_hard_negatives", op12_negatives)])
def test_nothing_is_broadcast(spark, tmp_path, query, module):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=4 if i % 9 else 3)], int(rng.integers(0, 3))) for i in range(600)]
    rows += [(600 + i, [1.0] * 4, 1) for i in range(201)]  # as small as a table can be stored, and ties
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, found = plans(spark, lambda: module.QUERIES[query](spark, str(tmp_path)).collect())
    assert len(found) > 3 and any("SortMergeJoin" in p for p in found)
    assert not [p for p in found if "BroadcastExchange" in p]
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert sorted(map(tuple, got)) == sorted(c.execute(module.ORACLES[query]).fetchall())


def test_groups_of_blocks_are_even(spark, monkeypatch):
    """Candidates of one file are dealt over as many tasks as may work, and every one meets every query once."""
    monkeypatch.setattr(op05_topk, "BLOCK", 16)
    rows = [(i, [float(i % 7), 1.0], i) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row long").coalesce(1)
    of = op05_topk.quantised(df)
    cand = op05_topk._packed(op05_topk.dealt(of, 800), ["vec_id", "row"])
    cand = op05_topk.cut(cand.selectExpr("dim", "n as c_n", "spark_partition_id() as g"))
    sizes = [r[0] for r in cand.groupBy("g").sum("c_n").select("sum(c_n)").collect()]
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= 1
    packed = op05_topk._packed(of.where("vec_id % 50 = 0"), ["vec_id"]).selectExpr("dim", "n as q_n")
    met = op05_topk.meeting(cand, packed)
    assert met.selectExpr("sum(c_n * q_n)").first()[0] == 800 * 16
