"""Connected components of an edge table, by alternating stars."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task joins the edges that it reads into stars, which shortens paths before any shuffle."""

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                top = x
                while root.get(top, top) != top:
                    top = root[top]
                while root.get(x, x) != top:
                    root[x], x = top, root[x]
                return top

            batch = batch.drop_duplicates()
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                a, b = find(a), find(b)
                root[max(a, b)] = root[min(a, b)] = min(a, b)
            nodes = list(root)
            yield pd.DataFrame({"a": np.array(nodes, np.int64), "b": np.array([find(x) for x in nodes], np.int64)}).query("a != b")

    return edges.mapInPandas(stars, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes of edges (a, b). Rows: one a node.

    Large and small stars alternate until the edges no longer change; every step is a grouped minimum and a join."""
    edges = cut(_contracted(edges.select("a", "b")), narrow=True)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down, before = cut(down, narrow=True), edges
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b")))
        edges = cut(_contracted(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(2 * small.sparkSession.sparkContext.defaultParallelism)), narrow=True)
        discard(down, before)
        now = edges.distinct().agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    edges = edges.distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
