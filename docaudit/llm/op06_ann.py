"""Approximate nearest neighbours with sharded robust-pruned directed graphs."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, numbered, table

#: Distinct vectors in a shard; out-degree; beam of searches while building and querying; nodes expanded at once; relaxation.
SHARD, DEGREE, BEAM, WIDTH, ALPHA = 16_000, 32, 80, 4, 1.2


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all rows of q at once: the `beam` nearest nodes found (-1: none), nearest first, and squares."""
    rows, n = np.arange(len(q))[:, None], len(x)
    norm = (x * x).sum(axis=1)
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True  # stands for no node
    ids = np.full((len(q), beam), n)
    dist = np.full((len(q), beam), np.inf)
    done = np.ones((len(q), beam), bool)
    ids[:, 0], done[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = norm[start] - 2 * (q @ x[start])
    while not done.all():
        # the first WIDTH nodes of each beam that are not expanded yet
        turn = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]
        cur = np.where(done[rows, turn], n, ids[rows, turn])
        done[rows, turn] = True
        near = np.where(cur[..., None] < n, graph[np.minimum(cur, n - 1)], n).reshape(len(q), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        fresh = ~seen[rows, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows, near] = True
        safe = np.minimum(near, n - 1)
        d = np.where(fresh, norm[safe] - 2 * np.matmul(x[safe], q[:, :, None])[..., 0], np.inf)
        ids, dist, done = np.concatenate([ids, near], 1), np.concatenate([dist, d], 1), np.concatenate([done, ~fresh], 1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = ids[rows, best], dist[rows, best], done[rows, best]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point, neighbours from its candidates (-1: none): the nearest stays and rules out all candidates that are
    nearer to it, by the factor alpha, than to the point; then the next one, up to `degree`."""
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for a in range(0, len(points), 64):
        p, c = points[a : a + 64], np.sort(cand[a : a + 64], axis=1)
        open_ = (c >= 0) & (c != p[:, None])
        open_[:, 1:] &= c[:, 1:] != c[:, :-1]
        v = x[np.maximum(c, 0)]
        norm = (v * v).sum(axis=2)
        between = np.sqrt(np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0))
        away = np.sqrt(np.maximum(((v - x[p][:, None]) ** 2).sum(axis=2), 0))
        r = rows[: len(p)]
        for k in range(degree):
            d = np.where(open_, away, np.inf)
            best = d.argmin(axis=1)
            has = np.isfinite(d[r, best])
            if not has.any():
                break
            out[a + r[has], k] = c[r, best][has]
            open_ &= ~((alpha * between[r, best] <= away) & has[:, None])
            open_[r, best] = False
    return out


def build_graph(x: np.ndarray, seed: int = 6) -> tuple[np.ndarray, int]:
    """Graph (n x DEGREE, -1: none) and start node (the medoid). Nodes come in random order, in blocks: searched on the graph
    so far, linked to what the pruning keeps of the nodes found, and linked back; lists that grow too long are pruned."""
    n = len(x)
    graph = np.full((n, DEGREE), -1)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    ready, size = 1, 8
    while ready < n:
        new = order[ready : ready + size]
        found, _ = beam_search(x, graph, start, x[new])
        among = np.broadcast_to(new, (len(new), len(new))) if len(new) <= 64 else np.full((len(new), 1), -1)  # the first blocks know each other
        graph[new] = robust_prune(x, new, np.concatenate([found, among], axis=1))
        src = np.repeat(new, DEGREE)
        dst = graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(nodes), DEGREE + int(count.max(initial=0))), -1)
        back[:, :DEGREE] = graph[nodes]
        back[np.repeat(np.arange(len(nodes)), count), DEGREE + np.arange(len(dst)) - np.repeat(first, count)] = src
        many = (back >= 0).sum(axis=1) > DEGREE
        few = ~many
        back = np.take_along_axis(back, np.argsort(back < 0, axis=1, kind="stable"), axis=1)
        graph[nodes[few]] = back[few][:, :DEGREE]
        if many.any():
            graph[nodes[many]] = robust_prune(x, nodes[many], back[many][:, : int((back[many] >= 0).sum(axis=1).max())])
        ready += len(new)
        size = min(256, size * 2)
    return graph, start


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vh, dim, embedding, ids, rows): each distinct vector once, with the `keep` smallest ids that have it, and their rows.

    No result holds more of one vector's ids than that. Sorted partitions give up all but `keep` rows of a vector before
    any shuffle by vector, so a vector that many rows share stays small. Vectors of one hash are told apart by themselves."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = None, 0
        for batch in batches:
            take = np.zeros(len(batch), bool)
            for i, v in enumerate(batch["embedding"]):
                v = v.tobytes()
                n = n + 1 if v == last else 1
                last = v
                take[i] = n <= keep
            yield batch[take]

    order = ["vh", "embedding", "vec_id", "row"]
    rows = rows.repartitionByRange("vh", "vec_id").sortWithinPartitions(*order).mapInPandas(heads, rows.schema)
    rank = F.row_number().over(Window.partitionBy("vh", "embedding").orderBy("vec_id", "row"))
    rows = rows.withColumn("r", rank).where(F.col("r") <= keep)
    held = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    rows = rows.groupBy("vh", "dim", "embedding").agg(held.alias("held"))
    return rows.select("vh", "dim", "embedding", F.transform("held", lambda x: x["vec_id"]).alias("ids"), F.transform("held", lambda x: x["row"]).alias("rows"))


def valid(vectors: DataFrame, row: str) -> DataFrame:
    """(vec_id, row, embedding, dim, vh) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    rows = rows.select("vec_id", F.col(row).alias("row"), F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("embedding"))  # -0 becomes 0
    return rows.withColumn("dim", F.size("embedding")).withColumn("vh", F.xxhash64("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, row: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, by Euclidean distance.

    Distinct vectors are dealt by hash into shards of about `shard`; each shard builds its graph in one task (bounded by the
    shard), is written with it, and is searched by every block of queries; each search gives k rows at most. The larger the
    shards, the less of them a query looks at, the longer they take to build, and the wider a beam has to be.
    row: a long column of both tables by which a query's own row is known: candidates with the query's value are its own.
    Rows of one vec_id are all candidates, and all queries, each with its own list.
    Vectors null, zero or with null or non-finite components, and null ids, take no part; a vector is compared with those of its
    dimension; ties go to the smaller vec_id. Empty table: empty. Other columns: ignored."""
    rows = cut(distinct_vectors(valid(vectors, row), k + 1))
    shards = max(1, -(-rows.count() // shard))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["embedding"].tolist()).astype(float)
        graph, start = build_graph(x)
        whole = lambda c: np.concatenate([np.asarray(i, np.int64) for i in part[c]]).tobytes()
        copies = np.array([len(i) for i in part["ids"]], np.int64).tobytes()
        return pd.DataFrame([[int(part["shard"].iloc[0]), x.shape[1], len(x), start, x.tobytes(), graph.astype(np.int32).tobytes(), copies, whole("ids"), whole("rows")]], columns=["shard", "dim", "n", "start", "x", "graph", "copies", "ids", "rows"])

    index = rows.withColumn("shard", F.pmod("vh", F.lit(shards)).cast("int")).groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, n int, start int, x binary, graph binary, copies binary, ids binary, rows binary")
    index = cut(index)
    asked = valid(queries, row).select("vec_id", "row", "dim", "embedding", F.monotonically_increasing_id().alias("key"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                for i in range(0, len(part), 256):
                    p = part.iloc[i : i + 256]
                    yield pd.DataFrame({"dim": [dim], **{f"q_{c}": [p[c].to_numpy(np.int64).tobytes()] for c in ("vec_id", "row", "key")}, "q": [np.stack(p["embedding"].tolist()).astype(float).tobytes()]})

    asked = cut(asked.mapInPandas(blocks, "dim int, q_vec_id binary, q_row binary, q_key binary, q binary")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                x = np.frombuffer(row.x).reshape(row.n, row.dim)
                graph = np.frombuffer(row.graph, np.int32).reshape(row.n, -1)
                copies, ids, own, qids, qrow, key = (np.frombuffer(b, np.int64) for b in (row.copies, row.ids, row.rows, row.q_vec_id, row.q_row, row.q_key))
                first = np.cumsum(copies) - copies
                q = np.frombuffer(row.q).reshape(-1, row.dim)
                found, _ = beam_search(x, graph, row.start, q)
                for i, f in enumerate(found):
                    f = f[f >= 0]
                    d = np.sqrt(((x[f] - q[i]) ** 2).sum(axis=1))
                    n = copies[f]
                    at = np.repeat(first[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    d = np.repeat(d, n)
                    near, d = ids[at][own[at] != qrow[i]], d[own[at] != qrow[i]]
                    best = np.lexsort((near, d))[:k]
                    out.append(pd.DataFrame({"key": key[i], "query_id": qids[i], "vec_id": near[best], "score": d[best]}))
            yield pd.concat(out) if out else pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []})

    hits = index.join(asked, ["shard", "dim"]).mapInPandas(search, "key long, query_id long, vec_id long, score double")
    best = Window.partitionBy("key").orderBy("score", "vec_id")  # k rows a shard
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = numbered(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), row="_row")


QUERIES = {"op6_pruned_graph_search": op6_pruned_graph_search}
