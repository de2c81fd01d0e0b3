"""Exact top-k by distributed histogram selection."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, numbered, table

BINS = 512
BLOCK = 4096
#: Queries of a block that are scored at once.
SLICE = 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows of vectors that take part, with v array<long>: floor(scale * x) of each component x."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    whole = lambda c: F.floor(c.cast("double") * scale)
    return rows.withColumn("v", F.transform("embedding", whole)).drop("embedding")


def _packed(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows as blocks of at most BLOCK vectors of one dimension: binary columns of vectors and of extra longs."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                for i in range(0, len(part), BLOCK):
                    p = part.iloc[i : i + BLOCK]
                    m = np.concatenate(p["v"].tolist()).astype(np.int64) if dim else np.zeros(0, np.int64)
                    yield pd.DataFrame({"dim": [dim], "n": [len(p)], "m": [m.tobytes()], **{c: [p[c].to_numpy(np.int64).tobytes()] for c in extra}})

    return rows.mapInPandas(pack, "dim int, n int, m binary" + "".join(f", {c} binary" for c in extra))


def _matrix(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(n, -1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles (BLAS) while every sum is exact in them, else in 64-bit integers while they
    hold every sum, else, for the rows that need it, in Python's integers. A product beyond a long counts as the largest or
    smallest long."""
    most = lambda m: np.maximum(m.max(axis=1, initial=0).astype(float), -m.min(axis=1, initial=0).astype(float))
    a, b = most(q), most(c)
    bound = a.max(initial=0) * b.max(initial=0) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return q @ c.T
    out = np.empty((len(q), len(c)), np.int64)
    big_q, big_c = a >= 2**30 / q.shape[1], b >= 2**30 / q.shape[1]
    out[np.ix_(~big_q, ~big_c)] = q[~big_q] @ c[~big_c].T
    for x, y in ((big_q, np.ones(len(c), bool)), (~big_q, big_c)):
        if x.any() and y.any():
            exact = q[x].astype(object) @ c[y].astype(object).T
            out[np.ix_(x, y)] = np.minimum(np.maximum(exact, LEAST), MOST).astype(np.int64)
    return out


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The n rows dealt evenly over the tasks that meeting gives its groups to: not more than there are blocks of them."""
    return rows.repartition(min(max(1, -(-n // BLOCK)), 4 * rows.sparkSession.sparkContext.defaultParallelism))


def meeting(cand: DataFrame, packed: DataFrame) -> DataFrame:
    """Every block of queries with every block of candidates of its dimension; a task for each group (g) of candidate blocks.

    Both sides are shuffled by group and merged. Left to itself, Spark would see a few small rows in the blocks of queries,
    and broadcast them through the driver, where they are copies for all groups."""
    groups = cand.agg(F.max("g")).first()[0]
    groups = 1 if groups is None else groups + 1
    packed = packed.withColumnRenamed("dim", "q_dim").withColumn("q_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = cand.repartitionById(groups, F.col("g")).join(packed.repartitionById(groups, F.col("q_g")).hint("merge"), F.col("g") == F.col("q_g"))
    return met.where("dim - q_dim = 0")  # after the join: as a key of it, it would have both sides shuffled again


def _pairs(row) -> Iterator[tuple[slice, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """For each slice of the queries of a pair of blocks: scores of all candidates, and the places of queries' own rows in
    them, whose scores are LEAST."""
    qrow, crow = (np.frombuffer(x, np.int64) for x in (row.q_row, row.c_row))
    q, c = _matrix(row.q_n, row.q_m), _matrix(row.c_n, row.c_m)
    for a in range(0, len(qrow), SLICE):
        part = slice(a, a + SLICE)
        scores = _scores(q[part], c)
        here = np.flatnonzero(np.isin(qrow[part], crow))
        i, j = np.nonzero(qrow[part][here][:, None] == crow)
        own = here[i], j
        scores[own] = LEAST
        yield part, scores, own


def _improved(best: np.ndarray, scores: np.ndarray) -> None:
    """best: each row's largest scores so far, the least of them first. Takes those of scores in."""
    more = np.flatnonzero((scores > best[:, :1]).any(axis=1))
    if len(more):
        k = best.shape[1]
        best[more] = np.sort(np.partition(np.hstack([best[more], scores[more]]), -k, axis=1)[:, -k:], axis=1)


def _above(s: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """s - lo without overflow, for s >= lo."""
    return s.astype(np.uint64) - lo.astype(np.uint64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, row: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner product for each query row; ties to the
    smaller vec_id.

    Every round scores all candidate blocks against all query blocks and adds up, per query, a histogram of the scores in
    the interval that still holds the k-th value; the interval shrinks by BINS a round until it is one value. The last
    pass keeps the scores above it and, from each block, the k smallest ids at it. All tables are joined by shuffles.
    row: a long column of both tables by which a query's own row is known: candidates with the query's value are its own.
    Rows of one vec_id are all candidates, and all queries, each with its own list.
    Vectors null or with null or non-finite components, and null ids, take no part; vectors are compared within their
    dimension; fewer than k candidates: all. Components and scores beyond a long count as the largest or smallest long.
    Empty table: empty. Other columns: ignored."""
    spark = vectors.sparkSession
    of = lambda df: quantised(df.select("vec_id", "embedding", F.col(row).alias("row")), scale)
    cand = cut(_packed(dealt(of(vectors), vectors.count()), ["vec_id", "row"]).withColumn("g", F.spark_partition_id()))
    cand = cand.select([F.col(c).alias(f"c_{c}" if c not in ("dim", "g") else c) for c in cand.columns])
    q = cut(of(queries).withColumn("key", F.monotonically_increasing_id()))
    n_queries = q.count()
    # Cauchy-Schwarz bounds every score; one number for all candidates
    largest = cand.mapInPandas(lambda it: (pd.DataFrame({"x": [float(np.sqrt((_matrix(n, m).astype(float) ** 2).sum(axis=1).max(initial=0))) for n, m in zip(b["c_n"], b["c_m"])]}) for b in it), "x double").agg(F.max("x")).first()[0] or 0.0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bound = F.ceil(norm * F.lit(largest) * F.lit(1 + 1e-9) + 1)  # saturates at the largest long
    state = q.select("key", (-bound - F.when(bound == MOST, 1).otherwise(0)).alias("lo"), bound.alias("hi"), F.lit(k).cast("long").alias("need"))  # the k-th value is in lo..hi

    def blocks(state: DataFrame) -> DataFrame:
        packed = _packed(q.join(state.hint("merge"), "key").repartition(max(1, -(-n_queries // 1024))), ["vec_id", "row", "key", "lo", "hi", "need"])
        return meeting(cand, packed.select([F.col(c).alias(f"q_{c}" if c != "dim" else c) for c in packed.columns]))

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}  # by a block's first key
        for batch in batches:
            out = []
            for row in batch.itertuples():
                los, his, keys = (np.frombuffer(x, np.int64) for x in (row.q_lo, row.q_hi, row.q_key))
                tops = best.setdefault(int(keys[0]), np.full((len(keys), k), LEAST))
                for part, s, own in _pairs(row):
                    lo, hi = los[part], his[part]
                    width = _above(hi, lo) // np.uint64(BINS) + np.uint64(1)
                    # bins below the one that holds this task's own k-th score so far can't hold the global one
                    _improved(tops[part], s)
                    least = np.maximum(tops[part, 0], lo)
                    least -= (_above(least, lo) % width).astype(np.int64)
                    wanted = (s >= least[:, None]) & (s <= hi[:, None])
                    wanted[own] = False
                    at, to = np.nonzero(wanted)
                    bins = _above(s[at, to], lo[at]) // width[at]
                    found, counts = np.unique(at * BINS + bins.astype(np.int64), return_counts=True)
                    out.append(pd.DataFrame({"key": keys[part][found // BINS], "bin": found % BINS, "n": counts}))
            yield pd.concat(out) if out else pd.DataFrame({"key": [], "bin": [], "n": []})

    state = cut(state)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    while state.where("hi > lo").limit(1).count():
        found = blocks(state).mapInPandas(histograms, "key long, bin long, n long").groupBy("key", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("key").orderBy(F.desc("bin"))  # at most BINS rows a query
        found = found.withColumn("upto", F.sum("n").over(down)).withColumn("from", F.col("upto") - F.col("n"))
        spans = state.withColumn("width", F.expr(f"(cast(hi as decimal(20,0)) - cast(lo as decimal(20,0))) div {BINS} + 1"))
        hit = found.join(spans.hint("merge"), "key").where((F.col("from") < F.col("need")) & (F.col("upto") >= F.col("need")))
        low = wide("lo") + wide("bin") * wide("width")
        hit = hit.select("key", low.cast("long").alias("new_lo"), F.least(wide("hi"), low + wide("width") - 1).cast("long").alias("new_hi"), (F.col("need") - F.col("from")).alias("left"))
        # a query with fewer candidates than k takes all: its interval becomes the lowest value
        now = state.join(hit.hint("merge"), "key", "left").select("key", F.coalesce("new_lo", "lo").alias("lo"), F.coalesce("new_hi", "lo").alias("hi"), F.coalesce("left", "need").alias("need"))
        before, state = state, cut(now)
        discard(before)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                values, qids, keys, ids = (np.frombuffer(x, np.int64) for x in (row.q_lo, row.q_vec_id, row.q_key, row.c_vec_id))
                for part, s, own in _pairs(row):
                    value = values[part, None]
                    level = s == value
                    level[own] = False
                    at, to = np.nonzero(s > value)
                    i, j = np.nonzero(level)
                    order = np.lexsort((ids[j], i))
                    i, j = i[order], j[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < k
                    at, to = np.concatenate([at, i[first]]), np.concatenate([to, j[first]])
                    out.append(pd.DataFrame({"key": keys[part][at], "query_id": qids[part][at], "vec_id": ids[to], "score": s[at, to]}))
            yield pd.concat(out) if out else pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []})

    hits = blocks(state).mapInPandas(chosen, "key long, query_id long, vec_id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")  # fewer than k above, k per block at the value
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = numbered(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), row="_row")


QUERIES = {"op5_top_inner_products": op5_top_inner_products}
ORACLES = {
    "op5_top_inner_products": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
