"""Hard negatives by segment summaries: means and deviations bound inner products before any is computed."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, numbered, table
from .op05_topk import BLOCK, SLICE, _scores, dealt, meeting, quantised

#: Each level of the summaries has so many times the segments of the one before, down to segments of LEAST components.
FINER, LEAST = 4, 4
#: Anchors of one block.
ANCHORS = 1024
#: Exact scores are computed without another level once so few candidates are left for each result.
ENOUGH = 4


def levels(dim: int) -> list[int]:
    """Segments at each level."""
    out = [1]
    while dim // (out[-1] * FINER) >= LEAST:
        out.append(out[-1] * FINER)
    return out


def summaries(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector's segments: the mean, times the root of the segment's length, and the deviation (norm of what is left).

    For two vectors, the products of their means add up to the inner product but for the products of what is left, each of
    which is at most the product of the deviations."""
    x = m.astype(np.float64)
    if not x.shape[1]:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    starts = np.arange(segments) * x.shape[1] // segments
    size = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def _packed(rows: DataFrame, extra: list[str], block: int, lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows in blocks of one dimension: vectors, summaries of all levels (means then deviations, a level after the other), and
    extra longs; lists: columns with an array of longs for each row, as many a row as `n_<column>` says."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                for i in range(0, len(part), block):
                    p = part.iloc[i : i + block]
                    m = np.concatenate(p["v"].tolist()).astype(np.int64).reshape(len(p), dim)
                    out = {"dim": [dim], "n": [len(p)], "m": [m.tobytes()], "s": [b"".join(x.tobytes() for k in levels(dim) for x in summaries(m, k))]}
                    out |= {c: [p[c].to_numpy(np.int64).tobytes()] for c in extra}
                    for c in lists:
                        out |= {f"n_{c}": [p[c].map(len).to_numpy(np.int64).tobytes()], c: [np.concatenate([np.asarray(x, np.int64) for x in p[c]]).tobytes()]}
                    yield pd.DataFrame(out)

    names = [*extra, *(x for c in lists for x in (f"n_{c}", c))]
    return rows.mapInPandas(pack, "dim int, n int, m binary, s binary" + "".join(f", {c} binary" for c in names))


class Side:
    """One block: vectors, summaries of each level, and columns."""

    def __init__(self, row, side: str, columns: list[str]):
        n, dim = getattr(row, f"{side}_n"), row.dim
        self.m = np.frombuffer(getattr(row, f"{side}_m"), np.int64).reshape(n, dim)
        flat, self.levels, at = np.frombuffer(getattr(row, f"{side}_s"), np.float64), [], 0
        for k in levels(dim):
            mean, dev = flat[at : at + n * k], flat[at + n * k : at + 2 * n * k]
            self.levels.append((mean.reshape(n, k), dev.reshape(n, k)))
            at += 2 * n * k
        self.norm = np.sqrt(sum((x * x).sum(axis=1) for x in self.levels[0]))
        self.products: tuple[Side | None, int, dict[int, np.ndarray]] = None, 0, {}
        for c in columns:
            setattr(self, c, np.frombuffer(getattr(row, f"{side}_{c}"), np.int64))


def _products(times: Callable[[np.ndarray, np.ndarray], np.ndarray], q: Side, i: int, x: np.ndarray, c: Side, y: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of row i of q's matrix x and rows `alive` of c's matrix y. If most of c's rows are alive, from a product of matrices for
    a slice of q's rows, which c keeps until the next slice."""
    if 2 * len(alive) <= len(y):
        return times(x[i : i + 1], y[alive])[0]
    a = i - i % SLICE
    if c.products[0] is not q or c.products[1] != a:
        c.products = q, a, {}
    kept = c.products[2]
    if id(y) not in kept:
        kept[id(y)] = times(x[a : a + SLICE], y)
    return kept[id(y)][i - a, alive]


#: Told lower and upper bounds of scores, which candidates may still be wanted.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def exact_after_bounds(q: Side, i: int, c: Side, alive: np.ndarray, wanted: Wanted, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in block c, and exact scores with q's row i, of the candidates of `alive` that wanted doesn't rule out at any level."""
    for (mean, dev), (own_mean, own_dev) in zip(c.levels, q.levels):
        if len(alive) <= enough:
            break
        middle, reach = (_products(_times, q, i, x, c, y, alive) for x, y in ((own_mean, mean), (own_dev, dev)))
        reach = reach + 1e-9 * q.norm[i] * c.norm[alive] + 1e-6  # the bounds are doubles
        alive = alive[wanted(middle - reach, middle + reach)]
    return alive, _products(_scores, q, i, q.m, c, c.m, alive)


def _kth(x: np.ndarray, k: int) -> float:
    """The k-th largest; minus infinity if there are fewer."""
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -s.astype(object) if len(s) and s.min() == -(1 << 63) else -s))[:k]


class Best:
    """Of each of n lists, the k candidates seen so far that are first: higher scores before lower, ties by smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.n, self.ids, self.s = k, np.zeros(n, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def least(self, i: int) -> float:
        """No candidate of a lower score comes into list i any more."""
        full = self.k and self.n[i] == self.k and self.s[i, -1] > -(1 << 63)
        return int(self.s[i, -1]) if full else -np.inf

    def take(self, i: int, ids: np.ndarray, s: np.ndarray) -> None:
        if len(ids):
            ids, s = np.concatenate([self.ids[i, : self.n[i]], ids]), np.concatenate([self.s[i, : self.n[i]], s])
            best = _best(ids, s, self.k)
            self.n[i] = len(best)
            self.ids[i, : len(best)], self.s[i, : len(best)] = ids[best], s[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, ids and scores."""
        i, j = np.nonzero(np.arange(self.k) < self.n[:, None])
        return i, self.ids[i, j], self.s[i, j]


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, row: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    `positives` other rows of the same label, the first `negatives` rows of other labels whose score is from least to most per
    cent of the positive's. Scores are integer inner products of floor(scale * x); higher first, ties by smaller vec_id.

    Every vector is stored with the means and deviations of its segments, at levels of more and more segments. Blocks of
    anchors meet blocks of candidates by shuffles; in a task, the summaries' products give each score a lower and an upper bound,
    and a candidate that no result can hold, or that comes behind the task's own so far, goes before the next, finer level; only
    what is left is scored exactly. Each task sends at most `positives` (or `negatives` a positive) candidates of an anchor on,
    whatever repeats.
    row: a long column of both tables by which an anchor's own row is known. Rows of one vec_id are candidates and anchors each
    for itself. Null label, null vec_id, null vectors or components that are null or not finite: no part. Vectors are compared
    within their dimension. A positive with a negative score has no negatives, as no score is from 80 to 100 per cent of it.
    Components and scores beyond a long count as the largest or smallest long. Empty table: empty. Other columns: ignored."""

    def of(df: DataFrame) -> DataFrame:
        return quantised(df.where("label is not null").select("vec_id", "embedding", F.col("label").cast("long").alias("label"), F.col(row).alias("row")), scale)

    cand = cut(_packed(dealt(of(vectors), vectors.count()), ["vec_id", "row", "label"], BLOCK).withColumn("g", F.spark_partition_id()))
    cand = cand.select([F.col(c).alias(f"c_{c}" if c not in ("dim", "g") else c) for c in cand.columns])
    q = cut(of(anchors).withColumn("key", F.monotonically_increasing_id()))
    blocks = max(1, -(-q.count() // ANCHORS))

    def pairs(rows: DataFrame, extra: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
        """Every block of anchors with every block of candidates."""
        packed = _packed(rows.repartition(blocks), ["vec_id", "row", "label", "key", *extra], ANCHORS, lists)
        return meeting(cand, packed.select([F.col(c).alias(f"q_{c}" if c != "dim" else c) for c in packed.columns]))

    def sides(batch: pd.DataFrame, *more: str) -> Iterator[tuple[Side, Side]]:
        for r in batch.itertuples():
            yield Side(r, "q", ["vec_id", "row", "label", "key", *more]), Side(r, "c", ["vec_id", "row", "label"])

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, Best]] = {}  # by a block's first key
        for batch in batches:
            for a, c in sides(batch):
                _, best = found.setdefault(int(a.key[0]), (a.key, Best(len(a.key), positives)))
                for i in range(len(a.key)):
                    alive = np.flatnonzero((c.label == a.label[i]) & (c.row != a.row[i]))
                    least = best.least(i)
                    alive, s = exact_after_bounds(a, i, c, alive, lambda low, high, least=least: high >= max(least, _kth(low, positives)), ENOUGH * positives)
                    best.take(i, c.vec_id[alive][s >= least], s[s >= least])
        for key, best in found.values():
            i, ids, s = best.rows()
            yield pd.DataFrame({"key": key[i], "vec_id": ids, "score": s})

    first = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    near = pairs(q, []).mapInPandas(same, "key long, vec_id long, score long").withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    near = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("x"))  # at most `positives`
    near = cut(q.join(near.select("key", F.col("x.vec_id").alias("p_id"), F.col("x.score").alias("p_score")).hint("merge"), "key"))

    def other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        found: dict[int, tuple[list[np.ndarray], Best]] = {}  # by a block's first key; a list for each positive
        for batch in batches:
            for a, c in sides(batch, "n_p_id", "p_id", "p_score"):
                begin = np.cumsum(a.n_p_id) - a.n_p_id
                if int(a.key[0]) not in found:
                    own = np.repeat(np.arange(len(a.key)), a.n_p_id)
                    found[int(a.key[0])] = [a.key[own], np.arange(len(own)) - begin[own], a.vec_id[own], a.p_id, a.p_score], Best(len(own), negatives)
                _, best = found[int(a.key[0])]
                for i in range(len(a.key)):
                    spans = [(at, -(-least * p // 100), most * p // 100) for at, p in enumerate(a.p_score[begin[i] : begin[i] + a.n_p_id[i]].tolist(), begin[i])]
                    spans = [(at, max(x, best.least(at)), y) for at, x, y in spans if x <= y]
                    if not spans:
                        continue

                    def wanted(low: np.ndarray, high: np.ndarray, spans: list[tuple[int, float, int]] = spans) -> np.ndarray:
                        keep = np.zeros(len(low), bool)
                        for _, x, y in spans:
                            keep |= (high >= x) & (low <= y) & (high >= _kth(low[(low >= x) & (high <= y)], negatives))
                        return keep

                    alive = np.flatnonzero(c.label != a.label[i])
                    alive, s = exact_after_bounds(a, i, c, alive, wanted, ENOUGH * negatives)
                    for at, x, y in spans:
                        fit = np.flatnonzero((s >= x) & (s <= y))
                        best.take(at, c.vec_id[alive[fit]], s[fit])
        for columns, best in found.values():
            i, ids, s = best.rows()
            yield pd.DataFrame(dict(zip(names, (*(x[i] for x in columns), ids, s))))

    found = pairs(near, [], ("p_id", "p_score")).mapInPandas(other, "key long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    discard(q)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = numbered(table(spark, sf_dir, "embeddings").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0), row="_row")


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r AND len(a.v) = len(c.v)),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
}
