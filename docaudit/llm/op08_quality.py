"""Quality selection by importance resampling with hashed n-gram models."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, in_order, mix, mix_int, table
from .words import encoded, ngrams, token_hashes

BUCKETS = 1 << 14
#: The most labelled rows that the target model and the cut are fitted on.
MAX_LABELLED = 200_000
SMOOTHING = 1.0
#: What the loss of a good labelled row weighs against the keeping of a bad one.
GOOD_WEIGHT = 3.0
#: A document's importance weight is that of so many n-grams of its mean log ratio, whatever its length. Noise of a standard
#: deviation of 1.28 thus counts as much as 0.1 of a mean log ratio: it decides near the cut, and leaves clear cases alone.
EVIDENCE = 12.0
SEED = 8


def features(texts: list[bytes]):
    """For each text, the buckets of its words and punctuation runs, of pairs of neighbours, and one for each word that
    repeats the word before it, whichever that is."""
    for tokens in token_hashes(texts, punct=True, folded=False):
        repeats = np.full(int((tokens[1:] == tokens[:-1]).sum()), BUCKETS - 1)
        yield np.concatenate([(np.concatenate([tokens, ngrams(tokens, 2)]) % np.uint64(BUCKETS - 1)).astype(np.int64), repeats])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of every bucket over all texts, one share for each document's n-grams up to its own number of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS)
        for batch in batches:
            for found in features(encoded(batch.column("text"))):
                total += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "n": total.astype(np.int64)})

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket: log of its smoothed probability under the target model, less that under the raw model."""
    p = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
    return p(target) - p(raw)


def noise(ids: np.ndarray, texts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gumbel noise that the seed, the document's id and its text (64-bit hash) fix, and the hash it comes from."""
    tie = mix(mix(ids + np.uint64(mix_int(seed))) + texts)
    return -np.log(-np.log((tie >> np.uint64(12)).astype(float) / 2**52 + 2.0**-53)), tie


def scored(docs: DataFrame, ratio: np.ndarray, evidence: float, seed: int) -> DataFrame:
    """docs with n_grams, log_weight (mean log ratio of its n-grams), gumbel_key (evidence * log_weight plus noise) and tie
    (the noise's hash). Texts without n-grams weigh 0."""
    docs = docs.drop("n_grams", "log_weight", "gumbel_key", "tie")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            found = [(len(f), float(ratio[f].mean()) if len(f) else 0.0) for f in features(texts)]
            n, w = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], float)
            ids = np.array([(x or 0) & (2**64 - 1) for x in batch.column("doc_id").to_pylist()], np.uint64)
            gumbel, tie = noise(ids, np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64), seed)
            columns = {"n_grams": n, "log_weight": w, "gumbel_key": evidence * w + gumbel, "tie": tie.view(np.int64)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], [*batch.schema.names, *columns])

    more = [T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType()), T.StructField("tie", T.LongType())]
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *more]))


def best_cut(weights: DataFrame, bins: int = 2000) -> float:
    """The log weight that parts good from bad labelled rows with the least loss, by shares; a good row lost counts GOOD_WEIGHT times."""
    lo, hi = weights.agg(F.min("log_weight"), F.max("log_weight")).first()
    if lo is None or lo == hi:
        return float("-inf")
    at = F.least(F.floor((F.col("log_weight") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    rows = weights.groupBy(at.alias("at"), "quality").count().collect()  # 2 x bins rows
    n = np.zeros((2, bins))
    for r in rows:
        n[r["quality"], r["at"]] = r["count"]
    if not n.sum(axis=1).all():
        return float("-inf")
    share = n / n.sum(axis=1, keepdims=True)
    # cut before bin i: bad rows at or above it and good rows below it are errors
    errors = np.concatenate([[1], 1 - np.cumsum(share[0])]) + GOOD_WEIGHT * np.concatenate([[0], np.cumsum(share[1])])
    least = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(lo + (hi - lo) * least[len(least) // 2] / bins)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The log ratio of each bucket, and labelled documents (doc_id, quality); at most MAX_LABELLED of them, by hash."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = cut(known)
    n = known.count()
    if n > MAX_LABELLED:
        known = cut(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(990_000 * MAX_LABELLED / n))))
    good = docs.join(broadcast_if_small(known.where("quality = 1").select("doc_id")), "doc_id", "left_semi")
    return log_ratio(bucket_counts(good), bucket_counts(docs)), known


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, evidence: float = EVIDENCE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Importance resampling without replacement: the k documents of largest Gumbel key.

    Target model: hashed n-grams of the documents labelled good; raw model: of all documents. A document's importance weight is
    exp(evidence * its mean log ratio), so that length doesn't decide; the k largest of log weight plus Gumbel noise are a draw
    of k documents one after another, each with a chance in proportion to its weight.
    k: by default the number of documents whose mean log ratio passes the cut that best parts the labelled rows (without labels
    of both kinds, all); which ones, the draw decides.
    Returns (rows: doc_id, n_grams, log_weight, gumbel_key, tie, rank, selected), (docs that are selected).
    Null or empty text: weight 1, as a text that tells nothing. Null doc_id: noise of id 0. Repeated rows: each counts;
    rows alike in key, tie and doc_id are selected together. Empty table: empty. Other columns pass through; columns named
    n_grams, log_weight, gumbel_key or tie are replaced."""
    ratio, known = fit(docs, labels)
    rows = cut(scored(docs.select("doc_id", "text"), ratio, evidence, seed).drop("text"))
    if k is None:
        k = rows.where(F.col("log_weight") >= F.lit(best_cut(rows.join(broadcast_if_small(known), "doc_id")))).count()
    rows = in_order(rows, [F.desc("gumbel_key"), F.desc("tie"), F.desc("doc_id")]).withColumn("rank", F.col("at") + 1).drop("at")
    last = rows.where(F.col("rank") <= k).orderBy(F.desc("rank")).limit(1).select("gumbel_key", "tie", "doc_id").first()
    if last is None:
        return rows.withColumn("selected", F.lit(False)), docs.limit(0)
    none = F.lit(-(1 << 63))
    key = F.struct("gumbel_key", "tie", F.coalesce("doc_id", none).alias("doc_id"))
    lowest = F.struct(F.lit(last[0]).alias("gumbel_key"), F.lit(last[1]).alias("tie"), F.coalesce(F.lit(last[2]).cast("long"), none).alias("doc_id"))
    return rows.withColumn("selected", key >= lowest), scored(docs, ratio, evidence, seed).where(key >= lowest).select(docs.columns)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0].drop("tie")


QUERIES = {"op8_importance_resampling": op8_importance_resampling}
