"""Retrieval: BM25 over posting tables, vector search, rank fusion."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docaudit.functions.text import tokens
from docaudit.operators.postings import bm25_search, statistics


def with_whole(passages: DataFrame, part: str) -> DataFrame:
    """Each passage in its own partition and in the whole collection's, whose partition column is NULL."""
    return passages.unionByName(passages.withColumn(part, F.lit(None).cast(passages.schema[part].dataType)))


def bm25_stats(passages: DataFrame, part: list[str]) -> tuple[DataFrame, DataFrame]:
    """Partition sizes (part, n, avgdl) and terms (part, term, df, idf, lucene_idf)."""
    values = F.from_json("g", passages.select(*part).schema) if part else None
    return tuple(df.select(*[values[c].alias(c) for c in part], *[c for c in df.columns if c != "g"]) for df in statistics(passages, part))


QUERY_BLOCK, VECTOR_BLOCK = 256, 4096


def _blocks(df: DataFrame, key: str, where: list[str], size: int) -> DataFrame:
    """Rows of one filter value and dimension as blocks: ids and unit vectors, in binary columns. (g: the filter values.)"""

    def pack(batches):
        for batch in batches:
            for (g, dim), part in batch.groupby(["g", "dim"], dropna=False, sort=False):
                for i in range(0, len(part), size):
                    p = part.iloc[i : i + size]
                    x = np.array(p["v"].tolist(), float).reshape(len(p), -1)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                    yield pd.DataFrame({"g": [g], "dim": [dim], "ids": [p[key].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    g = F.to_json(F.struct(*where)) if where else F.lit("")
    return df.where(F.col("embedding").isNotNull()).select(key, g.alias("g"), F.size("embedding").alias("dim"), F.col("embedding").alias("v")).mapInPandas(pack, "g string, dim int, ids binary, x binary")


def knn(queries: DataFrame, vectors: DataFrame, k: int, where: list[str] | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank) by cosine distance among vectors that share the filter columns."""
    return best_hits(block_hits(queries, vectors, k, where, queries.sparkSession.sparkContext.defaultParallelism * 2), k)


def block_hits(queries: DataFrame, vectors: DataFrame, k: int, where: list[str] | None = None, salts: int = 1) -> DataFrame:
    """(query_id, vec_id, distance): blocks of queries meet blocks of vectors; each pair of blocks gives k rows a query at most.
    salts: parts over which the vectors of one filter value are dealt, so that many meet the queries in many tasks."""
    v = _blocks(vectors, "vec_id", where or [], VECTOR_BLOCK).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    q = _blocks(queries.repartition(max(1, queries.sparkSession.sparkContext.defaultParallelism // 4)), "vec_id", where or [], QUERY_BLOCK).select("g", "dim", F.col("ids").alias("q_ids"), F.col("x").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def search(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                ids, q_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                near = np.round(1 - np.frombuffer(row.q).reshape(len(q_ids), -1) @ np.frombuffer(row.x).reshape(len(ids), -1).T, 6)
                near[(q_ids[:, None] == ids[None, :]) | np.isnan(near)] = np.inf
                n = min(k, len(ids))
                at, of = np.nonzero((near <= np.partition(near, n - 1, axis=1)[:, n - 1 : n]) & np.isfinite(near))
                order = np.lexsort((ids[of], near[at, of], at))
                at, of = at[order], of[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < n
                at, of = at[first], of[first]
                out.append(pd.DataFrame({"query_id": q_ids[at], "vec_id": ids[of], "distance": near[at, of] + 0.0}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})

    return v.join(q, ["g", "dim", "salt"]).select("ids", "x", "q_ids", "q").mapInPandas(search, "query_id long, vec_id long, distance double")


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's hits, with rank."""
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")  # k rows a block
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "distance", "rank")


def flatten_hits(df: DataFrame) -> DataFrame:
    """Rows of results held as lists (query_id, ids, documents, distances), one row a hit; blank documents go. rank: place in the list."""
    each = df.select("query_id", F.posexplode(F.arrays_zip("ids", "documents", "distances")).alias("pos", "hit"))
    return each.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.ids").alias("id"), F.col("hit.documents").alias("text"), F.col("hit.distances").alias("distance")).where(F.coalesce("text", F.lit("")) != "")


def load_corpus(passages: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """Passages that are not blank, and how many there are and in how many partitions."""
    kept = passages.where(F.coalesce("text", F.lit("")) != "")
    return kept, kept.agg(F.count("*").alias("passages"), F.count_distinct(part).alias("partitions"))


def gate_chunks(chunks: DataFrame, applicable: DataFrame) -> DataFrame:
    """Chunks whose article applies: applicable has (doc_id, articles). A chunk without an article stays, and so does one whose
    document has no list; an empty list lets no article pass."""
    a = applicable.select(F.col("doc_id").alias("_d"), F.col("articles").alias("_a"))
    out = chunks.join(a, F.col("doc_id") == F.col("_d"), "left")
    return out.where(F.col("article").isNull() | F.col("_a").isNull() | F.array_contains("_a", F.col("article"))).drop("_d", "_a")


def hybrid_retrieve(chunks: DataFrame, passages: DataFrame, applicable: DataFrame, k: int = 5, candidates: int = 10, regulation: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the applicability gate, then the best passages by words and by vectors among those of the
    chunk's article (a chunk without one searches all), fused by rank, then ranked by shared words.

    chunks: doc_id, query_id, article, lang, text, embedding. passages: doc_id, article, regulation, lang, text, embedding. A
    regulation limits the vector search before, and the word search after its first `candidates`; passages without one don't match."""
    open_ = gate_chunks(chunks, applicable).select("query_id", "article", "lang", "text", "embedding").persist(StorageLevel.MEMORY_AND_DISK)
    # read once, and dealt evenly: wherever they come from, all tasks share the searches
    tasks = 4 * passages.sparkSession.sparkContext.defaultParallelism
    passages = passages.select("doc_id", "article", "regulation", "lang", "text", "embedding").repartition(tasks, "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    words = bm25_search(open_.select("query_id", "article", "text"), passages, ["article"], candidates, whole=True).select("query_id", "doc_id", F.lit(0.0).alias("distance"), F.col("rank").alias("place"))
    near = passages if regulation is None else passages.where(F.col("regulation") == regulation)
    near = with_whole(near.select((-1 - F.col("doc_id")).alias("vec_id"), "article", "embedding"), "article")
    vectors = knn(open_.select(F.col("query_id").alias("vec_id"), "article", "embedding"), near, candidates, ["article"])
    vectors = vectors.select("query_id", (-1 - F.col("vec_id")).alias("doc_id"), "distance", F.col("rank").alias("place"))
    about = passages.select("doc_id", "lang", "regulation")
    asked = open_.select("query_id", F.col("lang").alias("query_lang"))
    lists = []
    for hits, late in ((words, True), (vectors, False)):
        hits = hits.join(about, "doc_id").join(asked, "query_id")
        if late and regulation is not None:
            hits = hits.where(F.col("regulation") == regulation)
        lists.append(language_rank(hits).select("query_id", "doc_id", "rank"))
    fused = rrf(lists, "doc_id").join(passages.select("doc_id", "text"), "doc_id").join(open_.select("query_id", F.col("text").alias("query_text")), "query_id")
    return overlap_rerank(fused, k).select("query_id", "doc_id", F.col("overlap").alias("score"), F.col("new_rank").alias("rank"))


def rrf(lists: list[DataFrame], item: str, k: int = 60) -> DataFrame:
    """(query_id, item, score, rank): sum of 1 / (k + rank) over lists of (query_id, item, rank); ties by first appearance."""
    rows = None
    for i, part in enumerate(lists):
        part = part.select("query_id", item, "rank", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", item).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    fused = fused.withColumn("score", F.round("score", 9))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", item)
    return fused.withColumn("rank", F.row_number().over(best)).select("query_id", item, "score", "rank")


def language_rank(hits: DataFrame) -> DataFrame:
    """Stable order of each query's hits: its own language first, then distance, then the place so far."""
    order = Window.partitionBy("query_id").orderBy((~F.col("lang").eqNullSafe(F.col("query_lang"))).cast("int"), "distance", "place")
    return hits.withColumn("rank", F.row_number().over(order))


def overlap_rerank(hits: DataFrame, k: int) -> DataFrame:
    """Fallback scorer: share of the query's distinct words that the passage has; ties keep the fused order."""
    q, p = F.array_distinct(tokens(F.col("query_text"))), F.array_distinct(tokens(F.col("text")))
    scored = hits.withColumn("overlap", F.round(F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1)), 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(best)).where(F.col("new_rank") <= k)


def select_query_chunks(chunks: DataFrame, targets: DataFrame, n: int = 3) -> DataFrame:
    """(label, vec_id, score, rank): of each group (label) the n chunks nearest to its target vector by inner product. A group of
    no more than n keeps all in document order (vec_id), and one without a target (or with a null one) its first n; score is
    null where nothing was scored."""
    both = chunks.join(targets, "label", "left")
    scored = both.withColumn("score", F.round(F.aggregate(F.zip_with("embedding", "target", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), 6))
    scored = scored.withColumn("score", F.when((F.count("*").over(Window.partitionBy("label")) > n) & F.col("target").isNotNull(), F.col("score")))
    best = Window.partitionBy("label").orderBy(F.desc_nulls_last("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("label", "vec_id", "score", "rank")


def merge_passages(hits: DataFrame, n: int = 5) -> DataFrame:
    """First appearance of each item over a group's queries, in order, n at most."""
    first = hits.groupBy("grp", "item").agg(F.min(F.struct("query_ord", "rank")).alias("first"))
    best = Window.partitionBy("grp").orderBy("first", "item")
    return first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).select("grp", "item", "place")


def embed_distinct(texts: DataFrame, encode) -> DataFrame:
    """Encodes each distinct text once (by hash) and joins the result back to all rows; encode: a function of a DataFrame."""
    keyed = texts.withColumn("text_key", F.sha2("text", 256))
    return keyed.join(encode(keyed.select("text_key", "text").dropDuplicates(["text_key"])), "text_key")


def top_by(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
