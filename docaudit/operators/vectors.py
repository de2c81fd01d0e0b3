"""Approximate vector search: an index of sign hashes by random projections, read at the codes nearest to each query."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators.retrieval import best_hits, block_hits, knn

#: Tables, bits of a code, codes that a query reads in each table, and parts over which a code's vectors are spread.
TABLES, BITS, PROBES, PARTS = 2, 8, 64, 8
SEED = 17


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Orthogonal directions where the dimension has so many, of (tables * bits, dim)."""
    x = np.random.default_rng([seed, dim]).standard_normal((tables * bits, dim))
    parts = [np.linalg.qr(x[i : i + dim].T)[0].T for i in range(0, len(x), dim)]
    return np.concatenate(parts)


def _projected(vectors: pd.Series, tables: int, bits: int, seed: int):
    """Rows' numbers and projections (rows, tables, bits), by dimension; null vectors have none."""
    sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = np.array(vectors.iloc[at].tolist(), float) @ planes(int(dim), tables, bits, seed).T
        yield at, np.nan_to_num(x).reshape(len(at), tables, bits)


def codes(vector: str, tables: int, bits: int, probes: int, seed: int) -> Column:
    """Array of structs (tbl, code): in each table the vector's own code and then, up to `probes`, those that differ in bits whose
    projections are nearest to zero. Empty for null and empty vectors."""
    patterns = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1

    @F.pandas_udf("array<struct<tbl:int,code:int>>")
    def hashed(vectors: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in range(len(vectors))]
        for at, x in _projected(vectors, tables, bits, seed):
            own = ((x > 0) << np.arange(bits)).sum(axis=2)
            cost = (x * x) @ patterns.T.astype(float)  # of the bits that each pattern turns
            near = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
            found = own[:, :, None] ^ near
            for row, of in zip(at, found.tolist()):
                out[row] = [{"tbl": i, "code": c} for i, part in enumerate(of) for c in part]
        return pd.Series(out)

    return hashed(F.col(vector))


def hash_index(vectors: DataFrame, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """vectors (vec_id, embedding and filter columns) once in each table, with tbl and code, those of a code side by side.

    Write it partitioned by tbl and code, and a search reads the folders of its codes alone. A code of very many vectors (copies)
    is spread over PARTS tasks, and searched in blocks by as many as it has."""
    each = vectors.withColumn("_at", F.explode(codes("embedding", tables, bits, 1, seed))).select(*vectors.columns, "_at.tbl", "_at.code")
    return each.repartition("tbl", "code", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).sortWithinPartitions("tbl", "code")


def search(queries: DataFrame, index: DataFrame, k: int, where: list[str] | None = None, probes: int = PROBES, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by cosine distance of the vectors at the codes read for each query, among
    those that share the filter columns; distances are exact. tables, bits and seed: as the index was made.

    Recall grows with probes; at 1 << bits every vector is compared and the result is that of knn. Null and empty vectors take no
    part. Ties: smaller vec_id. Fewer than k at those codes: all of them."""
    asked = queries.withColumn("_at", F.explode(codes("embedding", tables, bits, probes, seed))).select(*queries.columns, "_at.tbl", "_at.code")
    hits = block_hits(asked, index, k, [*(where or []), "tbl", "code"])
    return best_hits(hits.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance")), k)


def candidates(queries: DataFrame, index: DataFrame, where: list[str] | None = None, probes: int = PROBES, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(query_id, candidates): how many vectors a search compares with each query, a vector counted in each table that gives it."""
    by = [*(where or []), "tbl", "code"]
    size = lambda df: F.size(df["embedding"])
    n = index.groupBy(*by, size(index).alias("dim")).agg(F.count("*").alias("n"))
    asked = queries.select(F.col("vec_id").alias("query_id"), *(where or []), size(queries).alias("dim"), F.explode_outer(codes("embedding", tables, bits, probes, seed)).alias("_at"))
    asked = asked.select("query_id", *(where or []), "dim", "_at.tbl", "_at.code")
    return asked.join(n, [*by, "dim"], "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, where: list[str] | None = None, above: int | None = None, probes: int = PROBES) -> DataFrame:
    """knn; where `above` is given and there are more vectors than that, by an index made for this search."""
    if above is None or vectors.limit(above + 1).count() <= above:
        return knn(queries, vectors, k, where)
    keep = ["vec_id", "embedding", *(where or [])]
    return search(queries.select(*keep), hash_index(vectors.select(*keep)), k, where, probes)
