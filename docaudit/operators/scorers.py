"""Pluggable scorers: models that are loaded once in a worker, get batches of a set size and stand in for each other."""

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import norm_label, tokens

#: In a worker: each scorer's model by name, or the error that its loading ended with; that one is not tried again.
_loaded: dict[str, Any] = {}
NONE = "none"


@dataclass(frozen=True)
class Scorer:
    """load() gives a function of a batch (a pandas frame of the inputs) that returns a frame of the result columns, row for row.
    It runs in the worker, once, whatever tasks follow there; name tells backends apart, and versions of one."""

    name: str
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    batch: int = 32


def model_of(scorer: Scorer) -> Callable[[pd.DataFrame], pd.DataFrame] | None:
    """The scorer's model in this worker; None if it is unavailable."""
    if scorer.name not in _loaded:
        try:
            _loaded[scorer.name] = scorer.load()
        except Exception as e:  # any failure to load makes a backend unavailable, as a missing file or library would
            logging.getLogger(__name__).warning("scorer %s is unavailable: %s", scorer.name, e)
            _loaded[scorer.name] = e
    found = _loaded[scorer.name]
    return None if isinstance(found, Exception) else found


def _run(scorers: list[Scorer], batch: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """A frame of results and backend: pieces of the first available scorer's batch size; a piece that it fails on goes to the next."""
    if not scorers:
        return pd.DataFrame({**{c: [None] * len(batch) for c in names}, "backend": NONE}, index=range(len(batch)))
    first, *others = scorers
    model, out = model_of(first), []
    if model is None:
        return _run(others, batch, names)
    for a in range(0, len(batch), first.batch):
        piece = batch.iloc[a : a + first.batch].reset_index(drop=True)
        try:
            got = model(piece)[names].reset_index(drop=True)
            if len(got) != len(piece):
                raise ValueError(f"{len(got)} results for {len(piece)} rows")
            out.append(got.assign(backend=first.name))
        except Exception as e:  # whatever a model raises, the next backend takes the piece
            logging.getLogger(__name__).warning("scorer %s failed on %d rows: %s", first.name, len(piece), e)
            out.append(_run(others, piece, names))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[*names, "backend"])


def scored(df: DataFrame, inputs: list[str], result: str, scorers: list[Scorer]) -> DataFrame:
    """df with the columns of result (a schema) and backend: the name of the scorer that gave them. Where none did, they are
    null and backend is 'none'. Only the inputs go to the workers, in the session's Arrow batches."""
    names = [f.split()[0] for f in result.split(", ")]

    @F.pandas_udf(f"{result}, backend string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _run(scorers, batch, names)

    out = df.withColumn("_scored", run(F.struct(*inputs)))
    kept = [c for c in df.columns if c not in (*names, "backend")]
    return out.select(*kept, *[F.col(f"_scored.{c}").alias(c) for c in (*names, "backend")])


def rerank(hits: DataFrame, k: int, scorers: list[Scorer] | None = None) -> DataFrame:
    """The k best of each query's hits (query_id, query_text, text, rank) by a pair score of query and text: score, new_rank,
    backend. Hits that no scorer scored follow in fused order; without scorers, the share of the query's words that a hit has."""
    if scorers:
        out = scored(hits, ["query_text", "text"], "score double", scorers)
    else:
        q, p = F.array_distinct(tokens(F.col("query_text"))), F.array_distinct(tokens(F.col("text")))
        out = hits.withColumns({"score": F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1)), "backend": F.lit("overlap")})
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    return out.withColumn("score", F.round("score", 6)).withColumn("new_rank", F.row_number().over(best)).where(F.col("new_rank") <= k)


def classify_chunks(chunks: DataFrame, scorers: list[Scorer]) -> DataFrame:
    """chunks (text) with label, confidence, backend: labels as the model wrote them are normalised; unknown ones, and chunks
    that no backend could classify, are 'unrelated' with confidence 0 in the latter case."""
    out = scored(chunks, ["text"], "label string, confidence double", scorers)
    failed = F.col("label").isNull()
    return out.withColumn("confidence", F.when(failed, 0.0).otherwise(F.col("confidence"))).withColumn("label", F.when(failed, "unrelated").otherwise(norm_label(F.col("label"))))


def entailments(pairs: DataFrame, hits: DataFrame, labels: list[str], scorers: list[Scorer], least: float = 0.5) -> DataFrame:
    """(doc_id, term) that a model accepts, of pairs (doc_id, term, text, claim) that no rule hit; only these are scored."""
    from docaudit.operators.rules import entail_gate

    open_ = pairs.join(hits.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti")
    table = scored(open_, ["text", "claim"], "scores array<double>", scorers).where(F.col("scores").isNotNull())
    return entail_gate(table.select("doc_id", "term", "scores"), hits, labels, least)


def encoder(scorers: list[Scorer]) -> Callable[[DataFrame], DataFrame]:
    """For embed_distinct: (text_key, embedding, backend) of each text."""
    return lambda texts: scored(texts, ["text"], "embedding array<double>", scorers).drop("text")


def word_vote(name: str, words: dict[str, list[str]], batch: int = 32) -> Scorer:
    """A scorer without a model file: the label with most of its words in the text (the first on ties; null if there are none),
    and that label's share of all such words."""

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        import re

        split, lists = re.compile(r"[^a-z]+").split, {label: frozenset(w) for label, w in words.items()}

        def vote(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for text in batch["text"]:
                own = split((text or "").lower())
                n = {label: sum(w in listed for w in own) for label, listed in lists.items()}
                best = max(n, key=n.get)
                rows.append((best, n[best] / sum(n.values())) if n[best] else (None, None))
            return pd.DataFrame(rows, columns=["label", "confidence"])

        return vote

    return Scorer(name, load, batch)
