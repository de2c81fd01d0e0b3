"""Scorers: one load a worker, batches, fallback, and the operators that take them."""

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docaudit.operators import retrieval, scorers
from docaudit.operators.scorers import Scorer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def noting(path, load):
    def noted():
        with open(path, "a") as f:
            f.write(f"{os.getpid()}\n")
        return load()

    return noted


def lengths(batch):
    return pd.DataFrame({"label": ["long" if len(t or "") > 5 else "short" for t in batch["text"]], "confidence": float(len(batch))})


@pytest.fixture
def chunks(spark):
    rows = [(i, "x" * (i % 12) if i % 10 else None) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("backend", F.lit("clash")).repartition(8)


def test_loads_once_a_worker_and_keeps_the_batch_size(chunks, tmp_path):
    one = Scorer("lengths-1", noting(tmp_path / "loads", lambda: lengths), 16)
    for _ in range(3):
        got = scorers.scored(chunks, ["text"], "label string, confidence double", [one]).collect()
    pids = (tmp_path / "loads").read_text().split()
    assert len(pids) == len(set(pids)) and len(got) == 400
    assert {r.backend for r in got} == {"lengths-1"} and max(r.confidence for r in got) == 16
    assert all(r.label == ("long" if len(r.text or "") > 5 else "short") for r in got)


def test_unavailable_is_remembered_and_the_next_stands_in(chunks, tmp_path):
    def missing():
        raise FileNotFoundError("no model")

    gone = Scorer("gone-1", noting(tmp_path / "tries", missing), 16)
    for _ in range(2):
        got = scorers.scored(chunks, ["text"], "label string, confidence double", [gone, Scorer("lengths-2", lambda: lengths, 8)]).collect()
    tries = (tmp_path / "tries").read_text().split()
    assert len(tries) == len(set(tries)) and {r.backend for r in got} == {"lengths-2"}


def test_a_failing_batch_goes_to_the_next_scorer_alone(chunks):
    def picky(batch):
        if (batch["text"].fillna("").str.len() == 11).any():
            raise ValueError("too long")
        return lengths(batch)

    got = scorers.scored(chunks, ["text"], "label string, confidence double", [Scorer("picky", lambda: picky, 1), Scorer("lengths-3", lambda: lengths, 4)]).collect()
    assert all((r.backend == "lengths-3") == (len(r.text or "") == 11) for r in got)
    short = Scorer("short", lambda: lambda b: lengths(b).iloc[:-1], 4)  # rows are missing: a failure, too
    none = scorers.classify_chunks(chunks, [short]).collect()
    assert {(r.label, r.confidence, r.backend) for r in none} == {("unrelated", 0.0, "none")}
    assert {r.backend for r in scorers.scored(chunks, ["text"], "score double", []).collect()} == {"none"}
    assert scorers.scored(chunks.where("1 = 0"), ["text"], "score double", [short]).collect() == []


def test_labels_are_normalised(chunks):
    says = lambda b: pd.DataFrame({"label": [" Human-Oversight " if t else "nonsense" for t in b["text"].fillna("")], "confidence": 0.5})
    got = scorers.classify_chunks(chunks, [Scorer("says", lambda: says)]).collect()
    assert {(bool(r.text), r.label) for r in got} == {(True, "human_oversight"), (False, "unrelated")}


def test_rerank_by_pairs_and_without(spark):
    hits = spark.createDataFrame([(1, "a b", t, i) for i, t in enumerate(["x", "a", "a b", "b q", "zz"])] + [(2, "q", "n", 0), (2, "q", "m", 1)], "query_id long, query_text string, text string, rank int")

    def pair(batch):
        if (batch["query_text"] == "q").any():
            raise ValueError
        return pd.DataFrame({"score": [float(len(t)) for t in batch["text"]]})

    got = [(r.query_id, r.text, r.backend) for r in scorers.rerank(hits, 2, [Scorer("pair", lambda: pair, 1)]).orderBy("query_id", "new_rank").collect()]
    assert got == [(1, "a b", "pair"), (1, "b q", "pair"), (2, "n", "none"), (2, "m", "none")]
    plain = [r.text for r in scorers.rerank(hits, 2).where("query_id = 1").orderBy("new_rank").collect()]
    assert plain == ["a b", "a"] == [r.text for r in retrieval.overlap_rerank(hits, 2).where("query_id = 1").orderBy("new_rank").collect()]


def test_entailment_scores_only_what_no_rule_hit(spark, tmp_path):
    labels = ["contradiction", "entailment", "neutral"]
    pairs = spark.createDataFrame([(1, "log", "kept", "c"), (1, "risk", "yes", "c"), (2, "risk", "no", "c"), (2, "plan", "half", "c")], "doc_id long, term string, text string, claim string")
    hits = spark.createDataFrame([(1, "log")], "doc_id long, term string")

    def model(batch):
        assert "kept" not in set(batch["text"])
        table = {"yes": [0.1, 0.8, 0.1], "no": [0.8, 0.1, 0.1], "half": [0.3, 0.4, 0.3]}
        return pd.DataFrame({"scores": [table[t] for t in batch["text"]]})

    assert [tuple(r) for r in scorers.entailments(pairs, hits, labels, [Scorer("nli", lambda: model)]).collect()] == [(1, "risk")]


def test_encoder_encodes_each_text_once(spark, tmp_path):
    def encode(batch):
        with open(tmp_path / "texts", "a") as f:
            f.writelines(f"{t}\n" for t in batch["text"])
        return pd.DataFrame({"embedding": [list(np.array([len(t), 1.0])) for t in batch["text"]]})

    texts = spark.createDataFrame([(i, "abc"[: i % 3 + 1]) for i in range(30)], "doc_id long, text string")
    got = retrieval.embed_distinct(texts, scorers.encoder([Scorer("enc", lambda: encode)])).collect()
    assert sorted((tmp_path / "texts").read_text().split()) == ["a", "ab", "abc"]
    assert len(got) == 30 and all(r.embedding == [len(r.text), 1.0] and r.backend == "enc" for r in got)


def test_word_vote():
    vote = scorers.word_vote("v", {"de": ["und", "der"], "en": ["the", "and"]}).load()
    got = vote(pd.DataFrame({"text": ["The und and", "und, and", None, "x"]}))
    assert got.values.tolist()[:2] == [["en", 2 / 3], ["de", 0.5]] and got["label"].isna().tolist() == [False, False, True, True]
