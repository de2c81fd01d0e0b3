"""Full reports by hand-made audits."""

from pyspark.sql import functions as F

from docaudit.operators import report

AUDIT = """doc_id long, note string, total_chunks int, classified_chunks int, fallback_tier string, wizard_tier string, emotion struct<detected:boolean>,
actor struct<actor:string,confidence:double>, applicability struct<articles:array<int>,is_prohibited:boolean,is_high_risk:boolean>, evidence struct<total:long,mean_coverage:double>"""
SCORE = f"doc_id long, article int, chunk_count int, score double, gaps array<{report.GAP}>, recommendations array<string>, reasoning string, passages array<struct<title:string,text:string,regulation:string,article_ref:string>>"


def reports(spark, audits, scores):
    df = report.full_reports(spark.createDataFrame(audits, AUDIT), spark.createDataFrame(scores, SCORE), {10: "data", 9: "risk"}, {"m": "1"}, "rules")
    return {r.note: r for r in df.collect()}


def test_full_reports(spark):
    gap = ("t", "d", "major")
    scores = [(1, 9, 2, 80.0, [gap], ["do"], "why", [("a", "b", "c", "d")]), (1, 10, 1, 40.0, [], [], "", []), (1, 11, 1, 5.0, [], [], "", []), (2, 9, 1, 61.25, [], [], "", []), (2, 9, 3, 90.0, [], [], "", [])]
    gate = lambda articles, p, h: (articles, p, h)
    audits = [
        (1, "open", 4, 1, "high", "minimal", (True,), ("unknown", 0.9), None, None),
        (1, "gated", 0, 0, "minimal", None, None, ("provider", 0.9), gate([9], False, True), (2, 0.5)),
        (1, "nothing applies", 0, 0, "high", None, None, None, gate([], False, False), (0, 0.0)),
        (1, "forbidden", 2, 2, "minimal", None, None, None, gate([5], True, True), (0, 0.0)),
        (2, "twice", 1, 0, None, None, None, None, None, None),
        (3, "unscored", None, None, "minimal", None, None, None, None, None),
        (None, "no id", 1, 1, "minimal", None, None, None, None, None),
    ]
    got = reports(spark, audits, scores)
    assert {n: r.overall_score for n, r in got.items()} == {"open": 60.0, "gated": 80.0, "nothing applies": 100.0, "forbidden": 100.0, "twice": 30.6, "unscored": 0.0, "no id": 0.0}
    assert {n: r.risk_tier for n, r in got.items()} == {"open": "high", "gated": "high", "nothing applies": "minimal", "forbidden": "prohibited", "twice": None, "unscored": "minimal", "no id": "minimal"}
    assert {n: r.confidence_score for n, r in got.items()} == {"open": 0.58, "gated": 0.83, "nothing applies": 1.0, "forbidden": 0.75, "twice": 0.0, "unscored": 1.0, "no id": 1.0}
    assert [n for n, r in got.items() if r.requires_human_review] == ["open", "twice"]
    first, second = got["open"].article_scores
    assert (first.article, first.domain, first.score, first.chunk_count, first.reasoning) == (9, "risk", 80.0, 2, "why")
    assert [tuple(g) for g in first.gaps] == [gap] and first.recommendations == ["do"] and first.passages[0].article_ref == "d"
    assert (second.article, second.score) == (10, 40.0) and got["open"].emotion.detected and got["open"].model_versions == {"m": "1"}
    assert [(a.article, a.score, a.chunk_count, a.gaps) for a in got["unscored"].article_scores] == [(9, 0.0, 0, []), (10, 0.0, 0, [])]
    assert "fallback_tier" not in got["open"].asDict() and got["open"].classifier_backend == "rules"


def test_empty_tables(spark):
    assert reports(spark, [], []) == {}


def test_row_vote_equals_actor_vote(spark):
    from docaudit.operators import rules

    pack = [("a", 0, "x", "x"), ("a", 1, "y", "y"), ("b", 0, "z", "z"), ("b", 1, "w", "w"), ("c", 0, "v", "v")]
    rows = [(i, " ".join(c for j, c in enumerate("xyzwv") if i >> j & 1)) for i in range(32)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(g)) for g, _, p, _ in pack]))
    got = docs.select("doc_id", rules.row_vote(hits, ["a", "b", "c"], "b").alias("v")).select("doc_id", "v.*")
    want = rules.actor_vote(docs, pack, ["a", "b", "c"], "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
