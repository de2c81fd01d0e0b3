"""Operators on hand-made rows, with results worked out by the rules."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docaudit.functions import text as tx
from docaudit.operators import evidence, prep, registry, report, retrieval, rules, segment
from docaudit.sources import readers
from docaudit.streaming import monitor as stream

PACK = [("a", 0, "alpha", "A"), ("a", 1, "beta", "B"), ("b", 0, "gamma", "G")]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_scalar_functions(spark):
    row = docs(spark, "x").select(
        tx.norm_label(F.lit(' "Risk-Management" ')).alias("a"),
        tx.norm_label(F.lit("other")).alias("b"),
        tx.norm_severity(F.lit("MAJOR")).alias("c"),
        tx.clamp_score(F.lit(None).cast("int")).alias("d"),
        tx.article_num(F.lit("Article 12(3)")).alias("e"),
        tx.article_num(F.lit("none")).alias("f"),
        F.to_json(tx.parse_reply(F.lit('so: {"score": 7} ok'), "score int")).alias("g"),
        tx.detect_lang(F.lit("der Hund und die Katze ist nicht da")).alias("h"),
    ).first()
    assert tuple(row) == ("risk_management", "unrelated", "major", 50, 12, None, '{"score":7}', "de")


def test_rules(spark):
    d = docs(spark, "alpha beta gamma", "gamma", "nothing", "ALPHA gamma")
    got = {r.doc_id: (r.actor, round(r.confidence, 4)) for r in rules.actor_vote(d, PACK, ["a", "b"], "b").collect()}
    assert got == {0: ("a", 0.62), 1: ("b", 1.0), 2: ("b", 0.3), 3: ("a", 0.35)}
    assert {(r.doc_id, r.category, r.keywords) for r in rules.category_matches(d, PACK).collect()} == {(0, "a", "A,B"), (0, "b", "G"), (1, "b", "G"), (3, "a", "A"), (3, "b", "G")}
    assert [(r.doc_id, r.label) for r in rules.weak_label_binary(d, ["alpha", "beta"], ["gamma"], ("y", "n")).orderBy("doc_id").collect()] == [(0, "y"), (1, "n")]


def test_spans(spark):
    s = spark.createDataFrame([(1, 0, 5, "X"), (1, 3, 12, "Y"), (1, 6, 8, "Z")], "doc_id long, start int, end int, label string")
    assert sorted(r.label for r in rules.resolve_spans(s).collect()) == ["X", "Z"]
    assert [r.label for r in rules.resolve_spans(s, "longest").collect()] == ["Y"]
    assert sorted(r.label for r in rules.override_spans(s.where("label <> 'Y'"), s.where("label = 'Y'")).collect()) == ["Y"]


def test_sections_and_enumerations():
    assert segment.sections("intro\n## One\nbody one\nArticle 2 Scope\nbody two") == [("", "intro"), ("One", "body one"), ("Article 2 Scope", "body two")]
    assert segment.sections(" no heading ") == [("", " no heading ")]
    assert segment.sections("1.2 Scope of it\na\n3. Terms\nb\nRISK MANAGEMENT:\nc\nArtikel 4\nd") == [("1.2 Scope of it", "a"), ("3. Terms", "b"), ("RISK MANAGEMENT", "c"), ("Artikel 4", "d")]
    assert segment.sections("##### five marks\n1. Ti\nSection 3 of it\nAnnex II") == [("", "##### five marks\n1. Ti\nSection 3 of it\nAnnex II")]
    assert segment.sections("# ARTICLES\nx") == [("ARTICLES", "x")]  # two forms at one place: the first form's title
    assert segment.enumeration("Before.\nThe provider shall:\n(a) keep logs;\n(b) keep records; ") == ["The provider shall: (a) keep logs", "The provider shall: (b) keep records"]
    assert segment.enumeration("Items:\n- one\n- two;\n12. three") == ["Items: - one", "Items: - two", "Items: 12. three"]
    assert segment.enumeration("One item:\n(a) only") == []
    assert segment.enumeration("Words:\nshort. sentences\nof. words") == []  # a word with a full stop is no marker
    merged = segment.legal_chunks("# A\n" + "x" * 100 + "\n# B\nshort")
    assert [c["text"] for c in merged] == ["x" * 100 + " short"]
    listed = segment.legal_chunks("# A\nThe provider shall:\n(a) " + "k" * 90 + ";\n(b) " + "r" * 90, propositions=True)
    assert [(c["is_proposition"], c["section_heading"], c["text"][:24]) for c in listed] == [(True, "A", "The provider shall: (a) "), (True, "A", "The provider shall: (b) ")]
    assert segment.legal_chunks("  \n ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_splitters_cover_the_text(text):
    assert "".join("".join(segment.recursive_split(text, 40, 0)).split()) == "".join(text.split()) if text else True
    assert all(len(c) <= 40 for c in segment.recursive_split(text, 40, 0)) if text else True
    assert all(len(c) <= 50 for c in segment.boundary_chunks(text, 50, 10))


def test_boundary_windows():
    assert segment.boundary_chunks(" short ") == [" short "]  # as it stands
    text = "a" * 300 + ". " + "b" * 300 + "\n" + "c" * 100
    # the cut is after the mark and its space, at 302; 50 back, the second window reaches the end; its last 50 stand once more
    assert segment.boundary_chunks(text) == ["a" * 300 + ".", "a" * 48 + ". " + "b" * 300 + "\n" + "c" * 100, "c" * 50]
    # longer: the second window ends at the same mark, the third at the line's end
    assert segment.boundary_chunks(text + "c" * 200) == ["a" * 300 + ".", "a" * 48 + ".", "b" * 300, "b" * 49 + "\n" + "c" * 300, "c" * 50]


def test_evidence(spark):
    audits = spark.createDataFrame([(1, "p", [9], []), (2, "d", [], [13])], "doc_id long, role string, articles array<int>, gdpr_articles array<int>")
    duties = spark.createDataFrame([("o1", "ai", 9, ["p"], ["t1", "t2"]), ("o2", "gdpr", 13, [], []), ("o3", "ai", None, [], ["t1"])], "obligation_id string, regulation string, article_num int, actor array<string>, evidence_required array<string>")
    hits = spark.createDataFrame([(1, "t1")], "doc_id long, term string")
    items = evidence.evidence_items(audits, duties, hits)
    assert {(r.doc_id, r.obligation_id, r.n_required, r.n_satisfied, r.missing, r.coverage) for r in items.collect()} == {(1, "o1", 2, 1, "t2", 0.5), (1, "o3", 1, 1, "", 1.0), (2, "o2", 0, 0, "", 0.0), (2, "o3", 1, 0, "t1", 0.0)}
    m = {r.doc_id: (r.total, r.fully, r.partial, r.missing) for r in evidence.evidence_map(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), items).collect()}
    assert m == {1: (2, 1, 1, 0), 2: (2, 0, 0, 2), 3: (0, 0, 0, 0)}
    assert {(r.obligation_id, r.problem) for r in evidence.validate_obligations(duties, ["d"], ["t1"]).collect()} == {("o1", "unknown actor"), ("o1", "no synonyms")}


def test_fusion_and_selection(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, item string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, item string, rank int")
    assert [r.item for r in retrieval.rrf([a, b], "item").orderBy("rank").collect()] == ["y", "x", "z"]
    gaps = spark.createDataFrame([(1, i, s, 80.0) for i, s in enumerate(["minor"] + ["major"] * 9 + ["critical"] * 6)], "k int, o int, severity string, score double")
    got = report.priority_gaps(gaps, "k", "o").orderBy("place").collect()
    assert [r.severity for r in got] == ["critical"] * 6 + ["major"] * 2
    assert tuple(report.article_verdicts(gaps, "k").first()) == (1, "critical", True, False)


def test_prep_and_registry(spark):
    d = docs(spark, "a", "b", "a", "c")
    assert sorted(r.doc_id for r in prep.dedupe_first(d, "doc_id").collect()) == [0, 1, 3]
    assert sorted(r.doc_id for r in prep.skip_existing(d, docs(spark, "a")).collect()) == [1, 3]
    assert prep.hash_split(d, [], "doc_id", 0.85).where("split = 'train'").count() == 3
    v = spark.createDataFrame([("m", "v9"), ("m", "v10"), ("m", "beta"), ("n", "x")], "type string, version string")
    assert {(r.type, r.next) for r in registry.next_version(v, ["type"]).collect()} == {("m", "v11"), ("n", "v1")}
    models = spark.createDataFrame([("a", "m1", False, "v1"), ("b", "m1", True, None)], "type string, model string, from_hub boolean, trained_on string")
    data = spark.createDataFrame([("a", "v2"), ("b", "v2"), ("c", "v1")], "type string, data_version string")
    assert {(r.type, r.retrain) for r in registry.should_retrain(models, data).collect()} == {("a", True), ("b", False), ("c", True)}


def test_dedupe_and_fingerprint(spark):
    d = spark.createDataFrame([(0, "b"), (1, "b"), (1, "a"), (1, "a"), (2, "a"), (3, None), (4, None)], "pos long, text string")
    assert sorted((r.pos, r.text) for r in prep.dedupe_first(d, "pos").where("text is not null").collect()) == [(0, "b"), (1, "a")]
    assert prep.dedupe_first(d, "pos").where("text is null").count() == 1
    rows = spark.createDataFrame([("x", t) for t in "aac"] + [("y", t) for t in "bbc"] + [("z", t) for t in "caa"], "k string, text string")
    prints = {r.k: r.print for r in prep.fingerprint(rows, ["k"]).collect()}
    assert prints["x"] != prints["y"] and prints["x"] == prints["z"]


def test_entities(spark):
    d = docs(spark, "\u0130\u0130 license", "Act and act, CC BY license", None)
    got = {tuple(r) for r in rules.annotate(d, [], [("L", "license"), ("M", "license"), ("R", "Act")], exact=("R",)).collect()}
    assert got == {(0, 3, 10, "L"), (0, 3, 10, "M"), (1, 19, 26, "L"), (1, 19, 26, "M"), (1, 0, 3, "R")}
    one = rules.annotate(d, [("W", r"CC BY license")], [("L", "license")], policy="leftmost").collect()
    assert [(r.doc_id, r.start, r.label) for r in sorted(one)] == [(0, 3, "L"), (1, 13, "W")]
    s = spark.createDataFrame([(1, 0, 5, "X"), (1, 1, 4, "Y")], "doc_id long, start int, end int, label string")
    ends = spark.createDataFrame([(1, [(1, 4), (5, 9)])], "doc_id long, tokens array<struct<start:int,end:int>>")
    assert [r.label for r in rules.resolve_spans(s, "longest", ends).collect()] == ["Y"]


def test_classifier(spark):
    from docaudit.operators import classify

    rows = spark.createDataFrame([(i, f"alpha beta {i}" if i % 2 else f"gamma delta {i}", "a" if i % 2 else "g") for i in range(60)], "doc_id long, text string, truth string")
    model = classify.train(rows.where("doc_id < 40"), "truth")
    got = classify.predict(rows.where("doc_id >= 40").unionAll(spark.createDataFrame([(99, None, None)], rows.schema)), model).toPandas()
    assert (got[got.doc_id < 99].label == got[got.doc_id < 99].truth).all() and got[got.doc_id == 99].label.item() == "unrelated"
    assert set(got.backend) == {"logistic"}
    both = classify.first_known(spark.createDataFrame([(1, "a", 0.9, "p")], "doc_id long, label string, confidence double, backend string"), spark.createDataFrame([(1, "b", 0.8, "s"), (2, "c", 0.7, "s")], "doc_id long, label string, confidence double, backend string"))
    assert {(r.doc_id, r.label, r.backend) for r in both.collect()} == {(1, "a", "p"), (2, "c", "s")}


def test_counters(spark):
    from docaudit.operators import monitor

    e = spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate([("s", 0)] * 4 + [("d", 2), ("d", 4), ("f", 6)])], "event_id long, event_type string, value double")
    assert tuple(monitor.pipeline_stats(e, "s", "d", "f").first()) == (4, 2, 1, 4.0, 1, 50.0)
    v = spark.createDataFrame([(0, "a", float(i % 10)) for i in range(100)] + [(0, "b", 7.0), (0, "c", None)], "event_id long, event_type string, value double")
    assert {r.event_type: r.p95 for r in monitor.stage_stats(v).collect()} == {"a": 9.0, "b": 7.0, "c": None}


def test_expand_templates(spark):
    t = spark.createDataFrame([(0, [("The ", None), (None, "A"), (" does ", None), (None, "B")])], "template_id int, parts array<struct<text:string,slot:string>>")
    w = spark.createDataFrame([("A", "cat"), ("A", "horse"), ("B", "it"), ("B", "that")], "slot string, word string")
    rows = prep.expand_templates(t, w, 4, 1).collect()
    assert {r.text for r in rows} == {f"The {a} does {b}" for a in ("cat", "horse") for b in ("it", "that")}
    assert all(r.text[e.start : e.end] in ("cat", "horse", "it", "that") for r in rows for e in r.entities)
    assert rows == prep.expand_templates(t, w, 4, 1).collect()


def test_report_defaults(spark):
    rows = spark.createDataFrame([(1, 9, [10], 3, False), (1, 10, [10], 0, False), (1, 11, [], 2, True), (1, 12, None, 2, False)], "doc_id long, article int, applicable array<int>, chunk_count int, failed boolean")
    got = {r.article: (r.score, [g.severity for g in r.gaps] if r.gaps is not None else None) for r in report.article_defaults(rows).collect()}
    assert got == {9: (100.0, []), 10: (0.0, ["critical"]), 11: (30.0, ["major"]), 12: (None, None)}


def test_bm25_boost_and_parts(spark):
    d = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(["risk log", "risk log", "data", "more words here", "other text", "nothing"])], "doc_id long, text string, lang string")
    q = spark.createDataFrame([(1, "risk", "en")], "query_id long, text string, lang string")
    got = retrieval.bm25_search(q, d, [], 5, k1=1.2, lucene=True, boost=("lang", 1.5)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 0] and got[0].score > got[1].score
    whole = retrieval.with_whole(d.withColumn("article", F.lit(9)), "article")
    assert whole.where("article is null").count() == 6 and retrieval.bm25_stats(whole, ["article"])[0].count() == 2


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text('{"a": {"b": 2}}')
    (tmp_path / "r" / "y.json").write_text("{broken")
    assert [(r.key) for r in readers.read_eval_results(spark, str(tmp_path / "r")).collect()] == ["x"]
    (tmp_path / "t.txt").write_text("DOMAIN: Risk\r\n=== EN ===\none\n=== FR ===\nune\n=== DE ===\neins\n")
    assert sorted((r.lang, r.text) for r in readers.read_lang_sections(spark, str(tmp_path / "t.txt")).collect()) == [("de", "eins"), ("en", "one")]
    assert [r.domain for r in readers.read_domain_labels(spark, str(tmp_path / "t.txt"), ["risk"]).collect()] == ["risk"]
    assert readers.read_domain_labels(spark, str(tmp_path / "t.txt"), ["data"]).count() == 0
    d = docs(spark, "a", "b", "a")
    readers.write_labelled(d, str(tmp_path / "out"))
    readers.write_labelled(docs(spark, "b", "c"), str(tmp_path / "out"))
    assert sorted(r.text for r in readers.read_labelled(spark, str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    parts = spark.createDataFrame([("p", 1), ("q", 2)], "collection string, v int")
    readers.rebuild(parts, str(tmp_path / "coll"), ["p", "q"])
    readers.rebuild(spark.createDataFrame([("p", 3)], "collection string, v int"), str(tmp_path / "coll"), ["p"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "coll")).select("collection", "v").collect()) == [("p", 3), ("q", 2)]
    assert readers.read_or(d.where("1 = 0"), d).count() == 3 and readers.read_or(d.limit(1), d).count() == 1
    readers.write_reports(spark.createDataFrame([("complete", 1), ("open", 2)], "status string, n int"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 1
    html = spark.createDataFrame([(1, "<p>Article 1</p><script>x</script><div>one <b>two</b></div><p>Stop</p>")], "page_id long, html string")
    assert [(r.title, r.text) for r in readers.extract_sections(html, "^Article", "^Stop").collect()] == [("Article 1", "one two")]


def test_streams(spark, tmp_path):
    docs(spark, "a", "b").write.parquet(str(tmp_path / "docs"))
    for _ in range(2):  # the second run finds nothing new
        q = stream.stream_audit(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs")), lambda b: b.select("doc_id", F.length("text").alias("n")), str(tmp_path / "audit"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_readers(spark, tmp_path):
    folder = tmp_path / "reg"
    folder.mkdir()
    (folder / "a.txt").write_text("ARTICLE: 9\nDOMAIN: risk\nTITLE_EN: Risk: all\n\n=== EN ===\nText one.\n=== DE ===\nText zwei.\n=== FR ===\n\n")
    got = sorted(tuple(r) for r in readers.read_regulatory(spark, str(folder)).collect())
    assert got == [("de", "Text zwei.", 9, "risk", "reg", "Risk: all"), ("en", "Text one.", 9, "risk", "reg", "Risk: all")]
    (folder / "o.json").write_text('{"id": "x", "actor": ["p"]}\nnot json\n')
    assert [r.id for r in readers.read_obligations(spark, str(folder / "o.json")).collect()] == ["x"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    rows = stream.stream_stage_stats(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour", "1000 days")
    q = rows.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    from docaudit.operators import monitor

    batch = monitor.windowed_stats(events, "1 hour").select("began", "event_type", "n")
    assert spark.table("stats").select("began", "event_type", "n").exceptAll(batch).count() == 0
    assert spark.table("stats").count() == batch.count()


def test_few_obligations_meet_documents_without_a_shuffle(spark):
    audits = spark.createDataFrame([(1, "g1", [9], [5]), (2, None, None, []), (3, "g2", [], [13])], "doc_id long, role string, articles array<int>, gdpr_articles array<int>").repartition(2)
    duties = spark.createDataFrame([("a", "ai", 9, ["g1"], ["x", "y"]), ("b", "gdpr", 13, [], ["x"]), ("c", "ai", None, None, None)], "obligation_id string, regulation string, article_num int, actor array<string>, evidence_required array<string>")
    due = evidence.applicable_obligations(audits, duties)
    assert sorted((r.doc_id, r.obligation_id) for r in due.collect()) == [(1, "a"), (1, "c"), (2, "c"), (3, "b"), (3, "c")]
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan
    hits = spark.createDataFrame([(1, "y"), (1, "y"), (3, "z")], "doc_id long, term string")
    got = {(r.doc_id, r.obligation_id): (r.n_required, r.n_satisfied, r.satisfied, r.missing) for r in evidence.evidence_items(audits, duties, hits).collect()}
    assert got == {(1, "a"): (2, 1, "y", "x"), (1, "c"): (0, 0, "", ""), (2, "c"): (0, 0, "", ""), (3, "b"): (1, 0, "", "x"), (3, "c"): (0, 0, "", "")}
