"""Rule tables with a prefilter, and table functions in SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docaudit.operators import packs, segment


@pytest.mark.parametrize(
    "pattern, literals",
    [("abc", ["abc"]), (r"\bRisk\s+plan\b", ["risk"]), ("(?:ab|cde)fg", ["ab", "cde"]), ("a?bc+d", ["b"]), ("(log){2,}x", ["log"]), ("[xy]z*", []), ("x|.", []), ("ab(?=cd)ef", ["ab"]), ("^data$", ["data"]), ("(?:high )risk", ["high risk"]), ("É", [])],
)
def test_required_literals(pattern, literals):
    got = packs.required(pattern)
    assert sorted(got) == sorted(literals) or (got and len(min(got, key=len)) >= len(min(literals, key=len)))


def test_the_prefilter_loses_no_match():
    rnd = random.Random(6)
    parts = ["ab", "c", "d+", "[ce]", "(?:ab|c)", "(?:x|yy)?", ".", r"\b", "^", "(?=a)", "(d|ee){1,2}", "K", "s", r"\s", "(?:)", "é", "(?i:b)", "b*?", "(?!q)"]
    patterns = list({"".join(rnd.choices(parts, k=rnd.randint(1, 5))) for _ in range(600)})
    machine = packs.Machine(patterns)
    texts = ["".join(rnd.choices(["a", "b", "AB", "c", "D", "ee", "x", "yy", "K", "k", "ſ", " ", "\n", "é", "É", "q", "İ"], k=rnd.randint(0, 12))) for _ in range(400)]
    for t in texts:
        assert machine(t) == [i for i, p in enumerate(patterns) if re.search(p, t, re.I)]
    assert len(machine.always) < len(patterns) / 2


def test_scan_of_five_thousand_patterns_tries_few(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    words = list({word() for _ in range(5000)})
    rows = [("p", "g", i, rf"\b{w}\b", w) for i, w in enumerate(words)] + [("p", "any", 0, r"\d{3}", "number")]
    texts = [" ".join(rnd.choices(words, k=5) + [word(), "7" * (i % 5)]) for i in range(200)] + [None, "", words[0].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = packs.scan(docs, spark.createDataFrame(rows, "pack string, rule_group string, rule_idx int, pattern string, label string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(d, r[4]) for d, t in enumerate(texts) for r in rows if t and re.search(r[3], t, re.I)}
    assert {(r.doc_id, r.label) for r in got.collect()} == want
    machine = packs.Machine([r[3] for r in rows])
    assert max(len(machine.candidates(t or "")) for t in texts) < 20
    with pytest.raises(re.error):
        packs.scan(docs, spark.createDataFrame([("p", "g", 0, "(", "x")], "pack string, rule_group string, rule_idx int, pattern string, label string"))


def test_chunkers_in_sql(spark):
    docs = spark.createDataFrame([(0, "# A\n\nWe keep:\n(a) logs;\n(b) plans of the year;\n\n# B\n\n" + "One sentence. " * 90), (1, None), (2, ""), (3, "short")], "doc_id long, text string")
    segment.register(spark)
    lateral = lambda f: sorted(map(tuple, spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL {f} c", docs=docs).collect()))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert lateral("chunk_propositions(d.text)") == rows(segment.chunk_propositions(docs))
    assert lateral("chunk_propositions(d.text, 200)") == rows(segment.chunk_propositions(docs, 200))
    assert lateral("chunk_boundary(d.text)") == rows(segment.chunk_boundary(docs))
    assert lateral("chunk_fixed(d.text, 100, 10)") == rows(segment.chunk_fixed(docs, 100, 10))
    assert lateral("text_sections(d.text)") == rows(segment.detect_sections(docs))


def test_rules_are_tried_where_their_literal_stands():
    import re

    assert packs.placed("(?<![a-z])word(?![a-z])") == ("word", 0, 0) and packs.placed("a{1,3}bcd") == ("bcd", 1, 3) and packs.placed("a*bcd|x") is None and packs.placed(".*b") is None
    patterns = ["(?<![a-z])word(?![a-z])", r"^word", r"word$", r"[0-9]{2,4} words?", r"(?:a|b)word", r"\bsword\b", r"x.*word", "ſword", r"(w)ord\1"]
    texts = ["Word", "swords and word", "12 WORD", "12345 words", "aword", "xx word", "ſword", "\nword\n", "İword wordw", "", "foreword: no"]
    machine = packs.Machine(patterns)
    for t in texts:
        assert machine(t) == [i for i, p in enumerate(patterns) if re.search(p, t, re.I)], t
