"""Sections of pages: golden pages by hand."""

import pytest

from docaudit.sources import pages

GOLDEN = {
    "plain": ("<p>Article 9</p><p>Risk management</p><p>1. A system shall be.</p><p>Article 10</p><p>no</p>", ("Article 9 — Risk management", "Article 9\n\nRisk management\n\n1. A system shall be.")),
    "nested spans": ("<section><p><span><b>Article</b> <span>9</span></span></p><p>Text one</p></section><p>outside</p>", ("Article 9 — Text one", "Article\n9\n\nText one")),
    "first of a block of blocks": ("<div><p>Article 9</p><p>T</p></div><p>U</p>", ("Article 9 T — U", "Article 9\nT\n\nU")),
    "climbs out of inline tags": ("<section><h4><a><span>Article 9 of the act on systems</span></a></h4><p>Body.</p></section>", ("Article 9 of the act on systems", "Article 9 of the act on systems\n\nBody.")),
    "long title": ("<h2>Article 9 Risk management</h2><p>Body</p>", ("Article 9 Risk management", "Article 9 Risk management\n\nBody")),
    "number after a short title": ("<p>Article 9</p><p>1. First rule</p>", ("Article 9", "Article 9\n\n1. First rule")),
    "not another number": ("<p>Article 99</p><p>x</p><p>Article 9</p><p>Right</p>", ("Article 9 — Right", "Article 9\n\nRight")),
    "case and unseen text": ("<style>p{}</style><p>ARTICLE 9</p><script>var t='</p>'</script><p>Kept</p>", ("ARTICLE 9 — Kept", "ARTICLE 9\n\nKept")),
    "open tags": ("<p>Article 9<p>Title<p>One <br> two<ul><li>a<li>b</ul><p>article 10", ("Article 9 — Title", "Article 9\n\nTitle\n\nOne\ntwo\n\na\nb")),
    "empty elements between": ("<p>Article 9</p><p> </p><p>After</p>", ("Article 9", "Article 9\n\nAfter")),
    "next heading nested": ("<p>Article 9</p><p>T</p><div><span>Article 10</span></div><p>no</p>", ("Article 9 — T", "Article 9\n\nT")),
    "many line ends": ("<p>Article 9</p><p>T</p><pre>a\n\n\n\nb</pre>", ("Article 9 — T", "Article 9\n\nT\n\na\n\nb")),
    "stray end tags": ("</div><p>Article 9</b></p></section><p>T</p>", ("Article 9 — T", "Article 9\n\nT")),
    "absent": ("<p>See Article 9</p>", None),
    "empty": ("", None),
    "null": (None, None),
}


def test_golden_pages(spark):
    rows = [(i, html) for i, (html, _) in enumerate(GOLDEN.values())]
    got = pages.extract_articles(spark.createDataFrame(rows, "page_id long, html string"), r"^Article\s*9(?![0-9])", r"^Article\s*\d+(?![0-9])")
    got = {r.page_id: (r.title, r.text) if r.found else None for r in got.collect()}
    for i, (name, (_, want)) in enumerate(GOLDEN.items()):
        assert got[i] == want, name


def test_trees_cover_their_texts():
    tree = pages.Tree("<div>a<p>b<i>c</i></p>d</div><table><tr><td>e<td>f<tr><td>g</table>h")
    assert tree.text(0, "|") == "a|b|c|d|e|f|g|h"
    rows = [i for i, t in enumerate(tree.tag) if t == "tr"]
    assert [tree.text(i, "|") for i in rows] == ["e|f", "g"] and list(tree.following(rows[0])) == [rows[1]]
    for i in range(1, len(tree.tag)):
        a, b = tree.span[i]
        c, d = tree.span[tree.parent[i]]
        assert c <= a <= b <= d and i <= tree.last[i] <= tree.last[tree.parent[i]]


def test_very_deep_and_very_long_pages():
    deep = pages.Tree("<div>" * 5000 + "<p>Article 9</p><p>T</p>")
    assert deep.text(0, " ") == "Article 9 T" and deep.climbed(1, ("div",)) >= 0


@pytest.mark.parametrize("n", [0, 3])
def test_tables_of_pages(spark, n):
    df = spark.createDataFrame([(i, "<p>x</p>") for i in range(n)], "page_id long, html string")
    assert pages.extract_articles(df, "^x", "^y").where("found").count() == n
