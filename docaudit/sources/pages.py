"""Pages as trees of elements: blocks under headings, wherever the markup puts them."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from docaudit.functions.slices import each_text

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "template"}
#: Elements that an opened one ends, if they are the innermost open ones of a list, table or paragraph.
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
INLINE = ("span", "strong", "a", "b", "em", "i")


class Tree(HTMLParser):
    """A page's elements in document order, as columns: tag, parent, last (the element's last descendant) and span, the range of
    `texts` (the pieces of text, stripped, blank ones left out) that it holds. Element 0 is the page."""

    def __init__(self, html: str):
        super().__init__()
        self.tag, self.parent, self.last, self.span, self.texts = ["#page"], [-1], [0], [[0, 0]], []
        self._open, self._unseen, self._run = [0], 0, ""
        self.feed(html)
        self.close()
        self._text()
        self._shut(0)

    def _text(self):
        if piece := self._run.strip():
            self.texts.append(piece)
        self._run = ""

    def _shut(self, depth: int):
        """Ends the open elements from a depth on."""
        self._text()
        for at in self._open[depth:]:
            self.last[at], self.span[at][1] = len(self.tag) - 1, len(self.texts)
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        if self._unseen or tag in UNSEEN:
            self._unseen += tag in UNSEEN
            return
        self._text()
        ends = ENDS.get(tag, {"p"} if tag in BLOCKS else ())
        if self.tag[self._open[-1]] in ends:
            self._shut(len(self._open) - 1)
            if tag == "tr" and self.tag[self._open[-1]] == "tr":
                self._shut(len(self._open) - 1)
        at, n = len(self.tag), len(self.texts)
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.last.append(at)
        self.span.append([n, n])
        if tag not in VOID:
            self._open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self._unseen:
            self._shut(len(self._open) - 1)
        elif tag in UNSEEN:
            self._unseen -= 1

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self._unseen -= self._unseen > 0
        elif not self._unseen:
            depth = next((d for d in range(len(self._open) - 1, 0, -1) if self.tag[self._open[d]] == tag), 0)
            if depth:
                self._shut(depth)

    def handle_data(self, data):
        self._run += "" if self._unseen else data

    def text(self, at: int, joint: str = "") -> str:
        return joint.join(self.texts[self.span[at][0] : self.span[at][1]])

    def climbed(self, at: int, inline: tuple[str, ...]) -> int:
        """The nearest element, itself included, whose tag is not an inline one."""
        while self.tag[at] in inline:
            at = self.parent[at]
        return at

    def following(self, at: int) -> Iterator[int]:
        """The later elements of the same parent."""
        end, at = self.last[self.parent[at]] if at else 0, self.last[at] + 1
        while at <= end:
            yield at
            at = self.last[at] + 1


def article(tree: Tree, start: re.Pattern, heading: re.Pattern, tags: tuple[str, ...], inline: tuple[str, ...], short: int) -> tuple[str, str] | None:
    """Title and text of the first element (of the tags) whose text matches start; see extract_articles."""
    first = next((i for i, tag in enumerate(tree.tag) if tag in tags and start.search(tree.text(i))), None)
    if first is None:
        return None
    first = tree.climbed(first, inline)
    title, rest = tree.text(first, " "), [i for i in tree.following(first)]
    beside = tree.text(rest[0]) if rest else ""
    if len(title) <= short and beside and not re.match(r"\d+\.", beside):
        title += " — " + tree.text(rest[0], " ")
    parts = [tree.text(first, "\n")]
    for i in rest:
        if heading.search(tree.text(i)):
            break
        parts.append(re.sub(r"\n{3,}", "\n\n", tree.text(i, "\n")))
    return title.replace("\n", " "), "\n\n".join(p for p in parts if p)


def extract_articles(pages: DataFrame, start: str, heading: str, tags: tuple[str, ...] = ("p", "span", "div", "h2", "h3"), inline: tuple[str, ...] = INLINE, short: int = 15) -> DataFrame:
    """(page_id, found, title, text), a row for each page: the section whose heading matches start, up to the next heading.

    The first element of the tags whose text (its pieces without anything between) matches start, whatever the case, is the heading,
    or the nearest element around it that is not inline. Its text is the title; one of at most `short` characters is joined
    with the element after it, unless that begins with a number and a point. The section's text is the heading's and that of the
    elements after it under the same parent, up to one that matches `heading`. Open tags are ended as browsers do. Null pages, and
    pages without such a heading: found is false, title and text are null. Scripts and styles count for nothing."""

    def begin():
        opens, stops = re.compile(start, re.I), re.compile(heading, re.I)

        def row(html: str) -> list[tuple]:
            found = article(Tree(html), opens, stops, tags, inline, short)
            return [(found is not None, *(found or (None, None)))]

        return row

    return each_text(pages, "page_id", "html", "found boolean, title string, text string", begin, pages.schema["page_id"].dataType.simpleString())
