"""Main text of pages, against a plain reading of the given pages and expectations written by hand."""

import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from intervale.llm.line_blocks import extract, kept_span, main_text
from intervale.llm.queries import op13_main_text

SF = "/root/testdata/sf0.001"


class Articles(HTMLParser):
    """Text of article elements, a line a block: slow, and enough for pages that mark their article and nest nothing in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("article", "p", "h1"):
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.lines.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)


def plainly(page):
    reader = Articles()
    reader.feed(page or "")
    reader.close()
    return reader.text()


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op13_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plainly(pages[r.page_id].html), len(r.text))


WORDS = "The river rose by two metres over night and the lower town was cut off until the morning."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("just text", "just text"),
        ("<nav>a b c</nav><footer>&copy; x</footer>", ""),
        ("<p>Caf&eacute; &amp;amp; &#x2014; &am &ampx a&nbsp;&nbsp;b</p>", "Café &amp; — &am &x a b"),
        ("<p>a < b, c <3 d</p>", "a < b, c <3 d"),
        ("<p>one\n\t two<br>three <b>fo</b>ur</p><p></p><p>five", "one two three four\nfive"),
        ("<script>if (a < b) document.write('<p>no</p>')</script><STYLE>p{}</STYLE ><p>yes<!-- <p>no --><!----> still", "yes still"),
        (f"<p>{WORDS}<script>never closed <p>no", WORDS),
        (f'<body><div class="sidebar">{WORDS}</div><div><h1>Flood</h1><p>{WORDS}</div><div id="footer">{WORDS}</div>', f"Flood\n{WORDS}"),
        (f'<body class="has-sidebar"><div class="cookie-notice">We use cookies</div><p>{WORDS}', WORDS),
        (f"<main><header><h1>A</h1></header><p>{WORDS}<div class='comments'><p>Nice!</div><p>d</main><p>not this", f"A\n{WORDS}\nd"),
        ("<article>One<section id=comments><article>Reply</article></section><article>Reply</article>two<footer>tags</footer></article>", "One\ntwo"),
        ("<article><p><a href=/x>All linked</a></p></article><p>outside, and much longer than what is inside of it", "All linked"),
        ("<ul><li><a href=1>First</a><li><a href=2>Second</a></ul>" + f"<p>{WORDS}</p>" + "<ul><li><a href=3>Third</a></ul>", f"First\nSecond\n{WORDS}\nThird"),
        ("<div><ul><li><a href=1>First</a></ul></div><div></div><div></div>" + f"<p>{WORDS}</p>", WORDS),
        ('<div hidden>no</div><div style="display: none">no</div><p title="a > b">yes', "yes"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ('<form><input><button>Send</button><select><option>x</select><textarea><p>t</textarea></form><p>x', "x"),
        ('<p class="ad">buy<p>read', "read"),
        ("<article><p>x</p>", "x"),
        ('<p>open <a href="x>never closed', "open never closed"),
    ],
)
def test_by_hand(page, text):
    assert main_text(page) == text


def test_spans():
    assert kept_span([]) == kept_span([0, 0]) == (0, 0)
    assert kept_span([1]) == (0, 1)
    first, last = kept_span([5, 0, 0, 0, 3, 90, 2, 0, 0, 0, 0, 4])
    assert (first, last) == (2, 9)  # empty lines of the windows at either end come along


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='ad'>", "<div>", "</div>", "<li>", "<td>", "<a href='", "'>", '"', "<", ">", "</", "<!--", "-->", "<script>", "</script>", "word ", "&amp;", "&", "\x00", "é"]), max_size=60))
def test_any_markup(pieces):
    text = main_text("".join(pieces))
    assert text == "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


@pytest.mark.parametrize("piece", ["<p><b>", "<div>", "<p>a ", '<a "', "<table><b><p>x</p>", "<!--", "<script>", "</b></p>", "<a><li>x", "&amp", "<b>", "<i class='"])
def test_linear_on_long_pages(piece):
    began = time.process_time()
    main_text(piece * (400_000 // len(piece)))
    assert time.process_time() - began < 8


def test_rows_of_any_kind(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, None), (2, "v", "<p>" + "long words " * 200_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `n.o te` string").repartition(3)
    got = sorted(((r.page_id or 0), r.n_chars, r["n.o te"]) for r in extract(pages).collect())
    assert got == [(0, 0, None), (1, 1, "x"), (1, 1, "x"), (2, 11 * 200_000 - 1, "y")]
    assert extract(pages.limit(0)).collect() == []
    with pytest.raises(ValueError):
        extract(pages.withColumnRenamed("url", "Text"))
    assert re.search("text", str(extract(pages.withColumnRenamed("url", "Text"), text_name="main", length_name="size").columns), re.I)
