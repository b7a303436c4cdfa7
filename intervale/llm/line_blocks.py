"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one a block element.  A line's weight is its number
of visible characters outside links; regions that never hold an article (menus,
headers, footers, asides, adverts, notices, forms, comments, ...) leave lines of
weight zero.  The sums of weights over sliding windows of ``WINDOW`` lines rise
at surge points and fall to zero at dive points, and the text from the first
surge to the last dive is kept.  Where a page marks its article, only lines of
the article have weight.

One pass over each page, in time linear in its length, page by page: nothing is
shuffled, and a lost task is done again from its input rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervale.llm.runtime import prepare

WINDOW = 3
#: A window of so many visible characters outside links is a surge; on a page that has none, its fullest one is.
SURGE = 50

# Names that the HTML standard gives, and words that sites commonly put into class, id and role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("article aside body dialog div fieldset footer form header main nav section table".split())
SPACED = frozenset("br td th img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("nav footer aside form button select noscript template svg canvas audio video object dialog menu datalist search".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promotion promotions "
    "recommended recommendations related respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar tooltip topbar widget widgets".split()
)
#: Of these, a name that also speaks of the article is the article's own ("entry-header"); names that begin so say what a page has, not what an element is.
HEADERS, OWN, SAYS = frozenset(["header"]), frozenset("article content entry main post story".split()), frozenset("has is no not with without".split())
ARTICLE_HINTS = frozenset("ad advert comment promo related sponsored teaser".split())
MAIN_NAMES = frozenset("article-body article-content content entry-content main main-content post-content story-body".split())

#: What a start tag ends if it is open and only inline elements are in between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
COMMENT_END = re.compile(r"--!?>")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PLAIN, MAIN, ARTICLE, GONE = 0, 1, 2, 3


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _hinted(names: list[str], in_article: bool) -> bool:
    """Whether one of the names of class and id is that of a region without article text."""
    for name in names:
        pieces = [p.lower() for p in PIECES.findall(name)]
        if not pieces or pieces[0] in SAYS:
            continue
        found = set(pieces)
        if found & HINTS or (found & HEADERS and not in_article and not found & OWN):
            return True
    return False


def _level(tag: str, source: str, level: int) -> int:
    """Level of an element within one of the given level: plain, main part, article, or gone."""
    if tag in DROPPED or (tag == "header" and level == PLAIN) or (tag == "article" and level == ARTICLE):  # an article's article is a comment
        return GONE
    found = _attributes(source) if "=" in source or "hidden" in source else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return GONE
    if tag in ("html", "body", "main"):
        return max(level, MAIN) if tag == "main" or role == "main" else level
    if tag == "article":
        return GONE if ARTICLE_HINTS & {n.lower() for n in names} else ARTICLE
    if role in DROPPED_ROLES or (names and tag not in INLINE and _hinted(names, level == ARTICLE)):
        return GONE
    if role == "main" or "articlebody" in found.get("itemprop", "").lower() or any(n.lower() in MAIN_NAMES for n in names):
        return max(level, MAIN)
    return level


class _Lines:
    """Lines of a page: text, weight, and the level of the region."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.weights: list[int] = []
        self.levels: list[int] = []
        self.parts: list[str] = []
        self.linked = 0

    def add(self, text: str, in_link: bool) -> None:
        self.parts.append(text)
        if in_link:
            self.linked += _visible(text)

    def end(self, level: int) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self._put(text, _visible(text) - self.linked, level)
        self.parts, self.linked = [], 0

    def gap(self, size: int) -> None:
        """So many empty lines, of which no more than a window's are kept in a row."""
        for _ in range(size):
            if self.weights[-WINDOW:] != [0] * WINDOW or any(self.texts[-WINDOW:]):
                self._put("", 0, PLAIN)

    def _put(self, text: str, weight: int, level: int) -> None:
        self.texts.append(text)
        self.weights.append(weight)
        self.levels.append(level)


def _visible(text: str) -> int:
    return sum(map(len, text.split()))


def lines_of(page: str) -> _Lines:
    """Strip a page's markup; what lies in regions without article text is left out and leaves a gap."""
    out = _Lines()
    stack: list[tuple[str, int, int]] = []  # open elements, the level within each, and the place of the last one up to it that isn't inline
    open_count: dict[str, int] = defaultdict(int)
    level, at, size = PLAIN, 0, len(page)

    def close(to: int) -> None:
        """Close open elements until ``to`` are left."""
        nonlocal level
        while len(stack) > to:
            name, within, _ = stack.pop()
            open_count[name] -= 1
            level = stack[-1][1] if stack else PLAIN
            if name in BLOCKS:
                out.end(within)
            if within == GONE != level:
                out.gap(WINDOW)
            elif name in CONTAINERS:
                out.gap(1)

    def implied(tag: str) -> None:
        ends = ENDS.get(tag) or (("p",) if tag in BLOCKS else ())
        while any(open_count[e] for e in ends):
            k = stack[-1][2]
            if k < 0 or stack[k][0] not in ends:
                break
            close(k)
        if tag in ENDS and tag in BLOCKS and open_count["p"]:
            implied("p")

    while at < size:
        less = page.find("<", at)
        stop = size if less < 0 else less
        if stop > at and level != GONE:
            out.add(unescape(page[at:stop]), open_count["a"] > 0)
        if less < 0:
            break
        tag = TAG.match(page, less)
        if tag is None:
            after = page[less + 1 : less + 2]
            if page.startswith("<!--", less):
                # "<!-->" and "<!--->" are whole comments; one without an end takes the rest of the page.
                whole = re.compile(r"<!---?>").match(page, less)
                end = whole or COMMENT_END.search(page, less + 4)
                at = end.end() if end else size
            elif after in ("!", "?", "/") or (after.isascii() and after.isalpha()):
                end = page.find(">", less)
                at = end + 1 if end >= 0 else size
            else:
                if level != GONE:
                    out.add("<", open_count["a"] > 0)
                at = less + 1
            continue
        at = tag.end()
        closing, name, source = tag[1], tag[2].lower(), tag[3]
        if closing:
            if open_count[name]:
                k = len(stack)
                while stack[k - 1][0] != name:
                    k -= 1
                close(k - 1)
            elif name == "p" and level != GONE:
                out.end(level)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            close_at = page.find(">", end.end()) if end else -1
            at = close_at + 1 if close_at >= 0 else size
            continue
        implied(name)
        if name in BLOCKS:
            out.end(level)
        elif name in SPACED and level != GONE:
            out.add(" ", False)
        if name in VOID or (source.endswith("/") and name in ("svg", "path", "math")):
            continue
        within = GONE if level == GONE else _level(name, source, level)
        if name == "main" and level == GONE:  # a wrapper named after something that it holds besides
            within = MAIN
        if within == GONE != level:
            out.end(level)
        elif name in CONTAINERS and within != GONE:
            out.gap(1)
        solid = len(stack) if name not in INLINE else stack[-1][2] if stack else -1
        stack.append((name, within, solid))
        open_count[name] += 1
        level = within
    close(0)
    out.end(PLAIN)
    return out


def kept_span(weights: list[int], surge: int = SURGE) -> tuple[int, int]:
    """From the first surge to the last dive: lines [first, last) of which the windows hold text.

    A surge is a window at least as full as ``surge``, or as the fullest one.  The
    span grows from there as long as windows hold any text, so short lines at
    either end of an article are its own.
    """
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    blocks = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    fullest = max(blocks, default=0)
    if not fullest:
        return 0, 0
    surges = [i for i, b in enumerate(blocks) if b >= min(surge, fullest)]
    first, last = surges[0], surges[-1]
    while first and blocks[first - 1]:
        first -= 1
    while last + 1 < n and blocks[last + 1]:
        last += 1
    return first, min(n, last + WINDOW)


def main_text(page: str | None) -> str:
    """Text of a page's article, a line a block; null and pages without text give the empty text."""
    if not page:
        return ""
    lines = lines_of(page)
    best = max((level for level, text in zip(lines.levels, lines.texts, strict=True) if text), default=PLAIN)
    if best > PLAIN:  # a marked article: each of its lines has weight, links or not, and each is a surge
        first, last = kept_span([len(text) if level >= best else 0 for text, level in zip(lines.texts, lines.levels, strict=True)], surge=1)
    else:
        first, last = kept_span(lines.weights)
    return "\n".join(t for t, level in zip(lines.texts[first:last], lines.levels[first:last], strict=True) if t and level >= best)


def extract(pages: DataFrame, *, html_col: str = "html", text_name: str = "text", length_name: str = "n_chars") -> DataFrame:
    """The pages without their html, with its main text and that text's number of code points.

    A row for each page, repeated ones too; null counts as empty.  The two new
    names must not be those of other columns.
    """
    prepare(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name.lower() != html_col.lower()]
    if {text_name.lower(), length_name.lower()} & {f.name.lower() for f in kept}:
        raise ValueError(f"{text_name} and {length_name} must be new names; rename or drop the columns of these names")
    schema = T.StructType([*kept, T.StructField(text_name, T.StringType(), False), T.StructField(length_name, T.LongType(), False)])

    def work(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(kept))]
            columns = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(columns, [f.name for f in schema.fields])

    rows = pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{html_col}`").cast("string"))
    return rows.toDF(*(f"_c{i}" for i in range(len(kept) + 1))).mapInArrow(work, schema)  # names with dots are none for mapInArrow
