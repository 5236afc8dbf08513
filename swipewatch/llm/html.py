"""HTML extraction by a maximum-scoring subsequence.

A page is a row of words and tags. Words score positive and tags negative, with weights learned from labelled pages: how much more often a
tag, or a name in an element's attributes, stands inside the main text than outside. One linear scan finds the best contiguous region; what
lies in it but in elements of a boilerplate kind (an advert in an article, a form, the comments) is left out; such elements weigh nothing
inside an article, which they interrupt but do not end.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

# Elements by their role in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "svg", "annotation", "annotation-xml", "select", "head")
#: Of these, what stands within a line and does not end it.
UNSEEN = frozenset("script style template svg annotation annotation-xml iframe textarea select noembed".split())
MATH = frozenset("math mfrac mi mn mo mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder mover munderover semantics".split())
INLINE = MATH | frozenset("audio canvas object picture video a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul dl".split())

#: Labelled pages the weights are learned from: between [[ and ]] is main text. They stand for kinds of layout, not for any site.
LABELLED = (
    '<html><head><title>t</title></head><body><header class="site-header"><div class="logo">Site</div><nav class="main-menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav></header><article>[[<h1>A title</h1><p>First words of it.</p><p>More <b>words</b> and <a href="/x">a link</a>.<br></p>]]</article><aside class="sidebar widget"><h3>Popular</h3><ul><li><a href="/1">One</a></li></ul></aside><footer>Rights</footer></body></html>',
    '<html><body><div id="cookie-banner" class="cookie consent notice">We use cookies <button>OK</button></div><nav role="navigation"><a href="/">Home</a></nav><div class="ad">Buy now</div><main role="main">[[<article class="post"><h1>Head</h1><p>Text text.</p><blockquote>Said so.</blockquote><ul><li>point one</li><li>point two</li></ul></article>]]</main><section id="comments" class="comments comment-list"><div class="comment">Nice one</div></section><footer class="footer" role="contentinfo"><p>Imprint</p></footer></body></html>',
    '<html><body><div id="header" class="header top-bar"><a href="/">Brand</a></div><div id="menu" class="menu navbar"><ul><li><a>Start</a></li></ul></div><div id="content" class="content entry-content">[[<h2>Head</h2><p>Long text here.</p><pre>code</pre><table><tr><td>cell</td><th>head</th></tr></table>]]<div class="share social">Share this</div><div class="related-posts related">Read next</div></div><div id="sidebar">Tags</div><div id="footer" class="copyright">2020</div></body></html>',
    '<html><body><div class="advert advertisement sponsored promo banner">Offer</div><div class="breadcrumb breadcrumbs">Home / News</div><div class="article-body story">[[<h1>Head</h1><h3>Part</h3><p><em>Words</em> <i>and</i> <strong>words</strong> <span>again</span>.</p><figure><figcaption>Seen here.</figcaption></figure><ol><li>step</li></ol>]]</div><form class="newsletter subscribe signup search"><label>Mail</label><button>Go</button></form><div class="popup modal overlay">Join</div><div class="pagination pager">1 2 3</div><div class="ads adsbox">Ad</div></body></html>',
    '<html><body><div role="banner">Top</div><div role="search"><form>Find</form></div><section>[[<p>Plain words.</p><dl><dt>term</dt><dd>sense</dd></dl><hr><h4>More</h4><p>Words <code>x</code> <sup>2</sup>.</p>]]</section><aside>Side</aside><div role="complementary">More</div><div class="disqus replies">Me too</div><div class="alert warning">Note</div><div class="toolbar skip-link">Skip</div><nav>End</nav><dialog>Ask</dialog><menu><li>Cut</li></menu><footer>Foot</footer></body></html>',
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAMES = re.compile(r"[a-z]+")


def tokens(page: str):
    """(kind, value): "text" and its characters, "open" and (tag, names of its attributes, hidden), "close" and the tag, comments left out."""
    at, unclosed = 0, set()
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:]
            return
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield "text", html.escape(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag
            continue
        names, hidden = set(), False
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id", "role"):
                    names.update(_NAMES.findall(value))
                else:
                    hidden |= key == "hidden" or key == "style" and bool(_HIDDEN.search(value)) or value == "true"
        if tag in RAW:
            closing = None if tag in unclosed else _closing(tag).search(page, at)
            end = closing.start() if closing else -1
            if end < 0:
                unclosed.add(tag)  # so that it is not looked for again
            if end < 0 and tag not in ("script", "style", "textarea", "title", "iframe", "xmp"):  # never closed: skip only the tag
                continue
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
            yield "open", ("img" if tag in UNSEEN else "hr", frozenset(), False)
            continue
        yield "open", (tag, frozenset(names), hidden)


@cache
def _closing(tag: str) -> re.Pattern:
    """The end tag of an element whose content is no markup; letters of either case, but of ASCII alone."""
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A)


@cache
def weights() -> tuple[dict, dict]:
    """Log odds of standing in the main text: of tags, opened or closed, and of kinds of elements, by the words below them."""
    tag_in, tag_out, kind_in, kind_out = Counter(), Counter(), Counter(), Counter()
    for page in LABELLED:
        inside, stack = False, []
        for what, value in tokens(page):
            if what == "text":
                for part in re.split(r"(\[\[|\]\])", value):
                    if part in ("[[", "]]"):
                        inside = part == "[["
                        continue
                    for kinds in stack:
                        for k in kinds:
                            (kind_in if inside else kind_out)[k] += len(part.split())
                continue
            tag = value if what == "close" else value[0]
            (tag_in if inside else tag_out)[tag] += 1
            if what == "open" and tag not in VOID:
                stack.append([tag, *value[1]])
            elif what == "close":
                while stack and stack.pop()[0] != tag:
                    pass
    odds = lambda a, b, k: math.log((a[k] + 0.5) / (b[k] + 0.5))
    return {k: odds(tag_in, tag_out, k) for k in tag_in | tag_out}, {k: odds(kind_in, kind_out, k) for k in kind_in | kind_out}


def _boilerplate(tag: str, names: frozenset, hidden: bool, in_main: bool) -> bool:
    """Whether an element's own kind speaks against it; of several names the most telling counts."""
    if hidden:
        return True
    kinds = weights()[1]
    if tag == "header" and in_main:  # the head of an article, not of the page
        return False
    if tag in ("article", "main", "body", "html"):
        return False
    own = kinds.get(tag, 0.0)
    if own < -0.5 and tag not in ("div", "ul", "ol", "li", "a", "h3", "section", "label", "p", "span"):
        return True
    seen = [kinds[n] for n in names if n in kinds and n not in ("div", "a", "p", "post", "top", "list", "main", "entry", "content", "article", "body", "story")]
    return bool(seen) and min(seen) < -0.5 and max(seen) <= 0.5


def main_text(page: str | None) -> str:
    """Blocks of the main text, one a line; the empty text if there is none. Time and memory grow in proportion to the page, however deeply its
    elements are nested and however many end tags have no beginning."""
    if not page:
        return ""
    tag_weights = weights()[0]
    stack: list[tuple[str, bool]] = []  # tag, and whether it or an element around it is boilerplate
    items: list[tuple[float, str | None]] = []  # score, and text or None for a tag; "" divides blocks
    depth_main = 0
    opened: Counter = Counter()  # open elements by tag, so that only end tags and openings that close something search the stack

    def pop(n: int):
        nonlocal depth_main
        for tag, _ in stack[n:]:
            depth_main -= tag in ("article", "main")
            opened[tag] -= 1
        del stack[n:]

    def price(tag: str) -> float:
        return -0.05 - 0.5 / (1 + math.exp(2 * tag_weights.get(tag, 0.0)))

    for what, value in tokens(page):
        bad = bool(stack) and stack[-1][1]
        if what == "text":
            decoded = html.unescape(value)
            n = len(decoded.split())
            items.append((-n * (0.0 if depth_main else 0.5) if bad else float(n), None if bad else decoded))
            continue
        tag = value if what == "close" else value[0]
        if what == "open":
            if tag in CLOSES_P or tag in CLOSES_SELF:
                closing = CLOSES_SELF.get(tag, ("p",))
                for k in range(len(stack) - 1, -1, -1) if any(opened[c] > 0 for c in closing) else ():
                    if stack[k][0] in closing:
                        pop(k)
                        break
                    if stack[k][0] in SCOPES:
                        break
            inner = bool(stack) and stack[-1][1] or _boilerplate(tag, value[1], value[2], depth_main > 0)
            if tag not in VOID:
                stack.append((tag, inner))
                opened[tag] += 1
                depth_main += tag in ("article", "main")
            bad = inner
        elif opened[tag] > 0:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    bad = stack[k][1]
                    pop(k)
                    break
        items.append((price(tag) * (1 if not bad else 0 if depth_main else 2), " " if tag == "br" else None if tag in INLINE else ""))

    best = total = 0.0
    region, start = (0, 0), 0
    for i, (score, _) in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    blocks, now = [], []
    for _, text in [*items[region[0] : region[1]], (0, "")]:
        if text == "":
            if block := " ".join("".join(now).split()):
                blocks.append(block)
            now = []
        elif text is not None:
            now.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, page: str = "html", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all) of ``pages`` with ``text`` and its length in code points, ``n_chars``; null pages have an empty text. Repeated rows
    are kept, an empty table has no result; a page is held by its task as a whole. Where a name is taken the new one gets underscores in front."""
    kept = pages.columns if columns is None else columns
    rows = pages.select(F.col(page).alias("_page"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_t", T.StringType()), T.StructField("_n", T.LongType())])

    def extracted(batches):
        for batch in batches:
            got = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], schema.fieldNames())

    base = pages.select(*kept)
    return rows.mapInArrow(extracted, schema).toDF(*kept, free_name(base, "text"), free_name(base, "n_chars"))


def op7_html_extraction(spark, sf_dir):
    from .common import table

    return extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
