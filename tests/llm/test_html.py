import re

import pytest

from swipewatch.llm.html import extract, main_text, op7_html_extraction

CASES = {
    "": "", "plain words": "plain words", "<p>a</p>": "a", "<p>a<p>b<br>c<li>d": "a\nb c\nd", "<p>x &amp; y &lt;b&gt; &eacute;&#233;&nbsp;&#x41;</p>": "x & y <b> éé A",
    "<p>a<!-- <p>no</p> -->b</p><script>var t='</p>';</script><style>p{}</style>": "ab", "<p>in<b>li</b>ne <i>a</i></p>": "inline a", "<P CLASS=x>  a \n\t b  </P>": "a b",
    "<nav>menu here</nav>": "", "<article><p>One.</p><form><label>your mail</label></form><aside>see also</aside><p>Two.</p></article>": "One.\nTwo.",
    '<div class="ad">buy buy buy buy</div><article><header><h1>T</h1></header><p>Of.</p></article><div class="comments"><p>so good so good so good</p></div>': "T\nOf.",
    '<p hidden>h</p><p style="display: none">n</p><p>seen</p>': "seen", "<p>a < b and c > d</p>": "a < b and c > d", "<p>cut off &am": "cut off &am", "<p title='x > y'>quoted</p>": "quoted", "<p>never <b closed": "never",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert main_text(page) == CASES[page]


@pytest.mark.parametrize("page", [
    '<body><div id="header"><a href="/">Brand name here</a></div><div class="menu"><ul><li><a>One</a></li><li><a>Two</a></li></ul></div><div class="content">{}</div><div id="sidebar"><p>many words in the side bar, more than in the text</p></div><div id="footer">the rights and all</div></body>',
    '<body><header><h2>Site of the year</h2></header><div class="cookie-notice">we use cookies, all of them, all the time</div><main>{}</main><section class="comments"><div>first!</div><div>second, longer than the first</div></section><footer>x</footer>',
    '<nav role="navigation"><a>a</a></nav><div><div>{}</div></div><form><p>write to us here today</p></form><div class="newsletter">get mail</div>',
])
def test_layouts(page):
    assert main_text(page.replace("{}", "<h1>Head</h1><p>Short.</p>\n<p>Two  words</p>")) == "Head\nShort.\nTwo words"


def test_text_behind_letters_whose_lower_case_is_longer():
    page = "<p>" + "İ" * 12 + "<script>x</script>kept words here<p>more"
    assert main_text(page) == "İ" * 12 + "kept words here\nmore"
    assert main_text("<p>a<SCRIPT>no</ſcript>no</sCrIpT >b<style>p{}</styles></style>c") == "abc"


def test_formulas_and_what_players_show_instead_stay_in_an_article():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p><noscript><p>Read on.</p></noscript><p>A <canvas>chart</canvas> and <object>a map</object>, <video>a film</video>.</p><svg><text>no</text></svg></article>"
    assert main_text(page) == "So x=2 holds.\nRead on.\nA chart and a map, a film."


@pytest.mark.parametrize(("make", "least"), [
    (lambda n: "<div>" * n + "</b>" * 2 * n + "deep words", 1), (lambda n: "<b>" * n + "<p>x" * n, 1), (lambda n: "<svg>" * n + "words", 1), (lambda n: "<li>a" * n, 1), (lambda n: "<p>" + "<a href='" * n + "words", 0)])
def test_time_grows_in_proportion(make, least):
    import time

    def seconds(n):
        page = make(n)
        best = 9e9
        for _ in range(3):
            began = time.perf_counter()
            found = main_text(page)
            best = min(best, time.perf_counter() - began)
        assert len(found) >= least
        return best

    assert seconds(16_000) < 10 * seconds(4_000) + 0.05


@pytest.mark.parametrize("page", [
    '<html><body><table><tr><td class="navbar"><a>Start</a></td><td id="story">{}</td></tr></table><div class="legal footer">all rights</div></body></html>',
    '<body><div class="topbar header"><p>Daily news of the town</p></div><section role="main">{}<div class="promo banner">subscribe now and save</div></section><section class="replies comments"><p>I do not agree with this at all</p></section></body>',
    '<body><aside class="widget"><p>Read this too, it is long and good</p></aside><div id="page"><div id="main-content">{}</div></div><div class="cookie consent"><p>We value your privacy very much</p></div></body>',
])
def test_layouts_that_no_weight_was_learned_from(page):
    assert main_text(page.replace("{}", "<h1>Head</h1><p>Short.</p>\n<p>Two <code>x = 1</code> words</p>")) == "Head\nShort.\nTwo x = 1 words"


def test_query_equals_known_template(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html

    out = op7_html_extraction(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        article = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_tables(frame):
    rows = [(1, "u", None, 0), (1, "u", None, 0), (None, None, "", 1), (2, "v", "<p>" + "word " * 100_000, 2), (3, "w", "<div>" * 3000 + "deep", 3)]
    out = extract(frame(rows, "page_id long, url string, html string, Text int"), columns=["page_id", "url", "Text"])
    assert out.columns == ["page_id", "url", "Text", "_text", "n_chars"]
    assert sorted((r.Text, r.n_chars) for r in out.collect()) == [(0, 0), (0, 0), (1, 0), (2, 499_999), (3, 4)]
    assert extract(frame([], "html string")).count() == 0
