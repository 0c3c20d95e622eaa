import re
from html import unescape

import numpy as np

from tidewatch.llm import html_text, queries
from tidewatch.llm.common import table
from tidewatch.llm.html_text import main_text

SF = "/root/testdata/sf0.01"


def test_pages_equal_their_article(spark):
    html = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = queries.op6_text_tag_ratio(spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", "").replace("<br>", " "))
        assert r.text == "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
        assert r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, a long notice about them all.</p></div>
{open}<h1>The title &amp; more</h1><p>First   paragraph with <i>mar</i>kup and a <a href=x>link</a>.<p>Short.</p><ul><li>One<li>Two</ul>
<aside>Related: a long line of other things to read</aside><form><p>Join the newsletter now</p><input></form>
<p>A longer closing paragraph &#8212; with\nenough text to be content.</p><div id="comments"><p>Reader: I think this is quite long too, really it is.</p></div>{close}
<div class="sidebar"><p>Most read of the week and other things</p></div><footer>&copy; someone</footer></body>"""
WANT = "The title & more\nFirst paragraph with markup and a link.\nShort.\nOne\nTwo\nA longer closing paragraph — with enough text to be content."


def test_furniture_goes_with_or_without_an_article_element():
    assert main_text(PAGE.format(open="<article>", close="</article>")) == WANT
    assert main_text(PAGE.format(open="<main>", close="</main>")) == WANT
    assert main_text(PAGE.format(open="<div class=content>", close="</div>")) == WANT
    assert main_text(PAGE.format(open="<article>", close="</article><article class=comment><p>Nice text, I read it all.</p></article>")) == WANT


def test_an_article_element_does_not_outvote_the_ratios():
    body = [f"Paragraph {i} of the story, long enough to be the text that the page is made for." for i in range(6)]
    html = "<body><div class=story>" + "".join(f"<p>{p}</p>" for p in body) + "</div><hr><article class=card><h3><a href=x>Next</a></h3><p>Teaser.</p></article></body>"
    assert main_text(html) == "\n".join(body)


STORY = [f"Paragraph {i} of the story, long enough to be the text that the page is made for." for i in range(4)]


def test_the_name_of_a_wrapper_does_not_empty_a_page():
    paragraphs = "".join(f"<p>{p}</p>" for p in STORY)
    for name in ("layout with-sidebar", "has-comments", "nav-open"):
        for tag in ("article", "div"):
            html = f"<body><div class='cookie-notice'><p>We use cookies.</p></div><div class='{name}'><{tag}>{paragraphs}</{tag}><div class=sidebar><p>Most read of the week</p></div></div>"
            assert main_text(html) == "\n".join(STORY)


def test_a_head_without_end_tag_ends_at_the_body():
    paragraphs = "".join(f"<p>{p}</p>" for p in STORY)
    for body in ("<body>", ""):
        assert main_text(f"<html><head><title>T</title><meta charset=utf-8><script>x</script>{body}<div>{paragraphs}</div>") == "\n".join(STORY)


def test_short_paragraphs_in_elements_of_their_own_stay():
    said = [STORY[0] * 3, "Yes.", "No.", "So it was.", "Well.", STORY[1] * 3, "The end."]
    html = "<body><nav><a href=/>Home</a></nav><div id=story>" + "".join(f"<div>{p}</div>" for p in said) + "</div><footer>(c)</footer></body>"
    assert main_text(html) == "\n".join(said)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == main_text("<script>x") == main_text("<!-- c -->") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>a<p>b<article><p>x &lt;b&gt; y") == "x <b> y"
    assert main_text("<article>" + "<p>word</p>" * 5000) == "\n".join(["word"] * 5000)
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_smoothing_and_threshold():
    assert np.allclose(html_text.smooth(np.ones(7)), 1)
    x = np.array([0, 0, 0, 10.0, 0, 0, 0])
    assert html_text.smooth(x).argmax() == 3 and np.allclose(html_text.smooth(x), html_text.smooth(x)[::-1])
    assert 1 < html_text.split_point(np.array([0, 1, 1, 9, 10.0])) < 9


def test_empty_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>hello there"), (1, "u", "<p>hello there"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, "", 0), (1, "hello there", 11), (1, "hello there", 11)]
    assert html_text.extract(df.limit(0)).count() == 0
