"""Main text of pages."""

import pytest

from quire.llm.html import Page, extract_text

CASES = [
    ("", ""),
    ("plain &amp; simple\n text", "plain & simple text"),
    ("<article><h1>T&eacute;</h1><p>a\n b<b>c</b>d<p>e<br>f</article><footer>x</footer>", "Té a bcd e f"),
    ("<body><header>H</header><nav>n</nav><main><p>one</p><aside>s</aside><p>two</main>", "one two"),
    ("<div id=main-content class=with-sidebar><article class=post><header><h1>T</h1></header><p>x</p><div class='ad box'>buy</div></article></div>", "T x"),
    ("<article>a<section id=comments><article class=comment>nice</article></section></article>", "a"),
    ("<article>a<script>var t='</p>'</script><style>p{}</style><!-- c > --><form>f<p>g</form>b</article>", "a b"),
    ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "x y 1 2 3"),
    ("<p>a<div style='display: none'>h</div><span hidden>i</span>b<p class=cookie-notice>c", "a b"),
    ("<article>1 &lt; 2 <b title='>'>b</b> &#x41;&nbsp;z</b></i></article>", "1 < 2 b A z"),
    ("<article>unclosed <b>bold <i>it", "unclosed bold it"),
    ("<script>never ends", ""),
    ("<" * 50 + "a", "<" * 50 + "a"),
]


@pytest.mark.parametrize("source, wanted", CASES)
def test_text(source, wanted):
    assert Page(source).text() == wanted


def test_long_and_deep_pages():
    assert Page("<div>" * 20_000 + "x" + "</div>" * 20_000).text() == "x"
    assert Page("<article>" + "<p>word " * 20_000).text() == " ".join(["word"] * 20_000)


def test_templates_of_a_site_go_and_articles_stay(spark):
    box, quote = "<div><span>Read our terms</span></div>", "<p>A passage that many articles quote word by word.</p>"
    pages = [(i, f"https://A.example/{i}", f"<div class=x>{box}<div><p>Story number {i} is told here at some length.</p>{quote}</div>") for i in range(20)]
    pages += [(100 + i, f"http://b.example/{i}", f"<article>{box}<p>Other {i} text that is long enough for all of it.</p>{quote}</article>") for i in range(20)]
    pages += [(200, "http://c.example/", box + "<p>rare words on a site of its own</p>"), (201, None, box), (202, "not a url %%", None), (203, "", ""), (200, "http://c.example/", box + "<p>rare words on a site of its own</p>")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract_text(frame).collect()}
    assert got[3] == "Story number 3 is told here at some length."
    assert got[103] == "Other 3 text that is long enough for all of it. A passage that many articles quote word by word."
    assert got[200] == "Read our terms rare words on a site of its own"
    assert got[201] == "Read our terms" and got[202] == got[203] == ""
    assert extract_text(frame).count() == len(pages)
    assert extract_text(frame.where("false")).count() == 0


@pytest.mark.parametrize("mark", ["article", "div"])
def test_copies_of_a_page_are_no_templates(spark, mark):
    notice = "<div><span>Read our terms</span></div>"
    body = lambda i: f"<h2>Title {i}</h2><ul><li>first point {i}<li>second point {i}</ul><table><tr><td>cell {i}<td>more {i}</table><p>And paragraph {i} ends it.</p>"
    pages = [(i, f"https://a.example/{i}", f"<{mark}>{body(i)}{notice}</{mark}>") for i in range(12)]
    pages += [(100 + i, f"https://a.example/copied?variant={i}", f"<{mark}>{body(77)}{notice}</{mark}>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    wanted = "Title {0} first point {0} second point {0} cell {0} more {0} And paragraph {0} ends it."
    assert got == {i: wanted.format(i if i < 100 else 77) for i in got} and len(got) == 24


def test_containers_of_flow_inside_an_article_stay(spark):
    quoted = "<ul><li>quoted one<li>quoted two</ul><section><h2>Same</h2><p>words</p></section>"
    boxes = "<div><span>Read our terms</span></div><div>Menu<nav><ul><li>home</ul></nav></div>"
    pages = [(i, f"https://a.example/{i}", f"<article><p>Story number {i} is told here at some length.</p>{quoted}{boxes}</article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Story number {i} is told here at some length. quoted one quoted two Same words" for i in range(12)}
