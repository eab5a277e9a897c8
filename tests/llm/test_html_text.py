import html
import random
import re
import time

from odd import SF, table
from pyspark.sql import functions as F

from loanlens.llm import html_text as ht

LONG = "This sentence of the article goes on for a while, so that it has weight. " * 3


def main(source, winning=None):
    return ht.main_text(source, winning)[0]


def squash(text):
    return " ".join(text.split())


def test_parts_beside_the_article_are_left_out():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>{LONG}</p></div>
    <div class="layout"><article class="post post-17"><h1>The title &amp; more</h1>
    <p>{LONG}<p>A second&nbsp;paragraph<br>with a <b>bold</b> <a href="x>y">link</a>.
    <div class=ad>Buy now</div><aside><p>Aside</p></aside><form><input value=x><p>Mail</p></form>
    <script>var t = "</p><p>no";</script><ul><li>One<li>Two</ul><table><tr><td>a<td>b<tr><td>c</table>
    <!-- a comment <p>hidden</p> --><p hidden>gone</p>
    <section class="comments"><h2>3 comments</h2><p>{LONG}</p></section></article></div>
    <footer>&copy; Site</footer></body></html>"""
    assert main(page) == "\n".join(["The title & more", squash(LONG), "A second paragraph with a bold link.",
                                    "One", "Two", "a b", "c"])
    assert ht.vote(page) == "/html/body/div.layout/article.post.post-#"


def test_articles_without_an_article_element():
    page = (f"<body><div class=top><a href=/>Home</a> <a href=/b>News</a></div><div class='content main'><h1>T</h1>"
            f"<div class=text><p>{LONG}</p><p>{LONG}</p></div></div><div class=links><a href=/c>{LONG}</a></div></body>")
    assert main(page) == "\n".join(["T", squash(LONG), squash(LONG)])
    two = (f"<body><div id=x><div class=s1><p>{LONG}</p></div><div class=s2><p>{LONG}{LONG}</p></div></div>"
           f"<div class=foot>Contact</div></body>")
    assert main(two) == "\n".join([squash(LONG), squash(LONG + LONG)])


def test_wrappers_named_like_other_parts():
    page = (f"<body class='home sidebar'><form id=aspnetForm><div class='has-sidebar'><div class=comments><article>no</article>"
            f"</div><main class=x><p>{LONG}</p></main></div></form><p>after</p></body>")
    assert main(page) == squash(LONG)


def test_broken_markup_and_references():
    assert main("") == ""
    assert main("plain text, a < b & c &lt;d&gt; &am &#233;&#xe9;") == "plain text, a < b & c <d> &am éé"
    assert main("<p>one<p>two</div></b><p>three <b>bold") == "one\ntwo\nthree bold"
    assert main("<p>kept</p><div cla") == "kept"
    assert main("<p>kept</p><!-- never closed") == "kept"
    assert main("<p>a</p><script>never closed") == "a"
    assert main('<p title="a>b" data-x=\'>\'>x</p><p class="unclosed>y</p>') == "x\ny"
    assert main("<p>x</p></ p><?php y ?><![CDATA[z]]><p>w") == "x\nw"
    assert main("<P>A</P><DIV CLASS=AD>B</DIV><SCRIPT>c</sCRIPT><P>D") == "A\nD"
    assert main("a\r\n\t b c") == "a b c"


def test_any_page_is_read_in_linear_time():
    begin = time.time()
    n = 60_000
    for part in ("<a <", "<p>", "</p>", "<div>", '<a b="', "<a b='", "<!--", "<b>", "<!", "</", "<li>x", "<script>", "<td>", "&amp;",
                 "<p><b>", "<table><b><p>", "<div class='x'><p>y", "<title>"):
        ht.main_text(part * n, ["/x"])
    assert time.time() - begin < 60


def test_random_soup_never_fails():
    rng = random.Random(2)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</td>",
            "</table>", "<a href='x'>", "</a>", "<br>", "<script>", "</script>", "<!--", "-->", "text ", "&amp;", "<", ">", '"',
            "<article>", "</article>", "<nav>", "</nav>", "<td class=ad>", "<textarea>", "</textarea>", "é", "<hr>", "<h1>"]
    for _ in range(3000):
        source = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        page = ht.Page(source)
        assert sorted(t for t in page.tokens if isinstance(t, int)) == sorted(
            [-1 - i for i in range(len(page.tag))] + list(range(len(page.tag))))
        text = main(source)
        assert all(line and line == squash(line) for line in text.split("\n") if text)


def _page(body, short=False):
    return f"<html><body><nav><a href=/>x</a></nav>{body}</body></html>"


def test_hosts_decide_by_vote(spark):
    """Short pages, whose own choice is wrong, follow their host."""
    good = _page(f"<div class='box b1'>Notes of the day stand here.</div><div class=story><p>{LONG}</p><p>{LONG}</p></div>")
    short = _page("<div class='box b2'>Notes of the day stand here, and quite a lot of them.</div><div class=story><p>Hi.</p></div>")
    other = _page(f"<div class=piece><p>{LONG}</p></div>")
    assert main(short) != "Hi."
    rows = [(i, f"http://User@Site.example:80/{i}", good) for i in range(30)]
    rows += [(30, "https://site.example/s", short), (31, "//site.example/o", other), (32, "http://else.example/", short),
             (33, None, good), (34, "no url", None), (None, "http://site.example", short), (30, "https://site.example/s", short)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    paths = ht.host_paths(pages).collect()
    assert sorted(((r.path, r.votes) for r in paths if r.host == "site.example"), key=lambda r: -r[1]) == [
        ("/html/body/div.story", 30), ("/html/body/div.b#.box", 3)]          # 1 vote of 34 is too few
    want = squash(LONG)
    for hosts in (10_000, 0):                # broadcast, then salted
        got = ht.extract(pages, broadcast_hosts=hosts).collect()
        assert len(got) == len(rows)
        by_id = {}
        for r in got:
            by_id.setdefault(r.page_id, []).append(r)
        assert all(by_id[i][0].text == f"{want}\n{want}" and by_id[i][0].consensus for i in range(30))
        assert [r.text for r in by_id[30]] == ["Hi.", "Hi."] and by_id[None][0].text == "Hi."
        assert (by_id[31][0].text, by_id[31][0].consensus) == (want, False)
        assert by_id[32][0].text != "Hi." and not by_id[33][0].consensus and by_id[33][0].text == f"{want}\n{want}"
        assert (by_id[34][0].text, by_id[34][0].n_chars) == ("", 0)
        assert all(r.n_chars == len(r.text) for r in got)
    empty = ht.extract(pages.where("false"))
    assert empty.collect() == [] and empty.columns[:4] == ["page_id", "url", "text", "n_chars"]


def by_rule(source):
    """The given pages' articles: their only article element, cut at blocks."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    lines = [squash(html.unescape(re.sub(r"</?(?:b|br)>", " ", b))) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_given_pages(spark):
    from loanlens.llm.queries import QUERIES
    sf = SF.replace("0.001", "0.01")
    pages = table(spark, "pages", sf).collect()
    got = {r.page_id: r for r in QUERIES["op13_html_extraction"](spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == by_rule(p.html), p.page_id
        assert got[p.page_id].url == p.url and got[p.page_id].n_chars == len(got[p.page_id].text)
