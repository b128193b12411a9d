from __future__ import annotations

import html
import re

import pytest

from carryover.llm import html_extraction as H


def text(source, templates=()):
    nodes = H.parse(source)
    H.subtrees(nodes)
    return H.main_text(nodes, set(templates))


@pytest.mark.parametrize("source,want", [
    ("", ""), ("just text", "just text"), ("a < b &amp;&lt; c &am", "a < b &< c &am"), ("<p>one<p>two", "one\ntwo"),
    ("<article><h1>T&eacute;</h1><p>a\n  b&nbsp;c<br>d</p></article><footer>x</footer>", "Té\na b c\nd"),
    ("<body><header>site</header><article><header><h1>H</h1></header><p>x</p><aside>no</aside></article>", "H\nx"),
    ("<div class='page has-sidebar'><main><p>x</p><div class=\"comments\"><p>me too</p></div></main></div>", "x"),
    ("<p>a</p><div class='ad'>buy</div><form>f<input value='>'></form><p>b</p><script>if (a<b) '</p>'</script>", "a\nb"),
    ("<p>x <!-- <p>no --> y</p><style>p{}</style><div id=cookieNotice>ok?</div>", "x y"),
    ("<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", "1\n2\na b\nc"),
    ("<p>a</b></div>b</p>c", "ab\nc"), ("<p>cut <a hre", "cut"), ("<p title='a>b'>x</p>", "x"), ("<!-- open", ""), ("<script>open", ""),
    ("<div hidden>x</div><p style='display: none'>y</p><p>z", "z"), ("<article class=comment>no</article><article><p>yes</article>", "yes"),
    ("<p><b>bold<br><p>next</p>", "bold\nnext"),
    ("<article class=promotion><p>all there is</p></article>", "all there is"),
    ("<article><p class='notice-period'>a</p><section id=login><p>b</p></section><div class='share-buttons'>no</div><div class='comments-area'>no</div></article>", "a\nb"),
    ("<main><h1>Title</h1><article>part one</article><article>longer part</article></main>", "Title\npart one\nlonger part"),
    ("<article><p>one</p></article><div>between</div><article><p>two</p></article><article class='related'><p>no</p></article>", "one\ntwo"),
    ("<article><p>x</p><article class=comment><p>me</p></article></article>", "x"), ("</b></p></div><p>a</i>b</p></article>", "ab"),
])
def test_small_pages(source, want):
    assert text(source) == want


def test_given_pages_against_their_layout(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_site_templates_go_and_articles_stay(spark):
    def page(i, host):
        return (i, f"https://{host}/{i}", f"<body><div><b>Site line</b> always here</div><p>text {i}</p><div>From our shop: {'tea' if i % 2 else 'salt'}</div></body>", "h")

    rows = [page(i, "a.example") for i in range(40)] + [page(100 + i, "b.example") for i in range(5)]
    rows += [(200, None, "<p>p</p>", None), (201, "/x", None, None), (202, "https://a.example/z", "", None), (40, "https://a.example/r", rows[0][2], "h"), (None, "x", "<p>n</p>", "")]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_text(docs).collect()}
    assert got[7] == "text 7" and got[8] == "text 8"  # half of the host's pages each
    assert got[103] == "Site line always here\ntext 103\nFrom our shop: tea"  # too few pages to tell
    assert got[200] == "p" and got[201] == "" and got[202] == "" and got[40] == "text 0" and got[None] == "n"
    assert H.extract_text(docs.limit(0)).collect() == []


def test_long_and_deep_pages():
    assert text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert len(text("<p>" + "word " * 200000)) == 5 * 200000 - 1


def test_stray_tags_take_linear_time():
    import time

    started = time.process_time()
    assert text("<div><b>" * 3000 + "</i></p></td>" * 60000 + "x") == "x"
    assert text("<b>" * 20000 + "<div>y</div>" * 20000) == "\n".join(["y"] * 20000)
    assert time.process_time() - started < 15


def test_boxes_of_a_site_go_from_its_articles(spark):
    """An unknown box at the same place of many pages goes; shared paragraphs and a box at another place stay."""
    box = "<div class='x7'>Get our letter <a href='/l'>here</a></div>"
    rows = [(i, f"https://a.example/{i}", f"<article><h1>News</h1><p>text {i}</p><p>Shared passage</p>{box}</article>") for i in range(20)]
    rows += [(100, "https://a.example/q", f"<article><section><p>about the box:</p>{box}</section></article>")]
    rows += [(200 + i, f"https://b.example/{i}", f"<article><p>text {i}</p>{box}</article>") for i in range(5)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got[7] == "News\ntext 7\nShared passage"
    assert got[100] == "about the box:\nGet our letter here" and got[203] == "text 3\nGet our letter here"


def test_what_articles_repeat_stays(spark):
    around = "<div>Site line</div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{around}<article><h1>News</h1><p>text {i}</p><p>Shared passage</p></article></body>") for i in range(30)]
    rows += [(100 + i, f"https://b.example/{i}", f"<body><div>Visit {i}</div><article><p>one <b>text</b></p></article></body>") for i in range(20)]
    rows += [(200 + i, f"https://c.example/{i}", f"<body>{around}<p>copied text</p><footer>{i}</footer></body>") for i in range(20)]
    rows += [(300 + i, f"https://c.example/x{i}", f"<body>{around}<p>text {i}</p></body>") for i in range(20)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got[7] == "News\ntext 7\nShared passage"
    assert got[103] == "one text"
    assert got[205] == "copied text" and got[305] == "text 5"  # twenty copies are one page of twenty-one
