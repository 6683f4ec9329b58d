import re
from html import unescape

from briefmill.llm import html_extract as h
from tests.llm.fixtures import SF

CASES = {
    "<p>a\n  b&amp;c</p><p>d<br>e": "a b&c\nd e",
    "<nav>x</nav><article><h1>T</h1><header>h</header><p>one <b>two</b>three<p>four<aside>s</aside><ul><li>5<li>6</ul><div class='Reader-Comments'><p>c</p></div></article><p>out": "T\none twothree\nfour\n5\n6",
    "<article>text<script>if (a</p>b) '<p>'</script>more<style>p{}</style><!-- <p>no</p> --> end</article>": "textmore end",
    '<main><p title="a>b">x</p><form>f</form><div id="cookie-banner">n</div><div class="address">kept</div></main>': "x\nkept",
    "<div role=navigation>m</div><div class=ad>a</div>text &lt;p&gt; &#233;&eacute;&nbsp;z": "text <p> éé z",
    "a < b and c > d <p>5 <6": "a < b and c > d\n5 <6",
    "<article><p>a</article><p>b</p><article>c</article>": "a\nc",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "<article><p>x</footer>y</p></article><footer>z": "xy",
    "<p>un<closed": "un<closed",
    "<title>t</title><body><p>b": "b",
    "": "", None: "", "   ": "", "<article></article>": "",
    "<script>never closed <p>x": "",
}


def test_cases():
    for html, want in CASES.items():
        assert h.main_text(html)[0] == want, html


def test_long_and_deep_pages_end():
    assert h.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000)[0] == "x"
    assert h.main_text("<p " * 20_000)[0].startswith("<p")
    assert h.main_text('<a title="' * 5_000) is not None
    assert len(h.main_text("<p>" + "word " * 400_000)[0]) == 5 * 400_000 - 1


def test_table_equals_plain_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in h.articles(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>|<br>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[page.page_id] == (page.url, want, len(want))


def site(spark):
    menu = "<div><ul><li>Home</li><li>Shop</li></ul><p>Only ours</p></div>"
    rows = [(k, f"http://s.org/{k}", f"<body>{menu}<p>story {k}</p><p>closing words {k}</p></body>", "h", "x") for k in range(30)]
    rows += [(100 + k, f"http://t.org/{k}", f"<body>{menu}<p>other {k}</p></body>", "h", "x") for k in range(3)]
    rows += [(200 + k, "http://c.org/", "<article><p>one article on many pages</p></article><div><p>site words</p></div>", "h", "x") for k in range(20)]
    rows += [(300, None, None, None, None), (None, "http://s.org/", "<p>x</p>", None, None)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, hashes string")


def test_recurring_subtrees_go_and_articles_stay(spark):
    rows, pages = site(spark)
    got = {r.page_id: r for r in h.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[7].text == "story 7\nclosing words 7" and got[7].n_deleted == 1
    assert got[101].text == "Home\nShop\nOnly ours\nother 1"  # too few pages
    assert {got[200 + k].text for k in range(20)} == {"one article on many pages"}
    assert got[300].text == "" and got[None].text == "x"
    assert h.articles(pages.limit(0)).collect() == []
    assert {r.n_chars for r in h.articles(pages).collect() if r.text == ""} == {0}


def test_content_in_dropped_elements_and_classes_of_pages():
    story = "<div><p>the story</p></div>"
    for rest in ("<div class='comments'><article>c</article></div>", "<article class='comment'>c</article>", "<aside><article>teaser</article></aside>"):
        assert h.main_text(f"<body>{story}{rest}</body>")[0] == "the story", rest
    assert h.main_text(f"<body class='no-sidebar'>{story}</body>")[0] == "the story"
    assert h.main_text("<article class='has-comment post'>a</article><main class='with-menu'>b</main><p>c")[0] == "a\nb"
