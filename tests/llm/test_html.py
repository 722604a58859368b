import pytest
from orolith.llm import htmltext

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a < b) { "</p>" }</script></head><body class="x"><header id=top>Site head</header>
<nav><a href=/>menu</a></nav><div id="wrap-12"><div class="sidebar">Side <p>text text</p></div><div class="post-content col-8"><h1>T &amp; itle</h1><p>First <a href=x>link</a>ed <i>it</i>alic&nbsp;x<br>line
<p>Second &#233;<ul><li>one<li>two</ul><div class="ad-slot">AD</div><form>f</form><pre> a
 b </pre><table><tr><td>c1<td>c2</table></div><div id="comments"><p>reader says a lot a lot</p></div></div><footer>foot</footer></body></html>"""
TEXT = "T & itle First linked italic x line Second é one two a b c1 c2"


def test_own_container():
    assert htmltext.extract(PAGE, []) == TEXT
    assert htmltext.votes(PAGE)[-1] == ("html>body.x>div>div.col-.post-content", 1.0)


def test_fallback_and_winners():
    assert htmltext.extract(PAGE, ["html>nothing", "html>body.x>div>div.col-.post-content"]) == TEXT
    assert htmltext.extract("<p>plain", ["html>nothing"]) == "plain"
    assert htmltext.extract("", []) == "" == htmltext.extract("<script>x</script>", [])
    assert htmltext.extract("a < b &lt; c", []) == "a < b < c"


@pytest.mark.parametrize("page", ["<" * 500, "<div>" * 3000 + "x", "<p" * 100, "<!-- <p>x", "<a b='", "</p></div>x", "&#xD800;&bogus;&#0;", "<script>never closed <p>x"])
def test_broken_pages(page):
    htmltext.votes(page)
    htmltext.extract(page, ["html>body"])


def test_consensus_and_odd_rows(spark):
    article = "<html><body><div class=menu>m m m</div><article><h1>H</h1><p>{}</p></article><div class=box>{}</div></body></html>"
    rows = [(i, f"http://Host.example/{i}", article.format("main words here " * 20, "short")) for i in range(6)]
    rows += [(10, "http://host.example/x", article.format("tiny", "a long boxed text that wins alone " * 5)), (11, None, "<p>no url"), (12, "http://h2/", None), (12, "http://h2/", None), (13, "x", ""), (None, "http://host.example/y", "<p>other shape")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("clash"))
    got = htmltext.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[10].text == "H tiny"  # its host's article, not its own longest box
    assert by[0].text == "H " + " ".join(["main words here"] * 20) and by[0].n_chars == len(by[0].text)
    assert by[11].text == "no url" and by[12].text == "" and by[13].text == "" and by[None].text == "other shape"
    assert htmltext.main_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("inside", ["for(i=0;i<n;i++){}", "if(a<b&&c>d){x='<p>no</p>'}", "<!-- never closed", "s='</scripts>'+\"</\"+\"p>\"", "a<b"])
@pytest.mark.parametrize("tags", [("script", "script"), ("SCRIPT type='x'", "Script "), ("style", "style"), ("title", "title\n"), ("textarea", "textarea")])
def test_markup_inside_raw_elements(inside, tags):
    assert htmltext.extract(f"<div><p>before</p><{tags[0]}>{inside}</{tags[1]}><p>article</p></div>", []) == "before article"


def test_scripts_quotes_names_and_two_winning_paths():
    plain = lambda page: htmltext.extract(page, [])
    assert plain("<body><script>for(i=0;i<n;i++){a()}</script><article><p>Hello world here</p></article></body>") == "Hello world here"
    assert plain('<article><p>One <a title="x>link</a> two</p></article>') == "One link two"
    assert plain('<article><h2 id="header-history">History</h2><p>Text.</p><table class="table-related"><tr><td class="share-price">7</td></tr></table></article>') == "History Text. 7"
    page = '<body><div class="a"><p>First part.</p></div><div class="nav">menu</div><div class="b"><p>Second part.</p></div></body>'
    paths = [htmltext.path(x) for x in htmltext._elements(htmltext.parse(page)) if x.name in ("div.a", "div.b")]
    assert htmltext.extract(page, paths) == htmltext.extract(page, paths[::-1]) == "First part. Second part."
