import pytest
from pyspark.sql import functions as F

from pagemill.dom import page
from pagemill.dom.select import css, xpath, xpath_text
from pagemill.dom.tree import body_of, parse, serialize
from pagemill.operators import pages

LISTING = """<html lang="en"><head><title> Shop &amp; Co </title><meta name="description" content="Things"></head><body><nav><a href="/">Home</a></nav>
<div class="item"><h2>Lamp</h2><span class="price">9</span><a href="/lamp" title="t" rel="nofollow next">see</a></div>
<div class="item"><h2>Desk</h2><a href="#top">up</a></div><div class="item empty"></div><p>Write to a@b.test or c@d.test</p></body></html>"""


def test_lenient_trees():
    root = parse("<p>a<p>b<div>c</div><ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><td>3</table><br>t</div></i>")
    assert [n.text for n in root.find_all("p")] == ["a", "b"]
    assert [li.text for li in root.find_all("li")] == ["x", "y", "z"]
    assert [len(tr.find_all("td")) for tr in root.find_all("tr")] == [2, 1]
    assert parse("").tag == "html" and parse("<").text_content() in ("<", "")
    deep = parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert deep.text_content() == "x" and len(serialize(deep)) > 5000


def test_serialising_is_stable():
    once = serialize(parse(LISTING))
    assert serialize(parse(once)) == once


def test_script_text_is_raw():
    root = parse('<body><script>var t="</p><b>";</script><p>x</p></body>')
    assert len(root.find_all("b")) == 0 and root.find("p").text == "x"


@pytest.mark.parametrize(
    ("selector", "n"),
    [("div.item", 3), ("div > h2", 2), ("a[href^='/']", 2), ("a[rel~=next]", 1), ("div.item:nth-child(2)", 1), ("h2 + span", 1), ("h2 ~ a", 2), ("div:not(.empty)", 2), ("nav a, p", 2), ("#none", 0), (".item h2:first-child", 2)],
)
def test_css(selector, n):
    assert len(css(parse(LISTING), selector)) == n


def test_css_refuses_what_it_does_not_know():
    with pytest.raises(ValueError):
        css(parse("<p>"), "p::before")


@pytest.mark.parametrize(
    ("expression", "wanted"),
    [("//h2", ["Lamp", "Desk"]), ("//div[@class='item']/a/@href", ["/lamp", "#top"]), ("//div[1]/h2/text()", ["Lamp"]), ("/html/body/p", ["Write to a@b.test or c@d.test"]), ("//div[contains(@class, 'empty')]", [""]), ("//h2[.='Desk']/..", None)],
)
def test_xpath(expression, wanted):
    got = [xpath_text(m) for m in xpath(parse(LISTING), expression)]
    assert got == wanted if wanted is not None else len(got) == 1


def test_records(spark):
    df = spark.createDataFrame([(LISTING,), (None,)], "html string")
    spec = {"container": "div.item", "fields": {"name": "h2", "price": ".price", "to": {"selector": "a", "attribute": "href"}}}
    got = df.select(pages.extract(F.col("html"), "css", spec).alias("r")).collect()
    assert got[0].r == [{"name": ["Lamp"], "price": ["9"], "to": ["/lamp"]}, {"name": ["Desk"], "price": None, "to": ["#top"]}] and got[1].r is None
    mails = df.select(pages.extract(F.col("html"), "regex", {"m": r"\S+@\S+"})[0]["m"]).first()[0]
    assert mails == ["a@b.test", "c@d.test"]
    assert page.regex_records(LISTING, "zzz") == [{}]
    for bad in (("css", None), ("other", {"a": "b"}), ("regex", {"a": "("})):
        with pytest.raises(ValueError):
            pages.extract(F.col("html"), *bad)


def test_metadata_and_noindex(spark):
    df = spark.createDataFrame([(LISTING,), ("<meta NAME=Robots content='NOINDEX'>",), (None,)], "html string")
    got = df.select(pages.metadata(F.col("html")).alias("m"), pages.noindex(F.col("html")).alias("n")).collect()
    assert tuple(got[0].m) == ("Shop & Co", "Things", "en") and [r.n for r in got] == [False, True, None]


def test_main_content_prefers_a_single_article():
    body = "word " * 60
    html = f"<title>T</title><nav>menu</nav><article><h1>A</h1><p>{body}</p><aside>side</aside></article><footer>foot</footer>"
    title, _, _, content = page.main_content(html)
    assert title == "T" and "side" not in content and "menu" not in content and "<h1>A</h1>" in content
    two = page.main_content(f"<article>{body}</article><main><p>{body}main</p></main><article>x</article>")[3]
    assert two.startswith("<main>")
    assert page.main_content("") == ("", "", "", "")
    assert "tiny" in page.main_content("<body><p>tiny</p></body>")[3]


def test_preprocess():
    html = "<body><nav>n</nav>tail<div class=a>x<div class=b>y</div></div></body>"
    assert page.preprocess(html) is html
    assert "tail" in page.preprocess(html, ["NAV"]) and "<nav>" not in page.preprocess(html, ["NAV"])
    assert page.preprocess(html, css_selector=".b") == '<html><body><div class="b">y</div></body></html>'
    assert "tail" in page.preprocess(html, css_selector=".none")
    assert ">y<" not in page.preprocess(html, excluded_selector=".b")


def test_markdown():
    html = "<body><h2>T <b>x</b></h2><p>a <a href='/u'>l</a> <b>s</b> c</p><ul><li>i <a href=z>k</a></li></ul><pre>p\n q</pre><blockquote>q</blockquote><img src=i alt=A><hr><table><tr><th>h</th><td>d</td></tr></table><script>no</script></body>"
    got = page.to_markdown(html).split("\n")
    assert got[0] == "## T x" and got[1].startswith("a [l](/u)") and "**s**" in got[1]
    assert "- i k" in got and "```" in got and "> q" in got and "---" in got and "| h | d |" in got and "no" not in got


def test_other_formats():
    html = '<body><p>pre</p><h1>H</h1><p>a, "b"</p><li>c</li></body>'
    assert page.to_sections(html) == [{"heading": "", "level": 0, "content": ["pre"]}, {"heading": "H", "level": 1, "content": ['a, "b"', "c"]}]
    assert page.to_csv(html) == 'section,content\r\np,pre\r\nh1,H\r\np,"a, ""b"""\r\nli,c'
    assert page.to_xml("<p>a & b</p>").endswith("<document><p>a &amp; b</p></document>")
    assert page.to_text("<p>a</p>\n\n\n\n<p> b </p>") == "a\n\nb"


def test_tables():
    html = """<table><caption> C </caption><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr><tr><td>a</td><td>b</td></tr></tbody><tbody><tr><td>z</td></tr></tbody></table>
    <table><tr><td>x</td></tr></table>"""
    first, second = page.tables(html)
    assert first["caption"] == "C" and first["rows"] == [{"a": "1", "b": "2"}, {"a": "3"}] and first["row_count"] == 2
    assert second["headers"] == [] and second["rows"] == [] and second["raw_rows"] == [["x"]]
    assert [t["index"] for t in page.tables(html, 1)] == [1] and page.tables(html, 5) == []
    assert page.tables_csv([first]).startswith("# C\r\na,b\r\n1,2\r\n")


def test_media(spark):
    html = """<img data-src="a.png" width=5><img><div style="background:url('/b.jpg')"></div><video poster=p.png><source src=v.mp4 type=video/mp4></video>
    <audio src=s.mp3></audio><iframe src="https://www.youtube.com/embed/1"></iframe><a href="mailto:x">m</a><a href="/l"> t <b>u</b></a>"""
    got = spark.createDataFrame([(html, "https://h.test/d/")], "html string, u string").select(pages.media(F.col("html"), F.col("u")).alias("m")).first().m
    assert [i.src for i in got["images"]] == ["https://h.test/d/a.png", "https://h.test/b.jpg"] and got["images"][1].source == "css-background"
    assert len(got["videos"]) == 2 and got["videos"][1].embed and got["audio"][0].sources[0].src == "https://h.test/d/s.mp3"
    assert [(x.href, x.text) for x in got["links"]] == [("https://h.test/l", "tu")]


def test_filters():
    html = "<body><nav>n</nav><div class='Cookie-bar'>c</div><div><a href=x>only links here</a></div><div><p>" + "real words here. " * 20 + "</p></div><div></div></body>"
    kept = page.prune(html)
    assert "real words" in kept and "only links" not in kept and "c</div>" not in kept and page.prune(" ") == " "
    html = "<body><p>apples and pears are fruit of trees</p><p>cars and roads and more cars again</p><p>nothing of it here at all, really</p></body>"
    assert "cars" in page.relevant_blocks(html, "cars") and "apples" not in page.relevant_blocks(html, "cars")
    assert page.relevant_blocks(html, "zebra") == html and page.relevant_blocks(html, "") == html
    assert "two words" not in page.drop_short_blocks("<div><p>two words</p><p>one two three four</p></div>", 3)


def test_response(spark):
    df = spark.createDataFrame([(1, "https://a.test/", "<title>x</title><article><p>" + "some words " * 40 + "</p></article>")], "id int, url string, html string")
    got = pages.response(df, formats=("markdown", "json"), citations=True, llm_ready=True).first()
    assert got.word_count == 80 and got.title == "x" and got.as_json.startswith("[{")
    with pytest.raises(ValueError):
        pages.scrape(F.col("html"), ("docx",))
