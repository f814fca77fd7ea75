import re
from urllib.parse import urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as ft
from pagemill.functions import url as fu
from pagemill.operators import chunking


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://a.test/b/#c", "https://a.test/b"),
        ("https://a.test", "https://a.test/"),
        ("https://A.test/x//?q=1", "https://A.test/x?q=1"),
        ("HTTP://a.test/with space/", "http://a.test/with space"),
        ("", "/"),
        (None, None),
    ],
)
def test_normalize(spark, url, wanted):
    assert one(spark, url, fu.normalize_url) == wanted


def test_parts_agree_with_the_standard_library(spark):
    urls = ["https://u:p@H.test:8080/a;b/c;d?e=f&g#h", "//x.test/y", "mailto:a@b", "/only/path?x#y", "https://a.test?q", "a/b.html#z?w"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", fu.scheme(F.col("u")), fu.netloc(F.col("u")), fu.full_path(F.col("u")), fu.query(F.col("u"))).collect()
    for u, s, n, p, q in got:
        x = urlsplit(u)
        assert (s, n, p, q) == (x.scheme, x.netloc, x.path, x.query)


def test_filters(spark):
    urls = ["https://a.test/x.PDF", "https://a.test/v1.2/x", "https://b.test/x", "https://a.test/y/", "https://a.test/y#z", "https://a.test/private/1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    kept = fu.filter_urls(df, order="id", allowed_domains=["a.test"], exclude_paths=["/private"])
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    assert one(spark, "https://x.doubleclick.net/a", fu.is_ad_or_tracker)
    assert not one(spark, "https://notdoubleclick.net/a", fu.is_ad_or_tracker)


@pytest.mark.parametrize(("url", "score"), [("https://a.test/blog", 0.75), ("https://a.test/a/b/c/d/login", 0.15), ("https://a.test/x/y/z?a&b&c&d", 0.4), ("https://a.test/pages", 0.75)])
def test_score(spark, url, score):
    assert one(spark, url, fu.url_score) == pytest.approx(score)


def test_resolve(spark):
    pairs = [("https://a.test/b/c", "../d"), ("https://a.test/b/c", "//e.test/f"), ("https://a.test/b/c", "?x"), ("https://a.test", None)]
    got = spark.createDataFrame(pairs, "b string, l string").select("b", "l", fu.resolve_url(F.col("b"), F.col("l"))).collect()
    assert [r[2] for r in got] == [None if x is None else urljoin(b, x) for b, x in pairs]


def test_text(spark):
    assert one(spark, "a b\tc\n\nd", ft.word_count) == 4
    assert one(spark, "", ft.word_count) == 0
    assert one(spark, "Héllo A1", ft.tokenize) == ["h", "llo", "a1"]
    assert one(spark, "{}()" * 10, ft.estimate_tokens) == 11
    assert one(spark, "x" * 41, ft.estimate_tokens) == 10
    assert one(spark, "One. Two! three? Four", ft.split_sentences) == ["One.", "Two! three?", "Four"]
    assert one(spark, "[a](#x)\n![pic](p.png) [t]( )\n<!-- c\n -->z", ft.clean_for_llm) == "pic t\nz"
    assert one(spark, "x\n# A\nb\n\n## C", ft.split_by_headings) == ["x", "# A\nb", "## C"]


def test_citations(spark):
    got = one(spark, "See [a](u) and [b](v), [c](u)!", ft.markdown_with_citations)
    assert got == "See [a][1] and [b][2], [c][1]!\n\n---\n\n**References**\n\n[1]: u\n[2]: v"
    assert one(spark, "plain", ft.markdown_with_citations) == "plain"


def test_pdf_and_prompt(spark):
    assert "<p>a &lt;b&gt;</p>\n<p>c</p>" in one(spark, "a <b>\n\n \n\nc", ft.pdf_text_to_html)
    long = "a" * 60 + "\n\n" + "b" * 60
    assert one(spark, long, lambda c: ft.truncate_prompt(c, 100, 50)) == "a" * 60 + "\n\n[Content truncated]"
    assert one(spark, "short", lambda c: ft.truncate_prompt(c, 100, 50)) == "short"


def test_prompts_of_the_default_limits(spark, tmp_path):
    from pagemill.plans import catalog

    texts = ["a" * 5_000 + "\n\n" + "b" * 5_000, "a" * 60_000 + "\n\n" + "b" * 60_000, "a" * 20_000 + "\n\n" + "b" * 100_000]
    spark.createDataFrame(list(enumerate(texts)), "scrape_id long, markdown string").write.parquet(f"{tmp_path}/scrapes.parquet")
    got = [r.prompt for r in catalog.queries()["text_prompts_whole"](spark, str(tmp_path)).orderBy("scrape_id").collect()]
    head, mark = "## Web Page Content\n\n", "\n\n[Content truncated]"
    assert got[0] == f"{head}{texts[0]}\n\n## Extraction Task\n\nList all names."
    assert got[1] == head + "a" * 60_000 + mark and got[2] == (head + texts[2])[:100_000] + mark


def _fixed(text, size, overlap):
    out, open_ = [], []
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)):
        if not s:
            continue
        n = len(s.split())
        if open_ and sum(len(o.split()) for o in open_) + n > size:
            out.append(" ".join(open_))
            keep = []
            for o in reversed(open_):
                if not overlap or sum(len(k.split()) for k in keep) + len(o.split()) > overlap:
                    break
                keep.insert(0, o)
            open_ = keep
        open_.append(s)
    return [*out, " ".join(open_)] if open_ else out


def test_fixed_length_against_a_loop(spark):
    texts = ["", "One.", " ".join(f"Word {'x ' * (i % 7)}end." for i in range(40)), "no stops " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((10, 0), (10, 4), (3, 3), (1000, 200)):
        got = [r[0] for r in df.select(chunking.fixed_length(F.col("t"), size, overlap)).collect()]
        assert got == [_fixed(t, size, overlap) for t in texts]


def test_sliding_covers_all_words(spark):
    words = [str(i) for i in range(23)]
    got = one(spark, " ".join(words), lambda c: chunking.sliding_window(c, 10, 3))
    assert got[0].split() == words[:10] and got[-1].split()[-1] == "22"
    assert {w for c in got for w in c.split()} == set(words)
    assert one(spark, "a  b", lambda c: chunking.sliding_window(c, 10, 3)) == ["a  b"]
    assert one(spark, "  ", lambda c: chunking.sliding_window(c, 10, 3)) == []


def test_semantic(spark):
    got = one(spark, "a b\n\nc d\n# H\ne f g\n\nh", lambda c: chunking.semantic(c, 4))
    assert got == ["a b\n\nc d", "# H\ne f g", "h"]
    with pytest.raises(ValueError):
        chunking.chunker("none")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab/?#:@.%é ", max_size=12), min_size=1, max_size=8))
def test_normalize_is_stable(spark, tails):
    df = spark.createDataFrame([("https://h.test/" + t,) for t in tails], "u string")
    once = df.select(fu.normalize_url(F.col("u")).alias("u"))
    for a, b in once.select("u", fu.normalize_url(F.col("u"))).collect():
        assert a == b
