import datetime as dt
import difflib
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.operators import changes, crawl, merge, responses, scoring, state, usage
from pagemill.plans.stages import Hooks, Registry, extract_with_model
from pagemill.sources import tables as src
from pagemill.streaming import streams
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_challenges(spark):
    cases = [
        (403, {"server": "cloudflare"}, "Just a moment...", "cloudflare_interstitial"),
        (200, {}, "x g-recaptcha y" + "z" * 600, "recaptcha"),
        (200, {"server": "cloudflare"}, "Just a moment..." + "z" * 600, None),
        (403, {}, "tiny", "silent_block"),
        (403, {"cf-mitigated": "challenge"}, "q" * 600, "cloudflare_mitigated"),
        (405, {}, "aws-waf-token", "aws_waf"),
        (200, {}, "a" * 15_000 + "hcaptcha.com", None),
        (None, {}, None, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s int, h map<string,string>, b string, w string")
    for r in df.select("w", responses.detect_challenge(F.col("s"), F.col("h"), F.col("b")).alias("c")).collect():
        assert r.c.type == r.w and r.c.detected == (r.w is not None)


def test_needs_scripts_and_first_page_of_a_domain(spark):
    full = "<p>" + "words " * 60
    pages = [("https://a.test/1", '<div id="root"></div>' + full, at(0)), ("https://a.test/2", full, at(1)), ("https://b.test/1", full, at(0)), ("https://b.test/2", None, at(1))]
    df = spark.createDataFrame(pages, "url string, html string, scraped_at timestamp")
    assert [r[0] for r in df.select(responses.needs_scripts(F.col("html"))).collect()] == [True, False, False, None]
    got = {r.url: r.needs_scripts for r in responses.needs_scripts_by_domain(df).collect()}
    assert got == {"https://a.test/1": True, "https://a.test/2": True, "https://b.test/1": False, "https://b.test/2": False}


def test_small_predicates(spark):
    urls = {"http://10.1.2.3/": False, "https://a.test/x": True, "http://[::1]/": False, "http://x.internal/": False, "ftp://a.test": False, "http://localhost:8/": False, "https://8.8.8.8": True, "": False, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(responses.is_public_url(F.col("u"))).collect()] == list(urls.values())
    row = spark.createDataFrame([({"Host": "x", "Accept": "y"}, "NET::ERR_PROXY_FAILED", b"abcdefgh", b"abcdefgX")], "h map<string,string>, m string, a binary, b binary")
    got = row.select(responses.sanitize_headers(F.col("h")), responses.is_proxy_error(F.col("m")), responses.image_difference(F.col("a"), F.col("b")), responses.image_difference(F.col("a"), F.col("a"))).first()
    assert tuple(got) == ({"Accept": "y"}, True, 50.0, 0.0)
    waits = spark.createDataFrame([(429, "7"), (200, "7"), (429, "Mon, 01 Jan 2024 00:01:00 GMT"), (429, "soon"), (429, None)], "s int, v string")
    got = waits.select(responses.retry_after(F.col("s"), F.create_map(F.lit("retry-after"), F.col("v")), F.lit(T0))).collect()
    assert [r[0] for r in got] == [7.0, None, 60.0, None, None]


def test_pairs(spark):
    ev = [(1, 1, "u", "request", at(0)), (2, 1, "u", "response", at(1)), (2, 1, "u", "response", at(1)), (3, 1, "v", "response", at(1)), (4, 2, "u", "response", at(2)), (5, None, "u", "request", at(0))]
    df = spark.createDataFrame(ev, "event_id long, scrape_id long, url string, kind string, ts timestamp").select("*", *(F.lit("x").alias(c) for c in ("method", "resource_type")), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("t")).alias("resp_headers"))
    got = responses.pair_events(df).collect()
    assert [(r.event_id, r.response_time_ms, r.content_type) for r in got] == [(2, 1000.0, "t")]


def test_usage(spark):
    ev = [("a", "x", at(0), 5, True), ("a", "y", at(2), 7, False), ("b", None, at(1), None, False)]
    df = spark.createDataFrame(ev, "c string, e string, t timestamp, n int, bad boolean")
    got = {r.client: r for r in usage.usage_by_client(df, "c", "e", "t", F.col("n"), F.col("bad")).collect()}
    assert got["a"].endpoints == {"x": 1, "y": 1} and got["a"].error_rate == 0.5 and got["b"].total_bandwidth_bytes == 0
    assert tuple(usage.usage_summary(df, "c", F.col("n"), F.col("bad")).first()) == (3, 12, 1, 2, 0.3333)
    assert tuple(usage.usage_summary(df.limit(0), "c", F.col("n"), F.col("bad")).first()) == (0, 0, 0, 0, 0.0)
    plain = [r.n for r in usage.histogram(df, F.col("n"), (5, 6, 7)).orderBy("position").collect()]
    twice = [r.n for r in usage.histogram(df, F.col("n"), (5, 6, 7), compat=True).orderBy("position").collect()]
    assert plain == [1, 1, 2, 2] and twice == [1, 2, 4, 2]
    many = spark.range(1005).select(F.lit("k").alias("k"), F.timestamp_seconds("id").alias("t"), F.col("id").cast("double").alias("v"))
    last = list(range(1001 + 4 - 504, 1005))
    assert usage.acquire_stats(many, "k", "t", "v").first().p95_ms == last[int(len(last) * 0.95)]


def _fold(events, backoff, threshold):
    s = state.ProxyState(events[0][0])
    for e in events:
        s.see(*e, backoff)
    return s


def test_proxy_state(spark):
    ev = [("p", at(0), "ok", 1.0), ("p", at(10), "ok", 2.0), ("p", at(20), "timeout", None), ("p", at(100), "ok", None), ("p", at(400), "fail", None), ("p", at(401), "fail", None), ("q", at(0), "fail", None), (None, at(0), "ok", 1.0)]
    df = spark.createDataFrame(ev, "proxy_url string, ts timestamp, kind string, latency double")
    got = {r.proxy_url: r for r in state.proxy_state(df, threshold=2).collect()}
    p = got["p"]
    assert (p.succeed, p.failures, p.timeouts, p.reanimated, p.recent_failures, p.recent_succeed, p.ok, p.evict) == (3, 3, 1, 1, 2, 0, False, True)
    assert p.speed == pytest.approx(0.7 * 1 + 0.3 * 2) and set(got) == {"p", "q"}
    assert tuple(state.pool_stats(state.proxy_state(df)).first()) == (2, 0, 2, 0.0)


def test_state_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    ev = [(f"p{rng.randrange(3)}", at(i), rng.choice(["ok", "fail", "timeout"]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(ev, "proxy_url string, ts timestamp, kind string, latency double")
    want = rows(state.proxy_state(df))
    assert rows(state.proxy_state(df.repartition(7))) == want
    own = [(e[1].timestamp(), e[2], e[3]) for e in ev if e[0] == "p1"]
    assert next(r for r in want if r[0] == "p1")[2] == pytest.approx(_fold(own, 60, 5).speed)


def test_limits_and_replays(spark):
    df = spark.createDataFrame([(i, "k", at(i)) for i in range(5)] + [(9, "k", at(120))], "id int, k string, ts timestamp")
    got = {r.id: r.allowed for r in state.admitted(df, "k", 2, "id").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 9: True}
    hours = {1: 0, 2: 20, 3: 30, 4: 50, 5: 53.9, 6: 54}
    df = spark.createDataFrame([(i, "k", at(h * 3600)) for i, h in hours.items()] + [(7, "other", at(1))], "id int, k string, ts timestamp")
    assert {r.id: r.replayed for r in state.first_of_day(df, ["k"], "id").collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False}
    merged = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, None)], "o map<string,string>, n map<string,string>").select(state.merge_cookies(F.col("o"), F.col("n"))).collect()
    assert [r[0] for r in merged] == [{"a": "1", "b": "3"}, {}]


def test_changes(spark):
    snaps = [("u", "a b", at(0)), ("u", "a b", at(1)), ("u", "a c", at(2)), ("v", "x", at(0)), ("v", None, at(1)), (None, "x", at(0))]
    df = spark.createDataFrame(snaps, "url string, text string, scraped_at timestamp")
    got = changes.snapshots_changes(df, with_difference=True).orderBy("url", "scraped_at").collect()
    assert [r.change_type for r in got] == ["added", "unchanged", "modified", "added"]
    assert got[2].diff_summary == "".join(difflib.unified_diff(["a b"], ["a c"], lineterm="")) and got[0].diff_summary is None
    a = spark.createDataFrame([("u", "1"), ("v", "2"), ("w", "3")], "url string, text string")
    b = spark.createDataFrame([("u", "1"), ("v", "9"), ("x", "3")], "url string, text string")
    assert dict(changes.compare_snapshots(a, b).select("url", "change_type").collect()) == {"u": "unchanged", "v": "modified", "w": "removed", "x": "added"}


SITE = [
    ("https://a.test/", '<a href="/b">b</a><a href="/blog/c">c</a><a href="https://other.test/">o</a>'),
    ("https://a.test/b", '<a href="/blog/c#x">c</a><a style="display:none" href="/trap">t</a><a href="d/">d</a>'),
    ("https://a.test/blog/c", '<meta name=robots content=noindex><a href="/e">e</a>'),
    ("https://a.test/d", '<a href="/">home</a>'),
]


def test_crawls(spark):
    links = crawl.edges(spark.createDataFrame(SITE, "url string, html string"))
    assert not any("trap" in r.dst or r.src.endswith("/c") for r in links.collect())
    seeds = spark.createDataFrame([("https://a.test",)], "seed string")
    got = {(r.url, r.depth) for r in crawl.breadth_first(links, seeds).collect()}
    assert got == {("https://a.test/", 0), ("https://a.test/b", 1), ("https://a.test/blog/c", 1), ("https://a.test/d", 2)}
    order = {s: [r.url.removeprefix("https://a.test") for r in crawl.crawl(links, seeds, s).orderBy("seq").collect()] for s in crawl.STRATEGIES}
    assert order == {"bfs": ["/", "/b", "/blog/c", "/d"], "dfs": ["/", "/blog/c", "/b", "/d"], "best_first": ["/", "/blog/c", "/b", "/d"]}
    assert len(crawl.crawl(links, seeds, "bfs", max_pages=2).collect()) == 2
    assert crawl.breadth_first(links, seeds, max_pages=2).count() == 2
    with pytest.raises(ValueError):
        crawl.crawl(links, seeds, "random")


def test_best_first_takes_the_greatest_worth(spark):
    urls = ["https://a.test/blog/x", "https://a.test/a/b/c/d/e", "https://a.test/login?a&b&c&d", "https://a.test/TAG/kw"]
    links = spark.createDataFrame([("https://a.test/", u, i) for i, u in enumerate(reversed(urls))], "src string, dst string, position int")
    seeds = spark.createDataFrame([("https://a.test/",)], "seed string")
    got = crawl.crawl(links, seeds, "best_first", max_pages=10, keywords=["KW"]).orderBy("seq").collect()
    assert [r.url for r in got] == ["https://a.test/", "https://a.test/blog/x", "https://a.test/TAG/kw", "https://a.test/login?a&b&c&d", "https://a.test/a/b/c/d/e"]


def test_own_strategies_and_filters(spark):
    from pagemill.functions.url import filter_urls

    links = spark.createDataFrame([("https://a.test/", f"https://a.test/{x}", i) for i, x in enumerate(("bb", "cccc", "d", "no"))], "src string, dst string, position int")
    seeds = spark.createDataFrame([("https://a.test/",)], "seed string")
    got = crawl.crawl(links, seeds, F.length, allowed=lambda u: ~F.endswith(u, F.lit("no"))).orderBy("seq").collect()
    assert [r.url[15:] for r in got] == ["", "cccc", "bb", "d"]
    urls = spark.createDataFrame([("https://a.test/x",), ("https://a.test/yy",)], "url string")
    assert [r.url for r in filter_urls(urls, filters=[lambda u: F.length(u) > 16]).collect()] == ["https://a.test/yy"]


def test_a_page_that_raises_fails_no_other(spark, monkeypatch):
    from pagemill.operators import pages

    def bad(h):
        if "bad" in h:
            raise ValueError("no page")
        return {"title": h, "error": None}

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "h string")
    got = df.select(pages._record(bad, [("title", "string"), ("error", "string")], F.col("h")).alias("r")).collect()
    assert [(r.r.title, r.r.error) for r in got] == [("good", None), (None, "ValueError: no page"), (None, None)]
    assert [r[0] for r in df.select(pages._function(lambda h: bad(h)["title"], "string", F.col("h"))).collect()] == ["good", None, None]


def test_patterns_have_a_time_limit(monkeypatch):
    from pagemill.dom import page

    monkeypatch.setattr(page, "REGEX_SECONDS", 0.2)
    text = f"<p>{'a' * 40}!</p>"
    assert page.regex_record(text, {"x": r"(a|aa|aaa)+\d$", "y": "a!"}) == {"x": None, "y": "a!"} and page.regex_records(text, r"(a|aa|aaa)+\d$") == [{}]


@pytest.mark.parametrize(
    ("expression", "now", "want"),
    [("*/15 * * * *", (2024, 1, 1, 0, 0, 30), (2024, 1, 1, 0, 15)), ("30 9 * * 1-5", (2024, 1, 5, 10), (2024, 1, 8, 9, 30)), ("0 0 29 2 *", (2024, 3, 1), (2028, 2, 29)), ("0 12 1 * 0", (2024, 1, 2), (2024, 1, 7, 12)), ("0 0 31 2 *", (2024, 1, 1), (2024, 1, 1, 1)), ("61 * * * *", (2024, 1, 1), (2024, 1, 1, 1)), (None, (2024, 1, 1), (2024, 1, 1, 1))],
)
def test_cron(expression, now, want):
    assert src.cron_next(expression, dt.datetime(*now)) == dt.datetime(*want)


def test_site_maps_and_robots(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [
        ("https://a.test", 1, f"<urlset {ns}><url><loc>https://a.test/1</loc></url><url><loc> https://b.test/2 </loc></url></urlset>"),
        ("https://a.test", 0, "not xml"),
        ("https://c.test", 0, f"<sitemapindex {ns}><sitemap><loc>https://c.test/m1</loc></sitemap><sitemap><loc>https://c.test/m2</loc></sitemap></sitemapindex>"),
    ]
    df = spark.createDataFrame(maps, "base string, priority int, xml string")
    got = [r[0] for r in df.select(crawl.parse_sitemap(F.col("xml"), 2)).collect()]
    assert got == [["https://a.test/1", "https://b.test/2"], [], ["https://c.test/m1", "https://c.test/m2"]]
    homes = spark.createDataFrame([("https://d.test", '<a href="/x/?q#f">x</a><a href="/x">x</a><a href="https://notd.test/">n</a>')], "base string, html string")
    found = {(r.url, r.source) for r in crawl.discover(df, homes).collect()}
    assert found == {("https://a.test/1", "sitemap"), ("https://c.test/m1", "sitemap"), ("https://c.test/m2", "sitemap"), ("https://d.test/x", "homepage")}
    rules = spark.createDataFrame([("https://a.test", False, "/p"), ("https://a.test", True, "/p/ok")], "base string, allow boolean, prefix string")
    urls = spark.createDataFrame([("https://a.test/p/x",), ("https://a.test/p/ok/1",), ("https://b.test/p",)], "url string")
    assert [r.allowed for r in crawl.allowed_by_robots(urls, rules).orderBy("url").collect()] == [True, False, True]


def test_bm25(spark):
    docs = ["red fox", "red red dog", "", None, "cat"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in scoring.corpus_scores(df, "red fox").collect()}
    idf = lambda d: math.log((5 - d + 0.5) / (d + 0.5) + 1)
    mean = 6 / 5
    assert got[1] == pytest.approx(idf(2) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean))) and set(got) == {0, 1}
    md = "# A\ncats\n\n# B\ndogs dogs\n\n# C\ndogs and cats and more words"
    fit = spark.createDataFrame([(md,), ("",), ("one section",)], "m string").select(scoring.fit_markdown(F.col("m"), "dogs", 1)).collect()
    assert [r[0] for r in fit] == ["# B\ndogs dogs", "", "one section"]


def test_merge_and_schema(spark):
    assert merge.merge_results([{"a": [1, 1]}]) == {"a": [1, 1]}
    assert merge.merge_results([{"a": [1, 2], "o": {"x": None}, "s": None}, {"a": [2, 3], "o": {"x": 1, "y": 2}, "s": 4, "n": 5}]) == {"a": [1, 2, 3], "o": {"x": 1, "y": 2}, "s": 4, "n": 5}
    assert merge.infer_schema([]) == {"type": "array", "items": {"type": "object"}}
    assert merge.infer_schema({"a": True, "b": [1.5], "c": None})["properties"] == {"a": {"type": "boolean"}, "b": {"type": "array", "items": {"type": "number"}}, "c": {"type": ["string", "null"]}}
    got = spark.createDataFrame([(["{bad", '{"a": 1}', "[]"],), ([],), (None,)], "x array<string>").select(merge.merged_json(F.col("x"))).collect()
    assert [r[0] for r in got] == ['{"a": 1}', "{}", None]


def test_stages_and_models(spark):
    hooks = Hooks()
    add = lambda df: df.withColumn("y", F.lit(1))
    hooks.register("after_clean", add)
    assert hooks.fire("after_clean", spark.range(1)).columns == ["id", "y"]
    hooks.unregister("after_clean", add)
    assert hooks.fire("after_clean", spark.range(1)).columns == ["id"]
    with pytest.raises(ValueError):
        hooks.register("never", add)
    with pytest.raises(ValueError):
        Registry(a=int).make("b")

    def model(prompt):
        if "fail" in prompt:
            raise RuntimeError
        return json.dumps({"n": [len(prompt.split())]})

    df = spark.createDataFrame([("One two. " * 6 + "Now fail here.",), ("",)], "c string")
    got = [json.loads(r[0]) for r in df.select(extract_with_model(F.col("c"), F.lit("count"), model, size=4, overlap=0).alias("r")).collect()]
    assert got[0]["n"] and got[1] == {}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("scrape", "abc123abc123", "x"), ("crawl", "abc123abc124", "y")], "job_type string, job_id string, body string")
    src.write_results(df, str(tmp_path / "r"))
    assert rows(src.read_results(spark, str(tmp_path / "r"), df.schema).select("job_id", "job_type")) == [("abc123abc123", "scrape"), ("abc123abc124", "crawl")]
    assert src.list_results(spark, str(tmp_path / "r")).count() >= 2
    assert [r.proxy_url for r in src.proxies(spark, "http://a:1, ftp://b,socks5://c,http://a:1").orderBy("position").collect()] == ["http://a:1", "socks5://c"]
    src.save_checkpoint(df, str(tmp_path), "job")
    assert src.load_checkpoint(spark, str(tmp_path), "job").count() == 2
    now = F.lit(at(100))
    cache = spark.createDataFrame([("k", "old", at(0)), ("k", "new", at(90))], "key string, response string, stored_at timestamp")
    asked = spark.createDataFrame([("k",), ("z",)], "key string")
    assert rows(src.cached(asked, cache, now, 50).na.fill("-")) == [("k", "new"), ("z", "-")]
    assert rows(src.cached(asked, cache, now, 5).na.fill("-")) == [("k", "-"), ("z", "-")]


def test_pages_of_results(spark):
    df = spark.range(7)
    got = crawl.page_of(df, 2, 3, ["id"]).collect()
    assert [(r.id, r.total, r.has_next) for r in got] == [(3, 7, True), (4, 7, True), (5, 7, True)]
    assert [r.id for r in crawl.page_of(df, 3, 3, ["id"]).collect()] == [6]


def test_streams_agree_with_batch(spark, tmp_path):
    rng = random.Random(1)
    ev = pd.DataFrame([(f"p{rng.randrange(3)}", at(i), rng.choice(["ok", "fail", "timeout"]), rng.random()) for i in range(90)], columns=["proxy_url", "ts", "kind", "latency"])
    for i in range(3):
        spark.createDataFrame(ev[i * 30 : (i + 1) * 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = streams.proxy_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: out.append(df.toPandas())).trigger(availableNow=True).start()
    q.awaitTermination()
    last = pd.concat(out).groupby("proxy_url").last()
    want = state.proxy_state(table).toPandas().set_index("proxy_url")
    assert (last["succeed"] == want["succeed"]).all() and last["speed"].round(9).equals(want["speed"].round(9))
    snaps = spark.createDataFrame([("u", "1", at(0)), ("u", "1", at(1)), ("u", "2", at(2))], "url string, hash string, scraped_at timestamp")
    snaps.write.parquet(str(tmp_path / "s"))
    got = []
    q = streams.snapshot_changes(spark.readStream.schema(snaps.schema).parquet(str(tmp_path / "s"))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.change_type for r in sorted(got, key=lambda r: r.scraped_at)] == ["added", "unchanged", "modified"]
