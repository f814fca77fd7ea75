"""Crawls replayed over stored pages, and site maps.

Breadth first is one join per level over the whole link table, levels written to the checkpoint folder. Depth first and
best first are sequential by nature: each site is replayed on its own, in one task that holds that site's links alone.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import url as fu
from pagemill.operators import pages as op
from pagemill.sources.scratch import written

STRATEGIES = ("bfs", "dfs", "best_first")


def edges(stored: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, position) of visible links of pages that may be followed; position counts these."""
    links = op.followed_links(F.col(html), F.col(url))
    found = stored.where(F.col(html).isNotNull()).select(F.col(url).alias("page"), F.posexplode(links).alias("position", "link"))
    return found.select(fu.normalize_url(F.col("page")).alias("src"), fu.normalize_url(F.col("link")).alias("dst"), "position").where(fu.scheme(F.col("dst")).isin("http", "https"))


def breadth_first(links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """(seed, url, depth): pages in reach of each seed (seed) within its netloc, each at its least depth.

    max_pages keeps the first pages by depth and url for each seed. The links within a site are written once, so that no
    level parses a page again. With state, a result of less depth, the crawl goes on from its last level.
    """
    links = written(links.where(fu.is_same_domain(F.col("src"), F.col("dst"))).select("src", "dst").distinct())
    frontier = written(seeds.select(fu.normalize_url(F.col("seed")).alias("seed")).distinct().select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth")))
    visited, first = frontier, 1
    if state is not None:
        visited = written(state.select("seed", "url", F.col("depth").cast("int").alias("depth")))
        first = 1 + (visited.agg(F.max("depth")).first()[0] or 0)
        frontier = visited.where(F.col("depth") == first - 1)
    for depth in range(first, max_depth + 1):
        step = frontier.join(links, frontier.url == links.src)
        step = step.select("seed", F.col("dst").alias("url")).distinct().join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        frontier = written(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    if max_pages is None:
        return visited
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "url"))
    return visited.withColumn("rank", rank).where(F.col("rank") <= max_pages).drop("rank")


def replay(links: pd.DataFrame, seed: str, strategy: str, max_pages: int, max_depth: int, most_open: int = 5000) -> list[tuple[str, int]]:
    """(url, depth) in order of visit over links (src, dst, position, worth) of one site; best_first takes the greatest worth."""
    nexts: dict[str, list[str]] = {}
    worth: dict[str, float] = {}
    for src, dst, value in links.sort_values(["src", "position"])[["src", "dst", "worth"]].itertuples(index=False):
        nexts.setdefault(src, []).append(dst)
        worth[dst] = value
    queue: deque[tuple[str, int]] = deque()
    heap: list[tuple[float, int, str, int]] = []
    count = 0

    def put(url: str, depth: int) -> None:
        nonlocal count
        if strategy == "best_first":
            heapq.heappush(heap, (-worth.get(url, 0.0), count, url, depth))
        else:
            queue.append((url, depth))
        count += 1

    def take() -> tuple[str, int]:
        if strategy == "best_first":
            return heapq.heappop(heap)[2:]
        return queue.popleft() if strategy == "bfs" else queue.pop()

    put(seed, 0)
    seen: set[str] = set()
    out: list[tuple[str, int]] = []
    while (queue or heap) and len(out) < max_pages:
        url, depth = take()
        if url in seen:
            continue
        seen.add(url)
        out.append((url, depth))
        if depth < max_depth and len(queue) + len(heap) < most_open:
            for u in nexts.get(url, ()):
                if u not in seen:
                    put(u, depth + 1)
    return out


def crawl(links: DataFrame, seeds: DataFrame, strategy: str | Callable[[Column], Column] = "bfs", max_pages: int = 10, max_depth: int = 3, keywords: Iterable[str] = (), allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(seed, seq, url, depth) of each seed's crawl in order of visit.

    A strategy of one's own is an expression of the url: the greatest value is visited first. Links that are not allowed, a
    condition of the url, are not followed.
    """
    worth = strategy if callable(strategy) else lambda u: fu.url_score(u, words)
    strategy = "best_first" if callable(strategy) else strategy
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown crawl strategy: {strategy}")
    words = tuple(keywords)

    def site(key: tuple, own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, i, u, d) for s in sorted(set(start["seed"])) for i, (u, d) in enumerate(replay(own, s, strategy, max_pages, max_depth))]
        return pd.DataFrame(rows, columns=["seed", "seq", "url", "depth"])

    own = links.where(fu.is_same_domain(F.col("src"), F.col("dst"))).withColumn("site", fu.netloc(F.col("src"))).withColumn("worth", worth(F.col("dst")).cast("double"))
    if allowed is not None:
        own = own.where(allowed(F.col("dst")))
    start = seeds.select(fu.normalize_url(F.col("seed")).alias("seed")).withColumn("site", fu.netloc(F.col("seed")))
    # Only sites that have a seed are gathered, each in one task.
    own = own.join(start.select("site").distinct(), "site", "left_semi")
    return own.groupBy("site").cogroup(start.groupBy("site")).applyInPandas(site, "seed string, seq int, url string, depth int")


def parse_sitemap(xml: Column, limit: int = 5000) -> Column:
    """Addresses of a site map: of its nested maps if it names any, else of its pages; invalid xml has none."""
    parsed = F.from_xml(xml, "struct<url:array<struct<loc:string>>,sitemap:array<struct<loc:string>>>", {"rowTag": "urlset", "mode": "PERMISSIVE"})

    def locations(entries: Column) -> Column:
        return F.filter(F.transform(F.coalesce(entries, F.array().cast("array<struct<loc:string>>")), lambda e: F.trim(e["loc"])), lambda u: F.coalesce(u, F.lit("")) != "")

    maps, urls = locations(parsed["sitemap"]), locations(parsed["url"])
    return F.slice(F.when(F.size(maps) > 0, maps).otherwise(urls), 1, limit)


def discover(sitemaps: DataFrame, homepages: DataFrame, limit: int = 5000, include_subdomains: bool = False) -> DataFrame:
    """(base, url, source) of each base: the pages of its first site map that has any, else the links of its home page.

    sitemaps (base, priority, xml), homepages (base, html).
    """
    listed = sitemaps.select("base", "priority", parse_sitemap(F.col("xml"), limit).alias("urls")).where(F.size("urls") > 0)
    first = listed.groupBy("base").agg(F.min_by("urls", "priority").alias("urls"))
    domain = fu.host(F.col("base"))
    own = fu.host(F.col("url")) == domain
    if include_subdomains:
        own = own | F.endswith(fu.host(F.col("url")), F.concat(F.lit("."), domain))
    of_maps = first.select("base", F.explode("urls").alias("url")).where(own).withColumn("source", F.lit("sitemap"))
    links = homepages.join(first.select("base"), "base", "left_anti").select("base", F.posexplode(op.crawl_links(F.col("html"), F.col("base"))).alias("position", "link"))
    links = links.select("base", "position", F.col("link.href").alias("url")).where(fu.scheme(F.col("url")).isin("http", "https") & own)
    bare = F.concat(fu.scheme(F.col("url")), F.lit("://"), fu.netloc(F.col("url")), F.when(F.regexp_replace(fu.path(F.col("url")), "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(fu.path(F.col("url")), "/+$", "")))
    of_links = links.select("base", bare.alias("url")).distinct().withColumn("source", F.lit("homepage"))
    return of_maps.unionByName(of_links)


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls with allowed: the longest rule (base, allow, prefix) that fits decides, allowing ones first; none allows."""
    path = F.concat(fu.path(F.col("url")), F.when(fu.query(F.col("url")) != "", F.concat(F.lit("?"), fu.query(F.col("url")))).otherwise(""))
    per = rules.where("prefix <> ''").groupBy("base").agg(F.collect_list(F.struct("prefix", "allow")).alias("rules"))  # a robots file is small
    keyed = urls.withColumn("base", fu.get_base_url(F.col("url"))).withColumn("__path", path).join(per, "base", "left")
    fits = F.filter("rules", lambda r: F.startswith(F.col("__path"), r["prefix"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    return keyed.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("base", "__path", "rules")


def search(results: DataFrame, stored: DataFrame) -> DataFrame:
    """(query, position, url, found): results (query, position, url) against stored pages by normalised url."""
    keys = stored.select(fu.normalize_url(F.col("url")).alias("__key")).distinct().withColumn("__found", F.lit(True))
    return results.withColumn("__key", fu.normalize_url(F.col("url"))).join(keys, "__key", "left").select("query", "position", "url", F.coalesce("__found", F.lit(False)).alias("found"))


def page_of(rows: DataFrame, number: int, size: int, order: list[str]) -> DataFrame:
    """Rows of one page of a result, with total and has_next. number counts from 1."""
    start = (number - 1) * size
    total = rows.count()
    part = rows.orderBy(*order).offset(start).limit(size)
    return part.withColumn("total", F.lit(total).cast("long")).withColumn("has_next", F.lit(start + size < total))
