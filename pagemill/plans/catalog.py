"""Named queries of the core operators over whole test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as ft
from pagemill.functions import url as fu
from pagemill.operators import changes, chunking, crawl, merge, pages, responses, scoring, state, usage
from pagemill.sources import tables as src
from pagemill.sources.scratch import new_path
from pagemill.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _scrapes(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_table(spark, sf, "scrapes")


def _with_html(spark: SparkSession, sf: str) -> DataFrame:
    return src.spread(_scrapes(spark, sf).select("scrape_id", "url", "html").where("html is not null"))


U, HTML, MD, TEXT = F.col, "html", "markdown", "text"

# SQL parts of a url, by the pattern of RFC 3986.
_RE = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#((?s:.)*))?$'"


def _part(column: str, group: int) -> str:
    return f"regexp_extract({column}, {_RE}, {group})"


def _path(column: str) -> str:
    return f"regexp_replace({_part(column, 3)}, ';[^/]*$', '')"


_URLS = f"""WITH u AS (SELECT scrape_id, url, scraped_at, lower({_part('url', 1)}) AS s, {_part('url', 2)} AS n, {_part('url', 3)} AS fp, {_path('url')} AS p, {_part('url', 4)} AS q FROM scrapes)"""
_ORIGIN = "CASE WHEN s <> '' THEN s || ':' ELSE '' END || CASE WHEN n <> '' THEN '//' || n ELSE '' END"
_QS = "CASE WHEN q <> '' THEN '?' || q ELSE '' END"
_KEY = f"s || '://' || n || regexp_replace(p, '/+$', '') || {_QS}"


@query(
    f"""{_URLS} SELECT scrape_id, s AS scheme, n AS netloc, lower(regexp_replace(regexp_replace(n, '^.*@', ''), ':[0-9]*$', '')) AS host, p AS path, q AS query,
    s || '://' || n AS base, {_ORIGIN} || CASE WHEN regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END
      || CASE WHEN regexp_extract(fp, '(;[^/]*)$', 1) = ';' THEN '' ELSE regexp_extract(fp, '(;[^/]*)$', 1) END || {_QS} AS normalized,
    {_KEY} AS dedup_key, s || '://' || n || p AS sitemap_key FROM u"""
)
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = U("url")
    return _scrapes(spark, sf).select(
        "scrape_id", fu.scheme(u).alias("scheme"), fu.netloc(u).alias("netloc"), fu.host(u).alias("host"), fu.path(u).alias("path"), fu.query(u).alias("query"),
        fu.get_base_url(u).alias("base"), fu.normalize_url(u).alias("normalized"), fu.dedup_key(u).alias("dedup_key"), fu.sitemap_key(u).alias("sitemap_key"),
    )


@query(
    f"""{_URLS}, d AS (SELECT *, lower(p) AS lp, length(p) - length(replace(p, '/', '')) AS depth, CASE WHEN q = '' THEN 0 ELSE length(q) - length(replace(q, '&', '')) + 1 END AS params FROM u)
    SELECT scrape_id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN depth <= 2 THEN 0.15 WHEN depth >= 5 THEN -0.15 ELSE 0 END + CASE WHEN contains(lower(url), 'guide') OR contains(lower(url), 'wiki') THEN 0.2 ELSE 0 END
      + CASE WHEN regexp_matches(lp, '/({'|'.join(fu.HIGH_VALUE)})') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(lp, '/({'|'.join(fu.LOW_VALUE)})') THEN 0.2 ELSE 0 END
      - CASE WHEN params > 3 THEN 0.1 ELSE 0 END))::DOUBLE, 6) AS score FROM d"""
)
def url_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).select("scrape_id", F.round(fu.url_score(U("url"), ["guide", "wiki"]), 6).alias("score"))


@query(
    f"""{_URLS}, k AS (SELECT *, regexp_extract(lower(p), '(\\.[^.]*)$', 1) AS ext, {_KEY} AS key FROM u
      WHERE lower(n) NOT IN ('kelmora-daily.example') AND NOT regexp_matches(p, '/archiv')),
    f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY scrape_id) AS rn FROM k WHERE ext = '' OR ext NOT IN ({', '.join(repr(e) for e in fu.BLOCKED_EXTENSIONS)}))
    SELECT scrape_id, key AS dedup_key FROM f WHERE rn = 1"""
)
def url_filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scrapes(spark, sf).select("scrape_id", "url")
    kept = fu.filter_urls(rows, order="scrape_id", blocked_domains=["kelmora-daily.example"], exclude_paths=["/archiv"])
    return kept.select("scrape_id", fu.dedup_key(U("url")).alias("dedup_key"))


@query(
    f"""WITH u AS (SELECT event_id, url, lower(regexp_replace(regexp_replace({_part('url', 2)}, '^.*@', ''), ':[0-9]*$', '')) AS h, coalesce(resp_headers['content-type'], '') AS ct FROM network_events)
    SELECT event_id, regexp_matches(h, '^(.*\\.)?({'|'.join(d.replace('.', chr(92) + '.') for d in fu.AD_DOMAINS)})$') AS ad,
    contains(lower(ct), 'application/pdf') OR ends_with(lower(regexp_replace(url, '/+$', '')), '.pdf') AS pdf FROM u"""
)
def url_predicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "network_events")
    return rows.select("event_id", fu.is_ad_or_tracker(U("url")).alias("ad"), fu.is_pdf(U("url"), F.col("resp_headers")["content-type"]).alias("pdf"))


def _normalized(column: str) -> str:
    s, n, q, fp = f"lower({_part(column, 1)})", _part(column, 2), _part(column, 4), _part(column, 3)
    p, params = f"regexp_replace({_path(column)}, '/+$', '')", f"regexp_extract({fp}, '(;[^/]*)$', 1)"
    return f"""(CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END || CASE WHEN {n} <> '' THEN '//' || {n} ELSE '' END || CASE WHEN {p} = '' THEN '/' ELSE {p} END
      || CASE WHEN {params} = ';' THEN '' ELSE {params} END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"""


def _absolute(base: str, link: str) -> str:
    """Links of the test pages are absolute or root-relative."""
    return f"CASE WHEN starts_with({link}, '/') THEN lower({_part(base, 1)}) || '://' || {_part(base, 2)} || {link} ELSE {link} END"


@query(
    f"""WITH l AS (SELECT scrape_id, url, unnest(regexp_extract_all(markdown, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) AS link FROM scrapes WHERE markdown IS NOT NULL)
    SELECT scrape_id, link, {_absolute('url', 'link')} AS resolved FROM l"""
)
def url_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Links of markdown made absolute."""
    rows = _scrapes(spark, sf).where("markdown is not null").select("scrape_id", "url", F.explode(F.regexp_extract_all(MD, F.lit(ft.LINK), 2)).alias("link"))
    return rows.select("scrape_id", "link", fu.resolve_url(F.col("url"), F.col("link")).alias("resolved"))


@query(
    r"""SELECT scrape_id, len(regexp_extract_all(text, '[^\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))::INTEGER AS words,
    CASE WHEN length(text) = 0 THEN 0 WHEN (length(text) - length(regexp_replace(text, '[{}()]', '', 'g'))) / length(text) > 0.05 THEN floor(length(text) / 3.5) ELSE floor(length(text) / 4.0) END::BIGINT AS tokens,
    len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INTEGER AS terms, sha256(text) AS hash FROM scrapes WHERE text IS NOT NULL"""
)
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    t = U(TEXT)
    return _scrapes(spark, sf).where("text is not null").select("scrape_id", ft.word_count(t).alias("words"), ft.estimate_tokens(t).alias("tokens"), F.size(ft.tokenize(t)).alias("terms"), ft.content_hash(t).alias("hash"))


@query(
    r"""WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\t\n\v\f\r ]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, count(*) AS sentences FROM c WHERE regexp_replace(s, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g') <> '' GROUP BY doc_id"""
)
def text_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", F.size(ft.split_sentences(U(TEXT))).cast("long").alias("sentences")).where("sentences > 0")


@query(
    r"""WITH a AS (SELECT scrape_id, regexp_replace(markdown, '(?m)^[\t\n\v\f\r ]*\[.*?\]\(#.*?\)[\t\n\v\f\r ]*$', '', 'g') AS x FROM scrapes WHERE markdown IS NOT NULL),
    b AS (SELECT scrape_id, regexp_replace(x, '!\[([^\]]*)\]\([^)]+\)', '\1', 'g') AS x FROM a),
    c AS (SELECT scrape_id, regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g') AS x FROM b),
    d AS (SELECT scrape_id, regexp_replace(x, '(?s)<!--.*?-->', '', 'g') AS x FROM c),
    e AS (SELECT scrape_id, regexp_replace(x, '\[([^\]]*)\]\([\t\n\v\f\r ]*\)', '\1', 'g') AS x FROM d)
    SELECT scrape_id, regexp_replace(x, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g') AS cleaned FROM e"""
)
def text_clean_for_llm(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", ft.clean_for_llm(U(MD)).alias("cleaned"))


@query(
    r"""WITH l AS (SELECT scrape_id, markdown, regexp_extract_all(markdown, '\[([^\]]*)\]\(([^)]+)\)', 2) AS t FROM scrapes WHERE markdown IS NOT NULL)
    SELECT scrape_id, len(t)::INTEGER AS links, len(list_distinct(t))::INTEGER AS refs FROM l"""
)
def text_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Links and references that the cited form has; the form itself is covered by tests."""
    cited = _scrapes(spark, sf).where("markdown is not null").select("scrape_id", ft.markdown_with_citations(U(MD)).alias("c"))
    tail = F.substring_index("c", "\n\n---\n\n**References**\n\n", -1)
    has = F.contains("c", F.lit("\n\n---\n\n**References**\n\n"))
    body = F.when(has, F.left("c", F.length("c") - F.length(tail))).otherwise("")
    return cited.select("scrape_id", F.size(F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\[(\d+)\]"), 1)).alias("links"), F.when(has, F.size(F.split(tail, "\n"))).otherwise(0).alias("refs"))


@query(
    r"""WITH l AS (SELECT scrape_id, markdown, regexp_extract_all(markdown, '\[([^\]]*)\]\(([^)]+)\)', 1) AS w, regexp_extract_all(markdown, '\[([^\]]*)\]\(([^)]+)\)', 2) AS u, string_split_regex(markdown, '\[([^\]]*)\]\(([^)]+)\)') AS b FROM scrapes WHERE markdown IS NOT NULL),
    t AS (SELECT *, list_filter(u, lambda x, i: NOT list_contains(u[: i - 1], x)) AS ts FROM l)
    SELECT scrape_id, CASE WHEN len(u) = 0 THEN markdown ELSE b[1] || array_to_string(list_transform(range(1, len(u) + 1), lambda i: '[' || w[i] || '][' || list_position(ts, u[i]) || ']' || b[i + 1]), '')
      || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**References**' || chr(10) || chr(10) || array_to_string(list_transform(ts, lambda x, i: '[' || i || ']: ' || x), chr(10)) END AS cited FROM t"""
)
def text_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown with numbered references."""
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", ft.markdown_with_citations(U(MD)).alias("cited"))


@query(
    r"""WITH s AS (SELECT scrape_id, unnest(string_split(regexp_replace(markdown, '(?m)^(#{1,6}[\t\n\v\f\r ])', chr(1) || '\1', 'g'), chr(1))) AS x FROM scrapes WHERE markdown IS NOT NULL)
    SELECT scrape_id, regexp_replace(x, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g') AS section FROM s WHERE regexp_replace(x, '[\t\n\v\f\r ]+', '', 'g') <> ''"""
)
def text_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", F.explode(ft.split_by_headings(U(MD))).alias("section"))


@query(
    r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') AS ws FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, text, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE ceil(greatest(len(ws) - 100, 0) / 80)::BIGINT + 1 END)) AS i FROM w)
    SELECT doc_id, i::INTEGER AS chunk_no, CASE WHEN len(ws) <= 100 THEN text ELSE array_to_string(ws[i * 80 + 1 : i * 80 + 100], ' ') END AS chunk FROM c"""
)
def chunks_sliding(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", F.posexplode(chunking.sliding_window(U(TEXT), 100, 20)).alias("chunk_no", "chunk"))


_WS = r"[^\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _pack_sql(key: str, pieces: str, size: int, overlap: int, separator: str, alone: bool) -> str:
    """pieces: SQL of (key, ps) with the pieces of each text."""
    full = f"(s.n + ns[s.i + 1] > {size}" + (" OR starts_with(ps[s.i + 1], '#')" if alone else "") + ")"
    begin = f"s.a + len(list_filter(range(s.a, s.i), lambda j: list_sum(ns[j + 1 : s.i]) > {overlap}))" if overlap else "s.i"
    return rf"""WITH RECURSIVE p AS ({pieces}), c AS (SELECT {key}, ps, list_transform(ps, lambda x: len(regexp_extract_all(x, '{_WS}'))) AS ns FROM p WHERE len(ps) > 0),
    s AS (SELECT {key}, 0::BIGINT AS a, 1::BIGINT AS i, ns[1]::BIGINT AS n, NULL::BIGINT AS x, NULL::BIGINT AS y FROM c
      UNION ALL
      SELECT s.{key}, CASE WHEN f THEN b ELSE s.a END, s.i + 1, CASE WHEN f THEN coalesce(list_sum(ns[b + 1 : s.i]), 0) ELSE s.n END::BIGINT + ns[s.i + 1], CASE WHEN f THEN s.a END, CASE WHEN f THEN s.i END
      FROM (SELECT s.*, ps, ns, {full} AS f, ({begin})::BIGINT AS b FROM s JOIN c USING ({key}) WHERE s.i < len(ps)) s),
    r AS (SELECT {key}, x AS a, y AS b FROM s WHERE x IS NOT NULL UNION ALL SELECT {key}, a, i FROM s JOIN c USING ({key}) WHERE i = len(ps))
    SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY b, a) - 1)::INTEGER AS chunk_no, array_to_string(ps[a + 1 : b], {separator}) AS chunk FROM r JOIN c USING ({key})"""


_SENTENCES = r"""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\t\n\v\f\r ]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL"""
_PARAGRAPHS = r"""SELECT scrape_id, list_filter(list_transform(string_split_regex(regexp_replace(markdown, '(?m)^(#{1,6}[\t\n\v\f\r ])', chr(1) || '\1', 'g'), '\n[\t\n\v\f\r ]*\n|\x01'), lambda x: regexp_replace(x, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g')), lambda x: x <> '') AS ps FROM scrapes WHERE markdown IS NOT NULL"""


@query(_pack_sql("doc_id", _SENTENCES, 100, 20, "' '", False))
def chunks_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(chunking.fixed_length(U(TEXT), 100, 20)).alias("chunk_no", "chunk"))


@query(_pack_sql("scrape_id", _PARAGRAPHS, 200, 0, "chr(10) || chr(10)", True))
def chunks_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", F.posexplode(chunking.semantic(U(MD), 200)).alias("chunk_no", "chunk"))


_BM25 = "the central bank and the audit committee"


def _bm25_sql(terms: list[str]) -> str:
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), q AS (SELECT unnest({terms!r}) AS term),
    f AS (SELECT doc_id, term, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (SELECT DISTINCT term FROM q)),
    d AS (SELECT term, count_if(tf > 0) AS df FROM f GROUP BY term), m AS (SELECT term, count(*) AS times FROM q GROUP BY term)
    SELECT doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(mean, 1)))), 6) AS score
    FROM f JOIN d USING (term) JOIN m USING (term), s WHERE df > 0 GROUP BY doc_id HAVING sum(tf) > 0"""


@query(_bm25_sql(scoring.query_terms(_BM25)))
def bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.corpus_scores(src.read_table(spark, sf, "documents"), _BM25).select("doc_id", F.round("score", 6).alias("score"))


def _fit_sql(terms: list[str], top_k: int) -> str:
    return rf"""WITH x AS (SELECT scrape_id, unnest(string_split(regexp_replace(markdown, '(?m)^(#{{1,6}}[\t\n\v\f\r ])', chr(1) || '\1', 'g'), chr(1))) AS x, unnest(range(0, len(string_split(regexp_replace(markdown, '(?m)^(#{{1,6}}[\t\n\v\f\r ])', chr(1) || '\1', 'g'), chr(1))))) AS i FROM scrapes WHERE markdown IS NOT NULL),
    s AS (SELECT scrape_id, i, regexp_replace(x, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g') AS t FROM x WHERE regexp_replace(x, '[\t\n\v\f\r ]+', '', 'g') <> ''),
    w AS (SELECT scrape_id, i, t, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM s), q AS (SELECT unnest({terms!r}) AS term),
    f AS (SELECT scrape_id, i, term, len(ws) AS dl, len(list_filter(ws, lambda y: y = term)) AS tf FROM w, q),
    g AS (SELECT *, count(*) OVER (PARTITION BY scrape_id, term) AS n, avg(dl) OVER (PARTITION BY scrape_id, term) AS mean, count_if(tf > 0) OVER (PARTITION BY scrape_id, term) AS df FROM f),
    r AS (SELECT scrape_id, i, any_value(n) AS n, sum(CASE WHEN df = 0 THEN 0 ELSE ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(mean, 1))) END) AS score FROM g GROUP BY scrape_id, i),
    k AS (SELECT r.*, row_number() OVER (PARTITION BY scrape_id ORDER BY round(score, 10) DESC, i) AS place FROM r WHERE score > 0 AND n > 1),
    b AS (SELECT k.scrape_id, string_agg(w.t, chr(10) || chr(10) ORDER BY place) AS fit FROM k JOIN w ON w.scrape_id = k.scrape_id AND w.i = k.i WHERE place <= {top_k} GROUP BY k.scrape_id)
    SELECT scrape_id, coalesce(fit, markdown) AS fit FROM scrapes LEFT JOIN b USING (scrape_id) WHERE markdown IS NOT NULL"""


@query(_fit_sql(["market", "report", "trial"], 3))
def fit_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", scoring.fit_markdown(U(MD), "market report trial", 3).alias("fit"))


@query()
def page_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: stored pages parsed once, main content as markdown, with counts and normalised address."""
    rows = src.spread(src.pages(spark, sf).select("page_id", "url", "html", "success").where("html is not null and success"))
    out = pages.response(rows.select("page_id", "url", "html"), formats=("markdown",), llm_ready=True)
    return out.select("page_id", fu.normalize_url(U("url")).alias("url"), "title", "description", "language", "word_count", "token_count_estimate", F.col("as_markdown").alias("markdown"))


@query()
def page_formats(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.spread(src.pages(spark, sf).select("page_id", "html").where("html is not null")).select("page_id", pages.scrape(U(HTML), ("markdown", "text", "json", "csv", "xml")).alias("p"))
    return rows.select("page_id", "p.markdown", "p.text", "p.json", "p.csv", "p.xml")


def _unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(
    f"""SELECT scrape_id, regexp_replace({_unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '^[\\s]+|[\\s]+$', '', 'g') AS title,
    {_unescape("regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1)")} AS description, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM scrapes WHERE html IS NOT NULL"""
)
def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", pages.metadata(U(HTML)).alias("m"))
    return rows.select("scrape_id", "m.title", "m.description", "m.language")


@query(
    """SELECT scrape_id, len(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: h <> '' AND NOT starts_with(h, '#') AND NOT starts_with(h, 'javascript:') AND NOT starts_with(h, 'mailto:')))::INTEGER AS links,
    len(regexp_extract_all(html, '<img[^>]* src="[^"]+"'))::INTEGER AS images FROM scrapes WHERE html IS NOT NULL"""
)
def page_media(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", pages.media(U(HTML), U("url")).alias("m"))
    return rows.select("scrape_id", F.size("m.links").alias("links"), F.size("m.images").alias("images"))


@query()
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", F.explode(pages.tables(U(HTML))).alias("t"))
    return rows.select("scrape_id", "t.index", "t.caption", "t.headers", "t.raw_rows", "t.row_count", "t.column_count")


@query()
def page_tables_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", pages.tables_csv(U(HTML)).alias("csv"))


_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]"
# A block's text goes as far as the next tag that is not within a line.
_FLOW = rf"""b AS (SELECT scrape_id, string_split(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<(h[1-6]|p|li)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] AS xs FROM scrapes WHERE html IS NOT NULL),
    x AS (SELECT scrape_id, unnest(xs) AS x, unnest(range(0, len(xs))) AS no FROM b),
    t AS (SELECT scrape_id, no, lower(split_part(x, chr(2), 1)) AS tag, regexp_extract(split_part(x, chr(2), 2), '(?is)^(.*?)(?:</?(?:h[1-6]|p|li|ul|ol|table|tr|td|div|section|article|aside|nav|footer|header|main|pre|body|html|blockquote|form|noscript|script)\b|$)', 1) AS raw FROM x),
    f AS (SELECT scrape_id, no, tag, regexp_replace({_unescape("regexp_replace(raw, '<[^>]*>', '', 'g')")}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS text FROM t)"""


@query(
    f"""WITH {_FLOW}, k AS (SELECT * FROM f WHERE text <> ''),
    s AS (SELECT *, count_if(starts_with(tag, 'h')) OVER (PARTITION BY scrape_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS n, count_if(NOT starts_with(tag, 'h')) OVER (PARTITION BY scrape_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS before FROM k),
    g AS (SELECT scrape_id, n, coalesce(max(CASE WHEN starts_with(tag, 'h') THEN text END), '') AS heading, coalesce(max(CASE WHEN starts_with(tag, 'h') THEN right(tag, 1)::INTEGER END), 0) AS level, count_if(NOT starts_with(tag, 'h'))::INTEGER AS parts FROM s GROUP BY scrape_id, n)
    SELECT scrape_id, (row_number() OVER (PARTITION BY scrape_id ORDER BY n) - 1)::INTEGER AS section_no, heading, level, parts FROM g"""
)
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", F.posexplode(pages.sections(U(HTML))).alias("section_no", "s"))
    return rows.select("scrape_id", "section_no", "s.heading", "s.level", F.size("s.content").alias("parts"))


def _xml_text(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _json_text(x: str) -> str:
    return f"replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"


@query(
    f"""WITH {_FLOW}, k AS (SELECT scrape_id, string_agg('<' || tag || '>' || {_xml_text('text')} || '</' || tag || '>', '' ORDER BY no) AS x FROM f WHERE text <> '' GROUP BY scrape_id)
    SELECT scrape_id, '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || coalesce('<document>' || x || '</document>', '<document />') AS xml FROM scrapes LEFT JOIN k USING (scrape_id) WHERE html IS NOT NULL"""
)
def page_xml(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", pages.convert(U(HTML), "xml").alias("xml"))


@query(
    f"""WITH {_FLOW}, k AS (SELECT * FROM f WHERE text <> ''), s AS (SELECT *, count_if(starts_with(tag, 'h')) OVER (PARTITION BY scrape_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS n FROM k),
    g AS (SELECT scrape_id, n, '{{"heading":"' || coalesce(max(CASE WHEN starts_with(tag, 'h') THEN {_json_text('text')} END), '') || '","level":' || coalesce(max(CASE WHEN starts_with(tag, 'h') THEN right(tag, 1)::INTEGER END), 0)
      || ',"content":[' || coalesce(string_agg('"' || {_json_text('text')} || '"', ',' ORDER BY no) FILTER (WHERE NOT starts_with(tag, 'h')), '') || ']}}' AS x FROM s GROUP BY scrape_id, n),
    j AS (SELECT scrape_id, '[' || string_agg(x, ',' ORDER BY n) || ']' AS json FROM g GROUP BY scrape_id) SELECT scrape_id, coalesce(json, '[]') AS json FROM scrapes LEFT JOIN j USING (scrape_id) WHERE html IS NOT NULL"""
)
def page_json(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", pages.convert(U(HTML), "json").alias("json"))


@query(
    f"""WITH p AS (SELECT scrape_id, {_unescape("regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<!?/?[A-Za-z][^>]*>', '', 'g')")} AS x FROM scrapes WHERE html IS NOT NULL),
    l AS (SELECT scrape_id, array_to_string(list_transform(string_split(x, chr(10)), lambda y: regexp_replace(y, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')), chr(10)) AS x FROM p)
    SELECT scrape_id, regexp_replace(regexp_replace(x, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS text FROM l"""
)
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", pages.convert(U(HTML), "text").alias("text"))


@query()
def page_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", pages.prune(U(HTML)).alias("html"))


@query()
def page_relevant(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", pages.relevant_blocks(U(HTML), "report market", 3).alias("html"))


@query()
def page_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Preprocessed, short blocks dropped."""
    scoped = pages.preprocess(U(HTML), excluded_tags=["nav", "footer"], excluded_selector=".sidebar, .consent-bar", css_selector="article, .post")
    return _with_html(spark, sf).select("scrape_id", pages.drop_short_blocks(scoped, 5).alias("html"))


@query(
    """SELECT scrape_id, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') IS NOT NULL AS has_heading, len(regexp_extract_all(html, '<h2>'))::INTEGER AS subheadings FROM scrapes WHERE html IS NOT NULL"""
)
def extract_css(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", pages.extract(U(HTML), "css", {"h": "h1", "subs": {"selector": "h2", "all": True}})[0].alias("r"))
    return rows.select("scrape_id", F.col("r")["h"].isNotNull().alias("has_heading"), F.size(F.col("r")["subs"]).alias("subheadings"))


@query(
    """SELECT scrape_id, len(regexp_extract_all(html, '<h2>'))::INTEGER AS subheadings, len(regexp_extract_all(html, '<a href='))::INTEGER AS links FROM scrapes WHERE html IS NOT NULL"""
)
def extract_xpath(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", pages.extract(U(HTML), "xpath", {"subs": "//h2", "links": "//a/@href"})[0].alias("r"))
    return rows.select("scrape_id", *(F.when(F.col("r")[k].isNotNull(), F.size(F.col("r")[k])).otherwise(0).alias(n) for k, n in (("subs", "subheadings"), ("links", "links"))))


_PLAIN = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', chr(10), 'g')"


@query(
    rf"""WITH m AS (SELECT scrape_id, regexp_extract_all({_PLAIN}, '\d+ (?:per cent|weeks|days)') AS ms FROM scrapes WHERE html IS NOT NULL),
    e AS (SELECT scrape_id, unnest(CASE WHEN len(ms) = 0 THEN [NULL] ELSE ms END) AS m FROM m) SELECT scrape_id, nullif(regexp_extract(m, '^(\d+) ', 1), '') AS number, nullif(regexp_extract(m, ' (.*)$', 1), '') AS unit FROM e"""
)
def extract_regex(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", F.explode(pages.extract(U(HTML), "regex", r"(?P<number>\d+) (?P<unit>per cent|weeks|days)")).alias("r"))
    return rows.select("scrape_id", F.col("r")["number"][0].alias("number"), F.col("r")["unit"][0].alias("unit"))


@query(
    r"""WITH h AS (SELECT doc_id, left(text, (length(text) // 2)::BIGINT) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents WHERE text IS NOT NULL),
    v AS (SELECT doc_id, coalesce(nullif(regexp_extract(a, '(\d{4})', 1), ''), nullif(regexp_extract(b, '(\d{4})', 1), '')) AS year,
      regexp_extract_all(a, '\b(\d{2,3})\b', 1) AS x, regexp_extract_all(b, '\b(\d{2,3})\b', 1) AS y FROM h),
    f AS (SELECT doc_id, year, list_concat(list_filter(x, lambda v, i: NOT list_contains(x[: i - 1], v)), list_filter(y, lambda v, i: NOT list_contains(y[: i - 1], v))) AS ns FROM v),
    d AS (SELECT doc_id, year, list_filter(ns, lambda x, i: NOT list_contains(ns[i + 1 :], x)) AS ns FROM f)
    SELECT doc_id, '{"numbers": [' || array_to_string(list_transform(ns, lambda x: '"' || x || '"'), ', ') || ']' || CASE WHEN year IS NULL THEN '' ELSE ', "year": "' || year || '"' END || '}' AS record,
    '{"type": "object", "properties": {"numbers": {"type": "array", "items": {"type": "string"}}' || CASE WHEN year IS NULL THEN '' ELSE ', "year": {"type": "string"}' END || '}, "required": ["numbers"' || CASE WHEN year IS NULL THEN '' ELSE ', "year"' END || '], "additionalProperties": false}' AS schema FROM d"""
)
def extract_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the two halves of each text, merged, with their schema."""
    d = src.read_table(spark, sf, "documents").where("text is not null")
    half = F.floor(F.length("text") / 2).cast("int")

    def record(t):
        return F.to_json(F.struct(F.nullif(F.regexp_extract(t, r"(\d{4})", 1), F.lit("")).alias("year"), F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(\d{2,3})\b"), 1)).alias("numbers")))

    both = F.array(record(F.left("text", half)), record(F.substr("text", half + 1)))
    merged = d.select("doc_id", merge.merged_json(both).alias("record"))
    return merged.select("doc_id", "record", merge.schema_json(F.col("record")).alias("schema"))


def _challenge_sql() -> str:
    cases = []
    for name, codes, prefix, pattern in responses.CHALLENGES:
        tests = [f"regexp_matches(head, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"]
        if prefix:
            tests.append(f"starts_with(server, '{prefix}')")
        if codes:
            tests.append(f"status IN ({', '.join(map(str, codes))})")
        cases.append(f"WHEN {' AND '.join(tests)} THEN '{name}'")
    return f"""WITH r AS (SELECT scrape_id, metadata.status_code AS status, 'cloudflare' AS server, left(coalesce(html, ''), {responses.SCANNED}) AS head, coalesce(html, '') AS body FROM scrapes),
    k AS (SELECT scrape_id, CASE {' '.join(cases)} WHEN status IN (403, 429) AND length(trim(body)) < 500 THEN 'silent_block' END AS type FROM r)
    SELECT scrape_id, type IS NOT NULL AS detected, type FROM k"""


@query(_challenge_sql())
def response_challenges(spark: SparkSession, sf: str) -> DataFrame:
    headers = F.create_map(F.lit("server"), F.lit("cloudflare"))
    rows = _scrapes(spark, sf).select("scrape_id", responses.detect_challenge(F.col("metadata.status_code"), headers, U(HTML)).alias("c"))
    return rows.select("scrape_id", "c.detected", "c.type")


_NEEDS = r"""(regexp_matches(html, '(?i)<div\s+id=["''](?:root|app|__next|__nuxt)["'']>\s*</div>') OR regexp_matches(html, '(?is)<noscript>.*?enable javascript') OR regexp_matches(html, '(?i)__NEXT_DATA__')
    OR regexp_matches(html, '(?i)window\.__NUXT__') OR regexp_matches(html, '(?i)<div\s+id=["'']gatsby-')
    OR length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) < 200)"""


@query(f"SELECT scrape_id, {_NEEDS} AS needs_scripts FROM scrapes WHERE html IS NOT NULL")
def response_needs_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", responses.needs_scripts(U(HTML)).alias("needs_scripts"))


@query(
    f"""WITH u AS (SELECT scrape_id, url, scraped_at, lower({_part('url', 2)}) AS d, html, {_NEEDS} AS own FROM scrapes),
    f AS (SELECT d, arg_min(own, (scraped_at, url)) AS needs_scripts FROM u WHERE own IS NOT NULL GROUP BY d)
    SELECT scrape_id, needs_scripts FROM u JOIN f USING (d)"""
)
def response_needs_scripts_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return responses.needs_scripts_by_domain(_scrapes(spark, sf).select("scrape_id", "url", "html", "scraped_at")).select("scrape_id", "needs_scripts").where("needs_scripts is not null")


@query(
    """WITH d AS (SELECT DISTINCT * FROM network_events), r AS (SELECT event_id, status, resp_headers['retry-after'] AS v FROM d WHERE kind = 'response')
    SELECT event_id, CASE WHEN status = 429 THEN try_cast(trim(v) AS DOUBLE) END AS seconds FROM r"""
)
def response_retry_after(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "network_events").where("kind = 'response'").dropDuplicates(["event_id"])
    return rows.select("event_id", responses.retry_after(F.col("status"), F.col("resp_headers"), F.col("ts")).alias("seconds"))


@query(
    f"""WITH d AS (SELECT DISTINCT event_id, resp_headers FROM network_events WHERE resp_headers IS NOT NULL)
    SELECT event_id, len(list_filter(map_keys(resp_headers), lambda k: lower(k) NOT IN ({', '.join(repr(h) for h in responses.REFUSED_HEADERS)})))::INTEGER AS headers FROM d"""
)
def response_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "network_events").where("resp_headers is not null").dropDuplicates(["event_id"])
    return rows.select("event_id", F.size(F.map_keys(responses.sanitize_headers(F.col("resp_headers")))).alias("headers"))


@query(
    """WITH d AS (SELECT DISTINCT event_id, scrape_id, url, method, resource_type, kind, ts, status, resp_headers FROM network_events WHERE scrape_id IS NOT NULL),
    o AS (SELECT *, last_value(CASE WHEN kind = 'request' THEN {'m': method, 'r': resource_type, 't': ts} END IGNORE NULLS) OVER (PARTITION BY scrape_id, url ORDER BY ts, CASE WHEN kind = 'request' THEN 0 ELSE 1 END, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM d)
    SELECT event_id, scrape_id, url, q.m AS method, q.r AS resource_type, epoch_us(q.t) AS requested_at, status, (epoch_us(ts) - epoch_us(q.t)) / 1000 AS response_time_ms, coalesce(resp_headers['content-type'], '') AS content_type
    FROM o WHERE kind = 'response' AND q IS NOT NULL"""
)
def response_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from pagemill.functions.time import micros

    return responses.pair_events(src.read_table(spark, sf, "network_events")).withColumn("requested_at", micros("requested_at"))


@query("SELECT scrape_id, regexp_matches(url, '^(?i)https?://') AS public FROM scrapes")
def response_public_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).select("scrape_id", responses.is_public_url(U("url")).alias("public"))


@query(
    """WITH p AS (SELECT page_host AS client, count(*) AS n, sum(response_time_ms) AS ms, count_if(status >= 400) AS e, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b, count(DISTINCT resource_type) AS k FROM network_events GROUP BY 1)
    SELECT client, n AS total_requests, round(coalesce(ms, 0), 3) AS total_bandwidth_bytes, e::BIGINT AS total_errors, k::INTEGER AS endpoints, a AS first_seen, b AS last_seen, round(e / greatest(n, 1), 4) AS error_rate FROM p"""
)
def usage_by_client(spark: SparkSession, sf: str) -> DataFrame:
    from pagemill.functions.time import micros

    rows = usage.usage_by_client(src.read_table(spark, sf, "network_events"), "page_host", "resource_type", "ts", F.col("response_time_ms"), F.coalesce(F.col("status") >= 400, F.lit(False)))
    return rows.select("client", "total_requests", F.round("total_bandwidth_bytes", 3).alias("total_bandwidth_bytes"), "total_errors", F.size("endpoints").alias("endpoints"), micros("first_seen").alias("first_seen"), micros("last_seen").alias("last_seen"), "error_rate")


@query(
    """SELECT count(*) AS total_requests, round(sum(value), 2) AS total_bandwidth_bytes, count_if(event_type = 'error')::BIGINT AS total_errors, count(DISTINCT user_id) AS unique_clients,
    round(count_if(event_type = 'error') / greatest(count(*), 1), 4) AS error_rate FROM events"""
)
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.usage_summary(src.read_table(spark, sf, "events"), "user_id", F.col("value"), F.col("event_type") == "error")
    return out.withColumn("total_bandwidth_bytes", F.round("total_bandwidth_bytes", 2))


@query("SELECT user_id AS client, count(*) AS requests FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def usage_top_clients(spark: SparkSession, sf: str) -> DataFrame:
    return usage.top_clients(src.read_table(spark, sf, "events"), "user_id")


@query("SELECT event_type AS endpoint, count(*) AS requests FROM events GROUP BY 1")
def usage_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return usage.endpoint_totals(src.read_table(spark, sf, "events"), "event_type")


@query(
    f"""WITH d AS (SELECT nullif(lower(regexp_replace(regexp_replace({_part('url', 2)}, '^.*@', ''), ':[0-9]*$', '')), '') AS domain, success AS ok FROM scrapes)
    SELECT domain, count_if(ok)::BIGINT AS success, count_if(NOT ok)::BIGINT AS failed, count(*) AS total, round(count_if(ok) / count(*), 3) AS success_rate FROM d WHERE domain IS NOT NULL AND ok IS NOT NULL GROUP BY domain"""
)
def usage_domains(spark: SparkSession, sf: str) -> DataFrame:
    return usage.domain_stats(_scrapes(spark, sf), F.nullif(fu.host(U("url")), F.lit("")), F.col("success"))


def _histogram_sql(compat: bool) -> str:
    part = "sum(n) OVER (ORDER BY position)" if compat else "n"
    rows = " UNION ALL ".join(f"SELECT {i} AS position, '{b}' AS le, count_if(v <= {b}) AS n FROM x" for i, b in enumerate(usage.BOUNDS))
    return f"""WITH x AS (SELECT response_time_ms / 1000 AS v FROM network_events WHERE response_time_ms IS NOT NULL), b AS ({rows})
    SELECT position, le, {part}::BIGINT AS n FROM b UNION ALL SELECT {len(usage.BOUNDS)}, '+Inf', count(*) FROM x"""


@query(_histogram_sql(False))
def usage_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return usage.histogram(src.read_table(spark, sf, "network_events"), F.col("response_time_ms") / 1000)


@query(_histogram_sql(True))
def usage_histogram_compat(spark: SparkSession, sf: str) -> DataFrame:
    return usage.histogram(src.read_table(spark, sf, "network_events"), F.col("response_time_ms") / 1000, compat=True)


@query(
    """WITH v AS (SELECT proxy_url, latency, row_number() OVER (PARTITION BY proxy_url ORDER BY ts DESC, latency DESC) AS r, count(*) OVER (PARTITION BY proxy_url) AS n FROM proxy_events WHERE latency IS NOT NULL),
    k AS (SELECT *, CASE WHEN n <= 1000 THEN n ELSE 500 + (n - 1001) % 501 END AS m FROM v), s AS (SELECT proxy_url, any_value(n) AS n, list(latency ORDER BY latency) AS xs FROM k WHERE r <= m GROUP BY proxy_url)
    SELECT proxy_url, n AS acquires, round(list_avg(xs), 4) AS avg_ms, round(xs[least(floor(len(xs) * 0.95)::BIGINT, len(xs) - 1) + 1], 4) AS p95_ms FROM s"""
)
def usage_acquire_stats(spark: SparkSession, sf: str) -> DataFrame:
    return usage.acquire_stats(src.read_table(spark, sf, "proxy_events"), "proxy_url", "ts", "latency", digits=4)


@query(
    """SELECT 'requests' AS name, '# HELP mill_requests Stored results' || chr(10) || '# TYPE mill_requests counter' || chr(10) || 'mill_requests ' || count(*) AS text FROM scrapes
    UNION ALL SELECT 'failed', '# HELP mill_failed Failed fetches' || chr(10) || '# TYPE mill_failed counter' || chr(10) || 'mill_failed ' || count_if(NOT success) FROM scrapes"""
)
def usage_prometheus(spark: SparkSession, sf: str) -> DataFrame:
    row = _scrapes(spark, sf).agg(F.count("*").alias("a"), F.count_if(~F.col("success")).alias("b"))
    entries = F.array(F.struct(F.lit("requests").alias("name"), F.lit("Stored results").alias("help"), F.col("a").alias("value")), F.struct(F.lit("failed").alias("name"), F.lit("Failed fetches").alias("help"), F.col("b").alias("value")))
    return usage.prometheus(row.select(F.inline(entries)), "mill_")


_PROXIES = """WITH RECURSIVE e AS (SELECT proxy_url AS p, epoch_us(ts) / 1e6 AS t, kind, latency, row_number() OVER (PARTITION BY proxy_url ORDER BY epoch_us(ts) / 1e6, kind, latency NULLS FIRST) AS rn
      FROM proxy_events WHERE ts IS NOT NULL AND proxy_url IS NOT NULL AND kind IN ('ok', 'fail', 'timeout')),
    s AS (
      SELECT p, rn, kind = 'ok' AS ok, CASE WHEN kind = 'ok' THEN coalesce(latency, 0.0) ELSE 0.0 END AS speed, t AS began, CASE WHEN kind <> 'ok' THEN t + 60.0 END AS until,
        (kind = 'ok')::BIGINT AS succeed, (kind = 'timeout')::BIGINT AS timeouts, (kind <> 'ok')::BIGINT AS failures, 0::BIGINT AS reanimated,
        (kind = 'ok')::BIGINT AS recent_succeed, (kind = 'timeout')::BIGINT AS recent_timeouts, (kind <> 'ok')::BIGINT AS recent_failures FROM e WHERE rn = 1
      UNION ALL
      SELECT e.p, e.rn, kind = 'ok', CASE WHEN kind = 'ok' AND latency IS NOT NULL THEN CASE WHEN speed <> 0 THEN 0.7 * speed + 0.3 * latency ELSE latency END ELSE speed END,
        CASE WHEN t - began >= 300 THEN t ELSE began END, CASE WHEN kind <> 'ok' THEN t + 60.0 END,
        succeed + (kind = 'ok')::BIGINT, timeouts + (kind = 'timeout')::BIGINT, failures + (kind <> 'ok')::BIGINT, reanimated + (until IS NOT NULL AND t >= until)::BIGINT,
        CASE WHEN t - began >= 300 THEN 0 ELSE recent_succeed END + (kind = 'ok')::BIGINT, CASE WHEN t - began >= 300 THEN 0 ELSE recent_timeouts END + (kind = 'timeout')::BIGINT,
        CASE WHEN t - began >= 300 THEN 0 ELSE recent_failures END + (kind <> 'ok')::BIGINT
      FROM s JOIN e ON e.p = s.p AND e.rn = s.rn + 1),
    l AS (SELECT p, max(rn) AS rn FROM e GROUP BY p)"""


@query(
    f"""{_PROXIES} SELECT p AS proxy_url, ok, round(speed, 6) AS speed, succeed, timeouts, failures, reanimated, recent_succeed, recent_timeouts, recent_failures, recent_succeed = 0 AND recent_failures >= 5 AS evict FROM s JOIN l USING (p, rn)"""
)
def state_proxies(spark: SparkSession, sf: str) -> DataFrame:
    return state.proxy_state(src.read_table(spark, sf, "proxy_events")).withColumn("speed", F.round("speed", 6))


@query(
    f"""{_PROXIES} SELECT count(*) AS total, count_if(ok)::BIGINT AS active, count_if(NOT ok)::BIGINT AS evicted, round(coalesce(avg(CASE WHEN ok AND speed > 0 THEN speed END), 0.0), 4) AS avg_speed FROM s JOIN l USING (p, rn)"""
)
def state_pool(spark: SparkSession, sf: str) -> DataFrame:
    return state.pool_stats(state.proxy_state(src.read_table(spark, sf, "proxy_events")))


@query(
    """WITH RECURSIVE e AS (SELECT page_host AS k, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY page_host ORDER BY epoch_us(ts) / 1e6, event_id) AS rn
      FROM (SELECT DISTINCT event_id, page_host, ts FROM network_events) WHERE page_host IS NOT NULL AND ts IS NOT NULL),
    s AS (SELECT k, rn, event_id, t, 1.0::DOUBLE AS level, true AS allowed FROM e WHERE rn = 1
      UNION ALL
      SELECT e.k, e.rn, e.event_id, e.t, greatest(0.0, level - (e.t - s.t) * 2 / 60.0) + CASE WHEN greatest(0.0, level - (e.t - s.t) * 2 / 60.0) + 1 <= 2 THEN 1 ELSE 0 END, greatest(0.0, level - (e.t - s.t) * 2 / 60.0) + 1 <= 2
      FROM s JOIN e ON e.k = s.k AND e.rn = s.rn + 1)
    SELECT k AS page_host, event_id, allowed FROM s"""
)
def state_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return state.admitted(src.read_table(spark, sf, "network_events").dropDuplicates(["event_id"]), "page_host", 2, "event_id")


@query(
    """WITH RECURSIVE e AS (SELECT coalesce(page_host, '') || '-' || coalesce(method, '') AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY coalesce(page_host, '') || '-' || coalesce(method, '') ORDER BY ts, event_id) AS rn
      FROM (SELECT DISTINCT event_id, page_host, method, ts FROM network_events WHERE kind = 'request') WHERE ts IS NOT NULL),
    s AS (SELECT k, rn, event_id, t AS opened, false AS replayed FROM e WHERE rn = 1
      UNION ALL SELECT e.k, e.rn, e.event_id, CASE WHEN t - opened >= 86400000000 THEN t ELSE opened END, t - opened < 86400000000 FROM s JOIN e ON e.k = s.k AND e.rn = s.rn + 1)
    SELECT event_id, replayed FROM s"""
)
def state_replays(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "network_events").dropDuplicates(["event_id"]).where("kind = 'request'")
    return state.first_of_day(rows, ["page_host", "method"], "event_id")


@query(
    """WITH r AS (SELECT job_id, success, scraped_at FROM scrapes WHERE job_id IS NOT NULL)
    SELECT job_id, arg_max(CASE WHEN success THEN 'completed' ELSE 'failed' END, scraped_at) AS status, epoch_us(max(scraped_at)) AS updated_at FROM r GROUP BY job_id"""
)
def state_job_status(spark: SparkSession, sf: str) -> DataFrame:
    from pagemill.functions.time import micros

    rows = _scrapes(spark, sf).where("job_id is not null").withColumn("status", F.when(F.col("success"), "completed").otherwise("failed"))
    return state.latest_status(rows, "job_id", "status", "scraped_at").withColumn("updated_at", micros("updated_at"))


@query(
    f"""{_URLS.replace('url, scraped_at', 'url, scraped_at, text')}, t AS (SELECT scrape_id, {_KEY} AS page, scraped_at, sha256(text) AS h FROM u WHERE text IS NOT NULL),
    l AS (SELECT *, lag(h) OVER (PARTITION BY page ORDER BY scraped_at, scrape_id) AS b FROM t)
    SELECT scrape_id, b AS previous_hash, h AS current_hash, CASE WHEN b IS NULL THEN 'added' WHEN b = h THEN 'unchanged' ELSE 'modified' END AS change_type FROM l"""
)
def changes_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scrapes(spark, sf).select("scrape_id", "text", "scraped_at", fu.dedup_key(U("url")).alias("page"))
    return changes.snapshots_changes(rows, "page", tie="scrape_id").select("scrape_id", "previous_hash", "current_hash", "change_type")


@query()
def changes_differences(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scrapes(spark, sf).select("scrape_id", "text", "scraped_at", fu.dedup_key(U("url")).alias("page"))
    return changes.snapshots_changes(rows, "page", tie="scrape_id", with_difference=True).where("change_type = 'modified'").select("scrape_id", "diff_summary")


@query(
    f"""{_URLS.replace('url, scraped_at', 'url, scraped_at, text')}, t AS (SELECT {_KEY} AS page, text, scraped_at FROM u WHERE text IS NOT NULL)
    SELECT page, arg_max(text, (scraped_at, text)) AS text FROM t GROUP BY page"""
)
def changes_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scrapes(spark, sf).select("text", "scraped_at", fu.dedup_key(U("url")).alias("page"))
    return changes.latest_snapshots(rows, "page").select("page", "text")


@query(
    f"""{_URLS.replace('url, scraped_at', 'url, scraped_at, text')}, t AS (SELECT {_KEY} AS page, text, scraped_at FROM u WHERE text IS NOT NULL),
    a AS (SELECT page, sha256(arg_max(text, (scraped_at, text))) AS h FROM t WHERE scraped_at < TIMESTAMP '2024-03-01' GROUP BY page),
    b AS (SELECT page, sha256(arg_max(text, (scraped_at, text))) AS h FROM t WHERE scraped_at >= TIMESTAMP '2024-03-01' GROUP BY page)
    SELECT coalesce(a.page, b.page) AS page, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change_type FROM a FULL JOIN b ON a.page = b.page"""
)
def changes_compared(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scrapes(spark, sf).select("text", "scraped_at", fu.dedup_key(U("url")).alias("page"))
    split = F.lit("2024-03-01").cast("timestamp_ntz")
    before, after = (changes.latest_snapshots(x, "page") for x in (rows.where(F.col("scraped_at") < split), rows.where(F.col("scraped_at") >= split)))
    return changes.compare_snapshots(before, after, "page").select("page", "change_type")


@query(
    f"""WITH h AS (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM scrapes WHERE html IS NOT NULL),
    l AS (SELECT url, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS position FROM h), a AS (SELECT url, position::INTEGER AS position, {_absolute('url', 'href')} AS dst FROM l)
    SELECT {_normalized('url')} AS src, {_normalized('dst')} AS dst, position FROM a WHERE lower({_part('dst', 1)}) IN ('http', 'https')"""
)
def crawl_edges(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.edges(src.pages(spark, sf))


@query(
    f"""WITH RECURSIVE h AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM scrapes WHERE html IS NOT NULL), a AS (SELECT url, {_absolute('url', 'href')} AS dst FROM h),
    e AS (SELECT DISTINCT {_normalized('url')} AS src, {_normalized('dst')} AS dst, {_part('dst', 2)} AS n FROM a WHERE lower({_part('dst', 1)}) IN ('http', 'https')),
    s AS (SELECT DISTINCT {_normalized('url')} AS seed FROM crawl_jobs WHERE url IS NOT NULL),
    r AS (SELECT seed, seed AS url, 0 AS depth FROM s UNION SELECT seed, dst, depth + 1 FROM r JOIN e ON r.url = e.src WHERE depth < 3 AND n = {_part('seed', 2)})
    SELECT seed, url, min(depth)::INTEGER AS depth FROM r GROUP BY ALL"""
)
def crawl_breadth_first(spark: SparkSession, sf: str) -> DataFrame:
    seeds = src.read_table(spark, sf, "crawl_jobs").where("url is not null").select(F.col("url").alias("seed"))
    return crawl.breadth_first(crawl.edges(src.pages(spark, sf)), seeds, max_depth=3)


@query()
def crawl_best_first(spark: SparkSession, sf: str) -> DataFrame:
    seeds = src.read_table(spark, sf, "crawl_jobs").where("url is not null").select(F.col("url").alias("seed"))
    return crawl.crawl(crawl.edges(src.pages(spark, sf)), seeds, "best_first", max_pages=50, max_depth=3, keywords=["guide"])


@query()
def crawl_depth_first(spark: SparkSession, sf: str) -> DataFrame:
    seeds = src.read_table(spark, sf, "crawl_jobs").where("url is not null").select(F.col("url").alias("seed"))
    return crawl.crawl(crawl.edges(src.pages(spark, sf)), seeds, "dfs", max_pages=50, max_depth=3)


def _first_level_sql(order: str) -> str:
    score = f"""0.5 + CASE WHEN length(p) - length(replace(p, '/', '')) <= 2 THEN 0.15 WHEN length(p) - length(replace(p, '/', '')) >= 5 THEN -0.15 ELSE 0 END + CASE WHEN contains(lower(dst), 'guide') THEN 0.2 ELSE 0 END
      + CASE WHEN regexp_matches(lower(p), '/({'|'.join(fu.HIGH_VALUE)})') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(lower(p), '/({'|'.join(fu.LOW_VALUE)})') THEN 0.2 ELSE 0 END - CASE WHEN q <> '' AND length(q) - length(replace(q, '&', '')) + 1 > 3 THEN 0.1 ELSE 0 END"""
    return f"""WITH k AS (SELECT {_normalized('url')} AS src, arg_max(url, scrape_id) AS url, arg_max(html, scrape_id) AS html FROM scrapes WHERE html IS NOT NULL GROUP BY 1),
    h AS (SELECT src, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM k), l AS (SELECT src, url, unnest(hrefs) AS href, unnest(range(0, len(hrefs))) AS position FROM h),
    a AS (SELECT src, position, {_absolute('url', 'href')} AS link FROM l), e AS (SELECT src, position, {_normalized('link')} AS dst FROM a WHERE lower({_part('link', 1)}) IN ('http', 'https')),
    o AS (SELECT src, dst, min(position) AS first, max(position) AS last FROM e WHERE {_part('src', 2)} = {_part('dst', 2)} AND dst <> src GROUP BY 1, 2),
    w AS (SELECT *, {_path('dst')} AS p, {_part('dst', 4)} AS q FROM o), v AS (SELECT *, greatest(0.0, least(1.0, {score})) AS worth FROM w),
    r AS (SELECT src AS seed, dst AS url, row_number() OVER (PARTITION BY src ORDER BY {order}) AS seq FROM v)
    SELECT src AS seed, 0::INTEGER AS seq, src AS url, 0::INTEGER AS depth FROM k UNION ALL SELECT seed, seq::INTEGER, url, 1::INTEGER FROM r WHERE seq < 50"""


def _crawl_of_pages(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    """Every stored page, in its last version, as the seed of a crawl that goes one link deep."""
    key = fu.normalize_url(U("url"))
    last = src.pages(spark, sf).where("html is not null").groupBy(key.alias("seed")).agg(F.max_by("url", "page_id").alias("url"), F.max_by("html", "page_id").alias("html"))
    return crawl.crawl(crawl.edges(last), last.select("seed"), strategy, max_pages=50, max_depth=1, keywords=["guide"])


@query(_first_level_sql("last DESC"))
def crawl_pages_depth_first(spark: SparkSession, sf: str) -> DataFrame:
    return _crawl_of_pages(spark, sf, "dfs")


@query(_first_level_sql("round(worth, 6) DESC, first"))
def crawl_pages_best_first(spark: SparkSession, sf: str) -> DataFrame:
    return _crawl_of_pages(spark, sf, "best_first")


@query(_first_level_sql("first"))
def crawl_pages_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return _crawl_of_pages(spark, sf, "bfs")


@query(
    f"""WITH k AS (SELECT lower({_part('url', 1)}) || '://' || {_part('url', 2)} AS base, html FROM scrapes WHERE html IS NOT NULL),
    l AS (SELECT DISTINCT base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM k), a AS (SELECT base, {_absolute('base', 'href')} AS u FROM l),
    f AS (SELECT * FROM a WHERE lower({_part('u', 1)}) IN ('http', 'https') AND lower(regexp_replace(regexp_replace({_part('u', 2)}, '^.*@', ''), ':[0-9]*$', '')) = lower(regexp_replace(regexp_replace({_part('base', 2)}, '^.*@', ''), ':[0-9]*$', '')))
    SELECT DISTINCT base, lower({_part('u', 1)}) || '://' || {_part('u', 2)} || CASE WHEN regexp_replace({_path('u')}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_path('u')}, '/+$', '') END AS url, 'homepage' AS source FROM f"""
)
def crawl_map_homepages(spark: SparkSession, sf: str) -> DataFrame:
    """Bases without a site map: links of their pages."""
    homes = src.pages(spark, sf).where("html is not null").select(fu.get_base_url(U("url")).alias("base"), "html")
    maps = spark.createDataFrame([("https://nowhere.invalid", 0, "<urlset/>")], "base string, priority int, xml string")
    return crawl.discover(maps, homes).distinct()


@query(
    f"""WITH j AS (SELECT job_id AS id, url AS seed FROM crawl_jobs) SELECT scrape_id, {_part('url', 2)} = {_part('seed', 2)} AS same_domain,
    lower(regexp_replace(regexp_replace({_part('url', 2)}, '^.*@', ''), ':[0-9]*$', '')) = 'kelmora-daily.example' AS of_site, regexp_matches(job_id, '^[a-f0-9]{{12}}$') AS is_job FROM scrapes JOIN j ON job_id = id"""
)
def url_domains(spark: SparkSession, sf: str) -> DataFrame:
    jobs = src.read_table(spark, sf, "crawl_jobs").select("job_id", F.col("url").alias("seed"))
    rows = _scrapes(spark, sf).select("scrape_id", "job_id", "url").join(jobs, "job_id")
    return rows.select("scrape_id", fu.is_same_domain(U("url"), F.col("seed")).alias("same_domain"), fu.matches_domain(U("url"), "kelmora-daily.example").alias("of_site"), src.is_job_id(F.col("job_id")).alias("is_job"))


@query(
    """WITH l AS (SELECT scrape_id, unnest(regexp_extract_all(html, '<li>(?:<span>)?<a href="[^"]*"')) AS x FROM scrapes WHERE html IS NOT NULL)
    SELECT scrape_id, regexp_extract(x, 'href="([^"]*)"', 1) AS target, count(*) AS times FROM l GROUP BY ALL"""
)
def extract_css_items(spark: SparkSession, sf: str) -> DataFrame:
    """A record per list item that holds a link."""
    spec = {"container": "li", "fields": {"target": {"selector": "a", "attribute": "href"}}}
    rows = _with_html(spark, sf).select("scrape_id", F.explode(pages.extract(U(HTML), "css", spec)).alias("r"))
    return rows.select("scrape_id", F.col("r")["target"][0].alias("target")).where("target is not null").groupBy("scrape_id", "target").agg(F.count("*").alias("times"))


@query(
    rf"""WITH m AS (SELECT scrape_id, regexp_extract_all({_PLAIN}, '(\d+) per cent', 1) AS a, regexp_extract_all({_PLAIN}, '\d+ weeks') AS b FROM scrapes WHERE html IS NOT NULL)
    SELECT scrape_id, array_to_string(a, ',') AS shares, array_to_string(b, ',') AS spans FROM m"""
)
def extract_regex_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", pages.extract(U(HTML), "regex", {"shares": r"(\d+) per cent", "spans": r"\d+ weeks"})[0].alias("r"))
    return rows.select("scrape_id", *(F.array_join(F.coalesce(F.col("r")[k], F.array().cast("array<string>")), ",").alias(k) for k in ("shares", "spans")))


@query("""SELECT scrape_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM scrapes WHERE html IS NOT NULL""")
def extract_xpath_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", pages.extract(U(HTML), "xpath", {"links": "//a/@href"})[0].alias("r"))
    return rows.select("scrape_id", F.explode(F.col("r")["links"]).alias("href"))


@query(
    f"""WITH l AS (SELECT scrape_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM scrapes WHERE html IS NOT NULL)
    SELECT scrape_id, {_absolute('url', 'href')} AS href FROM l WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:)')"""
)
def page_media_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_html(spark, sf).select("scrape_id", F.explode(pages.media(U(HTML), U("url"))["links"]).alias("l"))
    return rows.select("scrape_id", "l.href")


@query(
    r"""WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\t\n\v\f\r ]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, regexp_replace(s, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g') AS sentence FROM c) SELECT * FROM t WHERE sentence <> ''"""
)
def text_sentence_list(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(ft.split_sentences(U(TEXT))).alias("sentence"))


@query(
    f"""WITH d AS (SELECT DISTINCT event_id, resp_headers FROM network_events WHERE resp_headers IS NOT NULL), e AS (SELECT event_id, unnest(map_entries(resp_headers)) AS h FROM d)
    SELECT event_id, h.key AS name, h.value AS value FROM e WHERE lower(h.key) NOT IN ({', '.join(repr(h) for h in responses.REFUSED_HEADERS)})"""
)
def response_header_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "network_events").where("resp_headers is not null").dropDuplicates(["event_id"])
    return rows.select("event_id", F.explode(responses.sanitize_headers(F.col("resp_headers"))).alias("name", "value"))


@query(f"""{_PROXIES} SELECT p AS proxy_url, succeed FROM s JOIN l USING (p, rn) WHERE ok ORDER BY succeed, p LIMIT 1""")
def state_least_used(spark: SparkSession, sf: str) -> DataFrame:
    return state.least_used(state.proxy_state(src.read_table(spark, sf, "proxy_events")), "succeed").select("proxy_url", "succeed")


@query("SELECT scrape_id, coalesce(job_id, 'none') AS job_type, url FROM scrapes")
def source_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results written as JSON by type and read back."""
    rows = _scrapes(spark, sf).select("scrape_id", F.coalesce("job_id", F.lit("none")).alias("job_type"), "url")
    folder = new_path(spark)
    src.write_results(rows.repartition("job_type"), folder)
    return src.read_results(spark, folder, rows.schema).select("scrape_id", "job_type", "url")


@query("SELECT job_id, url, 0::INTEGER AS depth FROM crawl_jobs")
def source_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """State of a crawl saved, replaced and loaded."""
    rows = src.read_table(spark, sf, "crawl_jobs").select("job_id", "url", F.lit(0).alias("depth"))
    folder = new_path(spark)
    for _ in range(2):
        src.save_checkpoint(rows, folder, "job")
    return src.load_checkpoint(spark, folder, "job")


@query("""SELECT event_id, 'event: ' || kind || chr(10) || 'data: {"event_id":' || event_id || ',"kind":"' || kind || '"}' || chr(10) || chr(10) AS frame FROM network_events""")
def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "network_events")
    return rows.select("event_id", streams.event_frame(F.col("kind"), F.to_json(F.struct("event_id", "kind"))).alias("frame"))


@query(
    f"""WITH s AS (SELECT {_part('url', 2)} AS n, list(DISTINCT lower({_part('url', 1)}) || '://' || {_part('url', 2)} || {_path('url')}) AS urls FROM scrapes GROUP BY 1),
    e AS (SELECT n, unnest(urls) AS url FROM s WHERE n <> '') SELECT 'https://' || n AS base, url, 'sitemap' AS source FROM e"""
)
def crawl_map(spark: SparkSession, sf: str) -> DataFrame:
    """Site maps written from the stored addresses, read back."""
    rows = _scrapes(spark, sf).select(fu.netloc(U("url")).alias("n"), fu.sitemap_key(U("url")).alias("url")).where("n <> ''").distinct()
    entry = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = rows.groupBy(F.concat(F.lit("https://"), F.col("n")).alias("base")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    pages_ = src.pages(spark, sf).where("false").select(F.col("url").alias("base"), "html")
    return crawl.discover(maps.withColumn("priority", F.lit(0)), pages_, limit=1_000_000_000)


@query(
    f"""WITH k AS (SELECT DISTINCT {_normalized('url')} AS key FROM scrapes)
    SELECT job_id AS query, 1 AS position, url, {_normalized('url')} IN (SELECT key FROM k) AS found FROM crawl_jobs"""
)
def crawl_search(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of jobs looked up among the stored pages."""
    results = src.read_table(spark, sf, "crawl_jobs").select(F.col("job_id").alias("query"), F.lit(1).alias("position"), "url")
    return crawl.search(results, _scrapes(spark, sf))


@query("SELECT job_id, created_at, (SELECT count(*) FROM crawl_jobs) AS total, (SELECT count(*) FROM crawl_jobs) > 10 AS has_next FROM crawl_jobs ORDER BY created_at DESC, job_id LIMIT 5 OFFSET 5")
def crawl_jobs_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "crawl_jobs").select("job_id", "created_at", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"))
    return crawl.page_of(rows, 2, 5, ["o", "job_id"]).drop("o")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = src.read_table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name[:-1]}[{name[-1]}].parquet")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is and read its last result back from the shared folder."""
    spark = stream.sparkSession
    folder = new_path(spark)

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    """SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_start, page_host AS client, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors FROM network_events GROUP BY 1, 2"""
)
def stream_usage(spark: SparkSession, sf: str) -> DataFrame:
    events = _stream(spark, sf, "network_events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(streams.usage_windows(events, "ts", "page_host", F.coalesce(F.col("status") >= 400, F.lit(False))), "complete")
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query("SELECT DISTINCT event_id, kind FROM network_events")
def stream_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    events = _stream(spark, sf, "network_events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(streams.idempotent(events, ["event_id"], "ts", "3650 days").select("event_id", "kind"), "append")


@query(
    """WITH r AS (SELECT job_id, success, scraped_at FROM scrapes WHERE job_id IS NOT NULL)
    SELECT job_id, arg_max(CASE WHEN success THEN 'completed' ELSE 'failed' END, scraped_at) AS status FROM r GROUP BY job_id"""
)
def stream_job_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "scrapes").where("job_id is not null").select("job_id", F.when(F.col("success"), "completed").otherwise("failed").alias("status"), F.col("scraped_at").cast("timestamp").alias("at"))
    return _drained(streams.job_status(rows, "job_id", "status", "at"), "complete").select("job_id", "status")


@query(
    r"""WITH t AS (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS s FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, list_filter(string_split(s, chr(10) || chr(10)), lambda x: regexp_replace(x, '[\t\n\v\f\r ]+', '', 'g') <> '') AS ps FROM t)
    SELECT doc_id, '<html><head><title>PDF Document</title></head><body>' || chr(10) || array_to_string(list_transform(ps, lambda x: '<p>' || x || '</p>'), chr(10)) || chr(10) || '</body></html>' AS html FROM p"""
)
def text_pdf_to_html(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_table(spark, sf, "documents").where("text is not null").select("doc_id", ft.pdf_text_to_html(U(TEXT)).alias("html"))


@query(
    """WITH p AS (SELECT scrape_id, '## Web Page Content' || chr(10) || chr(10) || markdown || chr(10) || chr(10) || '## Extraction Task' || chr(10) || chr(10) || 'List all names.' AS prompt FROM scrapes WHERE markdown IS NOT NULL),
    h AS (SELECT scrape_id, prompt, left(prompt, 3000) AS head FROM p),
    c AS (SELECT *, length(head) - length(regexp_extract(head, '(?s).*\n\n(.*)$', 1)) - 2 AS pos, contains(head, chr(10) || chr(10)) AS has FROM h)
    SELECT scrape_id, CASE WHEN length(prompt) <= 3000 THEN prompt ELSE CASE WHEN has AND pos > 1500 THEN left(head, pos) ELSE head END || chr(10) || chr(10) || '[Content truncated]' END AS prompt FROM c"""
)
def text_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompt = ft.extraction_prompt(U(MD), F.lit("List all names."))
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", ft.truncate_prompt(prompt, 3000, 1500).alias("prompt"))


@query(
    """WITH p AS (SELECT scrape_id, '## Web Page Content' || chr(10) || chr(10) || markdown || chr(10) || chr(10) || '## Extraction Task' || chr(10) || chr(10) || 'List all names.' AS prompt FROM scrapes WHERE markdown IS NOT NULL),
    h AS (SELECT scrape_id, prompt, left(prompt, 100000) AS head FROM p),
    c AS (SELECT *, length(head) - length(regexp_extract(head, '(?s).*\n\n(.*)$', 1)) - 2 AS pos, contains(head, chr(10) || chr(10)) AS has FROM h)
    SELECT scrape_id, CASE WHEN length(prompt) <= 100000 THEN prompt ELSE CASE WHEN has AND pos > 50000 THEN left(head, pos) ELSE head END || chr(10) || chr(10) || '[Content truncated]' END AS prompt FROM c"""
)
def text_prompts_whole(spark: SparkSession, sf: str) -> DataFrame:
    """text_prompts with the operator's own limits."""
    prompt = ft.extraction_prompt(U(MD), F.lit("List all names."))
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", ft.truncate_prompt(prompt).alias("prompt"))


@query(
    f"""WITH k AS (SELECT scrape_id, left(sha256({_normalized('url')} || chr(10) || '[{{"k":"formats","v":"markdown"}}' || CASE WHEN metadata.language IS NULL THEN '' ELSE ',{{"k":"language","v":"' || metadata.language || '"}}' END || ']'), 16) AS key FROM scrapes)
    SELECT scrape_id, key, count(*) OVER (PARTITION BY key) AS requests FROM k"""
)
def text_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Key of each request, and whether another request has it too."""
    keyed = _scrapes(spark, sf).select("scrape_id", ft.cache_key(fu.normalize_url(U("url")), {"language": F.col("metadata.language"), "formats": F.lit("markdown")}).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("requests")), "key")


@query(
    f"""{_URLS} SELECT scrape_id, regexp_extract(lower(p), '(\\.[^.]*)$', 1) AS extension, lower(s) IN ('http', 'https') AND n <> '' AND n = 'kelmora-daily.example' AS crawlable FROM u"""
)
def url_crawlable(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).select("scrape_id", fu.extension(U("url")).alias("extension"), fu.crawlable(U("url"), F.lit("https://kelmora-daily.example/")).alias("crawlable"))


@query(
    f"""{_URLS}, h AS (SELECT scrape_id, s || '://' || n AS base, p || {_QS} AS path FROM u),
    r AS (SELECT * FROM (VALUES ('https://kelmora-daily.example', false, '/archiv'), ('https://kelmora-daily.example', true, '/archiv/a'), ('https://dunemil-ra.invalid', false, '/')) v(base, allow, prefix)),
    f AS (SELECT scrape_id, arg_max(allow, (length(prefix), allow)) AS allow FROM h JOIN r USING (base) WHERE starts_with(path, prefix) GROUP BY scrape_id)
    SELECT scrape_id, coalesce(allow, true) AS allowed FROM scrapes LEFT JOIN f USING (scrape_id)"""
)
def url_robots(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("https://kelmora-daily.example", False, "/archiv"), ("https://kelmora-daily.example", True, "/archiv/a"), ("https://dunemil-ra.invalid", False, "/")], "base string, allow boolean, prefix string")
    return crawl.allowed_by_robots(_scrapes(spark, sf).select("scrape_id", "url"), rules).select("scrape_id", "allowed")


@query(
    r"""SELECT scrape_id, regexp_matches(html, '(?i)display: ?none|visibility: ?hidden|opacity: ?0|left:-9999|top:-9999|position:absolute|aria-hidden="true"') AS hidden_links, regexp_matches(left(html, 10000), '(?i)<meta[^>]*name="(robots|googlebot)"[^>]*noindex') AS noindex FROM scrapes WHERE html IS NOT NULL"""
)
def page_noindex(spark: SparkSession, sf: str) -> DataFrame:
    links = pages.crawl_links(U(HTML), U("url"))
    rows = _with_html(spark, sf).select("scrape_id", F.exists(links, lambda x: x["hidden"]).alias("hidden_links"), pages.noindex(U(HTML)).alias("noindex"))
    return rows


@query(
    f"""SELECT scrape_id, error, len(list_filter({list(responses.PROXY_ERRORS)!r}, lambda p: contains(lower(error), p))) > 0 AS proxy_error FROM scrapes WHERE error IS NOT NULL"""
)
def response_proxy_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).where("error is not null").select("scrape_id", "error", responses.is_proxy_error(F.col("error")).alias("proxy_error"))


@query(
    """SELECT scrape_id, CASE WHEN contains(html, 'cType: ''non-interactive''') OR contains(html, 'cType: "non-interactive"') THEN 'non-interactive' WHEN contains(html, 'cType: ''managed''') OR contains(html, 'cType: "managed"') THEN 'managed'
    WHEN contains(html, 'cType: ''interactive''') OR contains(html, 'cType: "interactive"') THEN 'interactive' WHEN contains(html, 'challenges.cloudflare.com/turnstile') THEN 'embedded_turnstile' END AS kind FROM scrapes WHERE html IS NOT NULL"""
)
def response_interactive_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _with_html(spark, sf).select("scrape_id", responses.cloudflare_kind(U(HTML)).alias("kind"))


@query("SELECT scrape_id, base64(encode(markdown)) AS encoded FROM scrapes WHERE markdown IS NOT NULL")
def text_base64(spark: SparkSession, sf: str) -> DataFrame:
    return _scrapes(spark, sf).where("markdown is not null").select("scrape_id", ft.base64_field(U(MD)).alias("encoded"))


@query(
    f"""WITH u AS (SELECT event_id, resource_type, lower(regexp_replace(regexp_replace({_part('url', 2)}, '^.*@', ''), ':[0-9]*$', '')) AS h FROM network_events), d AS (SELECT *, regexp_matches(h, '^(.*\\.)?({'|'.join(d.replace('.', chr(92) + '.') for d in fu.AD_DOMAINS)})$') AS ad FROM u)
    SELECT event_id, ad AS blocked, ad OR coalesce(lower(resource_type) IN ('image', 'media', 'font'), false) AS blocked_with_media FROM d"""
)
def url_blocked(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "network_events")
    return rows.select("event_id", fu.is_blocked_request(U("url"), F.col("resource_type")).alias("blocked"), fu.is_blocked_request(U("url"), F.col("resource_type"), block_media=True).alias("blocked_with_media"))


@query(
    """WITH x AS (SELECT response_time_ms / 1000 AS v FROM network_events WHERE response_time_ms IS NOT NULL), b AS ("""
    + " UNION ALL ".join(f"SELECT {i} AS position, '{b}' AS le, count_if(v <= {b}) AS n FROM x" for i, b in enumerate(usage.BOUNDS))
    + f""" UNION ALL SELECT {len(usage.BOUNDS)}, '+Inf', count(*) FROM x)
    SELECT position, 'mill_latency_bucket{{le="' || le || '"}} ' || n AS line FROM b UNION ALL SELECT -2, '# HELP mill_latency Seconds' UNION ALL SELECT -1, '# TYPE mill_latency histogram' UNION ALL SELECT 1001, 'mill_latency_count ' || count(*) FROM x"""
)
def usage_prometheus_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a histogram; that of the sum, whose last digits depend on the order of addition, is compared by usage_histogram_sum."""
    rows, seconds = src.read_table(spark, sf, "network_events"), F.col("response_time_ms") / 1000
    return usage.prometheus_histogram(usage.histogram(rows, seconds), usage.histogram_sum(rows, seconds), "latency", "Seconds", "mill_").where("position <> 1000")


@query("SELECT count(response_time_ms) AS count, round(sum(response_time_ms / 1000), 2) AS sum FROM network_events")
def usage_histogram_sum(spark: SparkSession, sf: str) -> DataFrame:
    return usage.histogram_sum(src.read_table(spark, sf, "network_events"), F.col("response_time_ms") / 1000).withColumn("sum", F.round("sum", 2))


@query(
    """WITH RECURSIVE e AS (SELECT page_host AS k, event_id, epoch_us(ts) / 1e6 AS t, 1.0 + length(page_host) % 3 AS rpm, row_number() OVER (PARTITION BY page_host ORDER BY epoch_us(ts) / 1e6, event_id) AS rn
      FROM (SELECT DISTINCT event_id, page_host, ts FROM network_events) WHERE page_host IS NOT NULL AND ts IS NOT NULL),
    s AS (SELECT k, rn, event_id, t, 1.0::DOUBLE AS level, true AS allowed FROM e WHERE rn = 1
      UNION ALL
      SELECT e.k, e.rn, e.event_id, e.t, greatest(0.0, level - (e.t - s.t) * rpm / 60.0) + CASE WHEN greatest(0.0, level - (e.t - s.t) * rpm / 60.0) + 1 <= rpm THEN 1 ELSE 0 END, greatest(0.0, level - (e.t - s.t) * rpm / 60.0) + 1 <= rpm
      FROM s JOIN e ON e.k = s.k AND e.rn = s.rn + 1)
    SELECT k AS page_host, event_id, allowed FROM s"""
)
def state_rate_limit_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each host with a limit of its own."""
    rows = src.read_table(spark, sf, "network_events").dropDuplicates(["event_id"])
    return state.admitted(rows, "page_host", 1 + F.length("page_host") % 3, "event_id")


@query(
    """WITH x AS (SELECT scrape_id, replace(url, '&', '&amp;') AS u, scrape_id % 3 AS k FROM scrapes)
    SELECT scrape_id, CASE k WHEN 0 THEN url || ' https://a.test/2' WHEN 1 THEN 'https://a.test/map.xml' ELSE '' END AS urls FROM scrapes JOIN x USING (scrape_id)"""
)
def crawl_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Site maps of pages, of site maps, and what is no xml."""
    u = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    ns = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    pages_ = F.concat(F.lit(f"<urlset{ns}><url><loc>"), u, F.lit("</loc></url><url><loc> https://a.test/2 </loc></url></urlset>"))
    maps = F.concat(F.lit(f"<sitemapindex{ns}><sitemap><loc>https://a.test/map.xml</loc></sitemap><url><loc>"), u, F.lit("</loc></url></sitemapindex>"))
    kind = F.col("scrape_id") % 3
    xml = F.when(kind == 0, pages_).when(kind == 1, maps).otherwise(F.concat(F.lit("no map of "), u))
    rows = _scrapes(spark, sf).select("scrape_id", crawl.parse_sitemap(xml).alias("urls"))
    return rows.select("scrape_id", F.array_join("urls", " ").alias("urls"))


@query(_SQL["crawl_breadth_first"])
def crawl_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl stopped after its first level, saved, loaded and carried on."""
    seeds = src.read_table(spark, sf, "crawl_jobs").where("url is not null").select(F.col("url").alias("seed"))
    links, folder = crawl.edges(src.pages(spark, sf)), new_path(spark)
    src.save_checkpoint(crawl.breadth_first(links, seeds, max_depth=1), folder, "job")
    return crawl.breadth_first(links, seeds, max_depth=3, state=src.load_checkpoint(spark, folder, "job"))


@query("SELECT job_id, epoch_us(date_trunc('day', created_at) + INTERVAL 1 DAY) AS midnight, epoch_us(date_trunc('minute', created_at) + to_minutes(15 - minute(created_at) % 15)) AS quarter, epoch_us(created_at + INTERVAL 1 HOUR) AS invalid FROM crawl_jobs WHERE created_at IS NOT NULL")
def source_next_runs(spark: SparkSession, sf: str) -> DataFrame:
    from pagemill.functions.time import micros

    rows = src.read_table(spark, sf, "crawl_jobs").where("created_at is not null")
    runs = {"midnight": "0 0 * * *", "quarter": "*/15 * * * *", "invalid": "every day"}
    return rows.select("job_id", *(src.next_run(F.lit(c), F.col("created_at")).alias(n) for n, c in runs.items())).select("job_id", *(micros(n).alias(n) for n in runs))


@query("SELECT job_id, epoch_us(created_at) AS created FROM crawl_jobs")
def source_schedules(spark: SparkSession, sf: str) -> DataFrame:
    from pagemill.functions.time import micros

    return src.listed(src.read_table(spark, sf, "crawl_jobs")).select("job_id", micros("created_at").alias("created"))


@query(
    """WITH h AS (SELECT scrape_id, hex(encode(text)) AS a, hex(encode(markdown)) AS b FROM scrapes WHERE text IS NOT NULL AND markdown IS NOT NULL), n AS (SELECT *, least(length(a), length(b)) // 2 AS n, greatest(length(a), length(b)) // 2 AS m FROM h)
    SELECT scrape_id, CASE WHEN a = b THEN 0.0 WHEN n < 0.8 * m OR n < 4 THEN 100.0 ELSE round((len(list_filter(range(0, n // 4), lambda g: substr(a, g * 8 + 1, 8) <> substr(b, g * 8 + 1, 8)))
      + CASE WHEN substr(a, n // 4 * 8 + 1, n % 4 * 2) <> substr(b, n // 4 * 8 + 1, n % 4 * 2) THEN 1 ELSE 0 END) / (n // 4) * 100, 6) END::DOUBLE AS percent FROM n"""
)
def response_capture_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of the bytes of each page's text and markdown, which are of like size."""
    both = _scrapes(spark, sf).where("text is not null and markdown is not null")
    return both.select("scrape_id", F.round(responses.image_difference(F.encode(TEXT, "UTF-8"), F.encode(MD, "UTF-8")), 6).alias("percent"))


@query()
def response_image_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of the bytes of each page's html and markdown, as stand-ins for two captures."""
    both = _scrapes(spark, sf).where("html is not null and markdown is not null")
    return both.select("scrape_id", responses.image_difference(F.encode(HTML, "UTF-8"), F.encode(MD, "UTF-8")).alias("percent"))


@query(
    """SELECT job_id, CASE WHEN status = 'failed' THEN 'unhealthy' WHEN total_pages IS NULL THEN 'degraded' ELSE 'ok' END AS health FROM crawl_jobs"""
)
def usage_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_table(spark, sf, "crawl_jobs")
    return rows.select("job_id", usage.status_rollup(~F.coalesce(F.col("status") == "failed", F.lit(False)), F.col("total_pages").isNotNull()).alias("health"))


@query("SELECT job_id, epoch_us(created_at) AS created FROM crawl_jobs WHERE status = 'queued' AND created_at <= TIMESTAMP '2024-06-01'")
def source_due_schedules(spark: SparkSession, sf: str) -> DataFrame:
    from pagemill.functions.time import micros

    rows = src.read_table(spark, sf, "crawl_jobs").select("job_id", (F.col("status") == "queued").alias("enabled"), F.col("created_at").alias("next_run"))
    return src.due(rows, F.lit("2024-06-01").cast("timestamp_ntz")).select("job_id", micros("next_run").alias("created"))


@query(
    """WITH c AS (SELECT url AS key, arg_max(scrape_id, scraped_at) AS response FROM scrapes WHERE success AND epoch_us(TIMESTAMP '2024-09-01') - epoch_us(scraped_at) <= 20000000::BIGINT * 1000000 GROUP BY url)
    SELECT scrape_id, response FROM scrapes s LEFT JOIN c ON s.url = c.key WHERE response IS NOT NULL"""
)
def source_cached(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scrapes(spark, sf)
    cache = rows.where("success").select(F.col("url").alias("key"), F.col("scrape_id").alias("response"), F.col("scraped_at").alias("stored_at"))
    asked = rows.select("scrape_id", F.col("url").alias("key"))
    return src.cached(asked, cache, F.lit("2024-09-01").cast("timestamp_ntz"), 20_000_000).where("response is not null").select("scrape_id", "response")


@query("SELECT proxy_url, min(rn) - 1 AS position FROM (SELECT proxy_url, row_number() OVER (ORDER BY proxy_url) AS rn FROM (SELECT DISTINCT proxy_url FROM proxy_events)) GROUP BY 1 HAVING regexp_matches(proxy_url, '^(http|https|socks4|socks5)://')")
def source_proxies(spark: SparkSession, sf: str) -> DataFrame:
    """The proxy list of the environment, written from the events' proxies."""
    names = src.read_table(spark, sf, "proxy_events").where("proxy_url is not null").select("proxy_url").distinct()
    listed = names.agg(F.array_join(F.array_sort(F.collect_list("proxy_url")), ",").alias("l")).select(F.posexplode(F.split("l", ",")).alias("position", "proxy_url"))
    return src.known_proxies(listed).select("proxy_url", F.col("position").cast("long").alias("position"))


@query(
    """WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, map_from_entries(list({'k': event_type, 'v': v} ORDER BY event_type))['click'] AS clicks FROM (SELECT user_id, event_type, count(*) AS v FROM e GROUP BY 1, 2) GROUP BY user_id HAVING count_if(event_type = 'click') > 0"""
)
def usage_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """One entry of the endpoint map of each client."""
    rows = usage.usage_by_client(src.read_table(spark, sf, "events"), "user_id", "event_type", "ts", F.col("value"), F.col("event_type") == "error")
    return rows.select(F.col("client").alias("user_id"), F.col("endpoints")["click"].alias("clicks")).where("clicks is not null")


@query("WITH k AS (SELECT page_host, unnest(map_keys(resp_headers)) AS name FROM network_events WHERE resp_headers IS NOT NULL) SELECT page_host, count(DISTINCT name)::INTEGER AS cookies FROM k GROUP BY 1")
def state_session_cookies(spark: SparkSession, sf: str) -> DataFrame:
    """Cookies of each page host as of its last response: a merge, later values over earlier ones."""
    rows = src.read_table(spark, sf, "network_events").where("resp_headers is not null").select("page_host", "ts", "event_id", "resp_headers").dropDuplicates(["event_id"])
    last = rows.select("page_host", F.explode("resp_headers").alias("name", "value"), "ts", "event_id").groupBy("page_host", "name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("page_host").agg(F.size(state.merge_cookies(F.lit(None).cast("map<string,string>"), F.map_from_entries(F.collect_list(F.struct("name", "value"))))).alias("cookies"))
