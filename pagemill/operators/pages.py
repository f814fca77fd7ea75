"""Operators on stored pages: one Arrow function parses each page and returns only what is asked for.

They are scalar functions on purpose: filters on other columns stay below them and reach the scan, columns that nobody
asks for are never read. Null html gives null; broken html gives what could be read. A page on which a function raises gives
null and does not fail the job; ``scrape`` and ``response`` say in ``error`` what was raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.dom import page
from pagemill.functions import text as fx

FORMATS: dict[str, Callable[[str], str]] = {"markdown": page.to_markdown, "text": page.to_text, "json": page.to_json, "csv": page.to_csv, "xml": page.to_xml, "html": lambda h: h}

_SOURCE = "struct<src:string,type:string>"
MEDIA_TYPE = (
    "struct<images:array<struct<src:string,alt:string,title:string,width:string,height:string,srcset:string,source:string>>,"
    f"videos:array<struct<sources:array<{_SOURCE}>,poster:string,width:string,height:string,embed:boolean>>,audio:array<struct<sources:array<{_SOURCE}>>>,"
    "links:array<struct<href:string,text:string,title:string,rel:string,target:string>>>"
)
TABLE_TYPE = "array<struct<index:int,caption:string,headers:array<string>,rows:array<map<string,string>>,raw_rows:array<array<string>>,row_count:int,column_count:int>>"


def _function(f: Callable[..., Any], returns: str, *columns: Column) -> Column:
    """f over rows as an Arrow function; null in the first column, or a page that raises, gives null."""

    def safe(*row: Any) -> Any:
        try:
            return f(*row)
        except Exception:  # one page must not fail the others
            return None

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else safe(*row) for row in zip(*series)], index=series[0].index, dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(one if len(columns) == 1 else two, returns)(*columns)


def _record(f: Callable[..., dict], fields: list[tuple[str, str]], *columns: Column) -> Column:
    """f over rows, its dict as a struct; a page that raises has error only, if that is a field."""

    def safe(*row: Any) -> dict:
        try:
            return f(*row)
        except Exception as e:  # one page must not fail the others
            return {"error": f"{type(e).__name__}: {e}"}

    schema = T._parse_datatype_string("struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">")

    def run(*series: pd.Series) -> pd.DataFrame:
        rows = [{} if row[0] is None else safe(*row) for row in zip(*series)]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n, _ in fields})

    if len(columns) == 1:

        def one(a: pd.Series) -> pd.DataFrame:
            return run(a)

        return F.pandas_udf(one, schema)(*columns)

    def two(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return run(a, b)

    return F.pandas_udf(two, schema)(*columns)


def _filtered(content: str, kind: str | None, query: str | None) -> str:
    if kind == "pruning":
        return page.prune(content)
    if kind == "bm25" and query:
        return page.relevant_blocks(content, query)
    return content


def scrape(
    html: Column, formats: Iterable[str] = ("markdown",), excluded_tags: list[str] | None = None, excluded_selector: str | None = None, css_selector: str | None = None,
    word_count_threshold: int | None = None, content_filter: str | None = None, content_filter_query: str | None = None,
) -> Column:
    """struct<title, description, language, content_html, one field per format, error>, of the page's main content."""
    formats = list(dict.fromkeys(formats))
    if unknown := set(formats) - set(FORMATS):
        raise ValueError(f"unknown formats: {sorted(unknown)}")

    def run(h: str) -> dict:
        title, description, language, content = page.main_content(page.preprocess(h, excluded_tags, excluded_selector, css_selector))
        if word_count_threshold and content:
            content = page.drop_short_blocks(content, word_count_threshold)
        content = _filtered(content, content_filter, content_filter_query)
        out = {"title": title, "description": description, "language": language, "content_html": content}
        return out | {f: FORMATS[f](content) if content else "" for f in formats}

    return _record(run, [(n, "string") for n in dict.fromkeys(("title", "description", "language", "content_html", *formats, "error"))], html)


def convert(html: Column, to: str) -> Column:
    """Html as it stands in another format."""
    if to not in FORMATS:
        raise ValueError(f"unknown format: {to}")
    return html if to == "html" else _function(FORMATS[to], "string", html)


def metadata(html: Column) -> Column:
    return _record(lambda h: dict(zip(("title", "description", "language"), page.metadata(page.parse(h)))), [("title", "string"), ("description", "string"), ("language", "string")], html)


def sections(html: Column) -> Column:
    return _function(page.to_sections, "array<struct<heading:string,level:int,content:array<string>>>", html)


def prune(html: Column, text_density: float = 0.1, link_density: float = 0.6) -> Column:
    return _function(lambda h: page.prune(h, text_density, link_density), "string", html)


def relevant_blocks(html: Column, query: str, top_k: int = 10, threshold: float = 0.05) -> Column:
    return _function(lambda h: page.relevant_blocks(h, query, top_k, threshold), "string", html)


def preprocess(html: Column, excluded_tags: list[str] | None = None, excluded_selector: str | None = None, css_selector: str | None = None) -> Column:
    if not (excluded_tags or excluded_selector or css_selector):
        return html
    return _function(lambda h: page.preprocess(h, excluded_tags, excluded_selector, css_selector), "string", html)


def drop_short_blocks(html: Column, threshold: int) -> Column:
    return _function(lambda h: page.drop_short_blocks(h, threshold), "string", html)


def tables(html: Column, table_index: int | None = None) -> Column:
    """Headers from the first row of thead, else the th cells of the first row; rows of the first tbody, else of the table;
    a row equal to the headers is no row; of headers alike the last wins; longer rows are cut."""
    return _function(lambda h: page.tables(h, table_index), TABLE_TYPE, html)


def tables_csv(html: Column) -> Column:
    return _function(lambda h: page.tables_csv(page.tables(h)), "string", html)


def media(html: Column, base_url: Column) -> Column:
    names = T._parse_datatype_string(MEDIA_TYPE)
    fields = [(f.name, f.dataType.simpleString()) for f in names.fields]
    keys = {f.name: [x.name for x in f.dataType.elementType.fields] for f in names.fields}

    def run(h: str, base: str | None) -> dict:
        return {k: [{x: row.get(x) for x in keys[k]} for row in rows] for k, rows in page.media(h, base).items()}

    return _record(run, fields, html, base_url)


def crawl_links(html: Column, base_url: Column) -> Column:
    """array<struct<href, hidden>> of all links in order."""
    return _function(lambda h, b: [{"href": u, "hidden": x} for u, x in page.crawl_links(h, b)], "array<struct<href:string,hidden:boolean>>", html, base_url)


def followed_links(html: Column, base_url: Column) -> Column:
    """array<string>: visible links of a page that may be indexed."""
    return _function(page.followed_links, "array<string>", html, base_url)


def noindex(html: Column) -> Column:
    return _function(page.noindex, "boolean", F.substring(html, 1, 10_000))


def _as_text(value: Any) -> list[str | None] | None:
    if value is None:
        return None
    if isinstance(value, list):
        return [x if x is None or isinstance(x, str) else "\t".join(map(str, x)) for x in value]
    return [value if isinstance(value, str) else "\t".join(map(str, value))]


def extract(html: Column, strategy: str, config: Any) -> Column:
    """Records array<map<string, array<string>>> by css, xpath or regex; a field without a match is null, one value is a list of one.

    css: {field: selector or {selector, attribute, all}}, or {container, fields} for a record per container. xpath: {field:
    expression}. regex: {field: pattern}, or one pattern for a record per match.
    """
    import re

    if not config:
        raise ValueError(f"strategy {strategy} needs a configuration")
    if strategy == "css":
        run = lambda h: page.css_records(h, config)
    elif strategy == "xpath":
        run = lambda h: [page.xpath_record(h, config)]
    elif strategy == "regex":
        for pattern in [config] if isinstance(config, str) else config.values():
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"invalid regular expression {pattern!r}: {e}") from e
        run = (lambda h: page.regex_records(h, config)) if isinstance(config, str) else (lambda h: [page.regex_record(h, config)])
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return _function(lambda h: [{k: _as_text(v) for k, v in r.items()} for r in run(h)], "array<map<string,array<string>>>", html)


def response(pages: DataFrame, html: str = "html", url: str = "url", formats: Iterable[str] = ("markdown",), llm_ready: bool = False, citations: bool = False, **options: Any) -> DataFrame:
    """pages with title, description, language, error, a column per format, word_count and token_count_estimate of the main content."""
    formats = list(dict.fromkeys(formats))
    wanted = formats if {"markdown", "text"} & set(formats) else [*formats, "text"]
    counted = next(f for f in reversed(wanted) if f in ("markdown", "text"))
    out = pages.withColumn("__page", scrape(F.col(html), wanted, **options))
    out = out.select("*", F.col("__page.title").alias("title"), F.col("__page.description").alias("description"), F.col("__page.language").alias("language"), F.col("__page.error").alias("error"), *(F.col(f"__page.{f}").alias(f"as_{f}") for f in formats), F.col(f"__page.{counted}").alias("__counted"))
    out = out.withColumn("word_count", fx.word_count(F.col("__counted"))).withColumn("token_count_estimate", fx.estimate_tokens(F.col("__counted")))
    if "markdown" in formats and citations:
        out = out.withColumn("as_markdown", fx.markdown_with_citations(F.col("as_markdown")))
    if "markdown" in formats and llm_ready:
        out = out.withColumn("as_markdown", fx.clean_for_llm(F.col("as_markdown")))
    return out.drop("__page", "__counted")
