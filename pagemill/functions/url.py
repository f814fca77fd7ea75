"""Url algebra as native column expressions.

A url is cut by the pattern of RFC 3986, appendix B, so that lenient input (blanks, odd characters) is cut too instead of
becoming null. All functions give null for null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"

# Fixed values.
HIGH_VALUE = ("article", "blog", "post", "news", "docs", "guide", "tutorial", "product", "page", "category")
LOW_VALUE = ("tag", "author", "comment", "feed", "rss", "print", "share", "login", "register", "cart", "checkout")
BLOCKED_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".bmp", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm", ".zip", ".tar", ".gz", ".rar",
    ".7z", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".exe", ".dmg", ".apk", ".msi", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
)
AD_DOMAINS = (
    "doubleclick.net", "adservice.google.com", "googlesyndication.com", "googletagservices.com", "googletagmanager.com", "google-analytics.com", "googleadservices.com",
    "analytics.google.com", "adsystem.com", "adnxs.com", "ads-twitter.com", "facebook.net", "fbcdn.net", "amazon-adsystem.com", "hotjar.com", "clarity.ms", "newrelic.com",
    "nr-data.net", "sentry.io", "segment.com", "mixpanel.com", "quantserve.com", "scorecardresearch.com", "criteo.com", "outbrain.com", "taboola.com",
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def netloc(url: Column) -> Column:
    """User info, host and port as written."""
    return F.regexp_extract(url, PARTS, 2)


def full_path(url: Column) -> Column:
    """Path with its parameters."""
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(full_path(url), r";[^/]*$", "")


def host(url: Column) -> Column:
    """Host in lower case, without user info and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def _origin(url: Column) -> Column:
    s, n = scheme(url), netloc(url)
    return F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when(n != "", F.concat(F.lit("//"), n)).otherwise(""))


def _with_query(url: Column) -> Column:
    q = query(url)
    return F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")


def normalize_url(url: Column) -> Column:
    """Without fragment and without slashes at the end of the path, which is at least one slash."""
    trimmed = F.regexp_replace(path(url), r"/+$", "")
    params = F.regexp_extract(full_path(url), r"(;[^/]*)$", 1)
    return F.concat(_origin(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed), F.when(params == ";", "").otherwise(params), _with_query(url))


def get_base_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def is_same_domain(a: Column, b: Column) -> Column:
    return netloc(a) == netloc(b)


def dedup_key(url: Column) -> Column:
    """Identity of a url for crawling: parameters and fragment do not count, nor slashes at the end."""
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.regexp_replace(path(url), r"/+$", ""), _with_query(url))


def sitemap_key(url: Column) -> Column:
    """Identity of a page on a site map: the query does not count either."""
    return F.concat(scheme(url), F.lit("://"), netloc(url), path(url))


def matches_domain(url: Column, domain: str) -> Column:
    return host(url) == domain


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    def join(b: str | None, x: str | None) -> str | None:
        if x is None:
            return None
        try:
            return urljoin(b or "", x)
        except ValueError:
            return x

    return pd.Series([join(b, x) for b, x in zip(base, link)], dtype=object)


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of a link. Plain absolute and root-relative links are expressions; only other ones reach Python."""
    absolute = link.rlike(r"^https?://[^/?#\s;\[\]]+(?:/[^?#\s;]*)?(?:\?[^#\s]+)?(?:#\S+)?$") & ~link.rlike(r"/\.")
    rooted = link.rlike(r"^/(?:[^/?#\s;][^?#\s;]*)?(?:\?[^#\s]+)?(?:#\S+)?$") & ~link.rlike(r"/\.") & base.rlike(r"^https?://[^/?#\s;\[\]]+")
    hard = ~F.coalesce(absolute | rooted, F.lit(False)) & link.isNotNull()
    other = _joined(F.when(hard, base), F.when(hard, link))
    return F.when(absolute, link).when(rooted, F.concat(scheme(base), F.lit("://"), netloc(base), link)).otherwise(other)


def url_score(url: Column, keywords: Iterable[str] = ()) -> Column:
    """Worth of a url for a crawl, 0 to 1: shallow paths, keywords and content paths raise it, service paths lower it."""
    p, q, low = F.lower(path(url)), query(url), F.lower(url)
    depth = F.length(p) - F.length(F.regexp_replace(p, "/", ""))
    params = F.when(q == "", 0).otherwise(F.length(q) - F.length(F.regexp_replace(q, "&", "")) + 1)
    value = F.lit(0.5) + F.when(depth <= 2, 0.15).when(depth >= 5, -0.15).otherwise(0.0)
    words = [F.contains(low, F.lit(k.lower())) for k in keywords]
    if words:
        any_word = words[0]
        for w in words[1:]:
            any_word = any_word | w
        value = value + F.when(any_word, 0.2).otherwise(0.0)
    value = value + F.when(p.rlike("/(" + "|".join(HIGH_VALUE) + ")"), 0.1).otherwise(0.0)
    value = value + F.when(p.rlike("/(" + "|".join(LOW_VALUE) + ")"), -0.2).otherwise(0.0)
    value = value + F.when(params > 3, -0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def domain_allowed(url: Column, allowed: Iterable[str] = (), blocked: Iterable[str] = ()) -> Column:
    """Exact lower-case netloc; blocked wins; an empty list of allowed domains allows all."""
    n, allowed, blocked = F.lower(netloc(url)), list(allowed), list(blocked)
    ok = n.isin(allowed) if allowed else F.lit(True)
    return ok & ~n.isin(blocked) if blocked else ok


def path_allowed(url: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Patterns are searched anywhere in the path; exclude wins."""
    p, include, exclude = path(url), list(include), list(exclude)
    ok = F.lit(True)
    if include:
        ok = p.rlike("|".join(f"(?:{x})" for x in include))
    for x in exclude:
        ok = ok & ~p.rlike(x)
    return ok


def extension(url: Column) -> Column:
    """From the last dot of the whole path on; empty without a dot."""
    return F.regexp_extract(F.lower(path(url)), r"(\.[^.]*)$", 1)


def content_type_allowed(url: Column, allowed: Iterable[str] | None = None, blocked: Iterable[str] = ()) -> Column:
    e = extension(url)
    ok = ~e.isin(list(blocked) or list(BLOCKED_EXTENSIONS))
    if allowed is not None:
        ok = ok & e.isin(list(allowed))
    return (e == "") | ok


def is_ad_or_tracker(url: Column) -> Column:
    """The host is one of the domains or below one."""
    h = host(url)
    return h.rlike(r"^(?:.*\.)?(?:" + "|".join(d.replace(".", r"\.") for d in AD_DOMAINS) + ")$")


# Fixed values.
HEAVY_RESOURCES = ("image", "media", "font")


def is_blocked_request(url: Column, resource_type: Column, block_ads: bool = True, block_media: bool = False) -> Column:
    """Whether a browser with these settings would not have sent the request."""
    ads = is_ad_or_tracker(url) if block_ads else F.lit(False)
    return F.coalesce(ads, F.lit(False)) | (F.coalesce(F.lower(resource_type).isin(*HEAVY_RESOURCES), F.lit(False)) if block_media else F.lit(False))


def is_pdf(url: Column, content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf")) | F.endswith(F.lower(F.regexp_replace(url, r"/+$", "")), F.lit(".pdf"))


def crawlable(url: Column, seed: Column) -> Column:
    """Http, complete, and of the seed's own netloc."""
    return scheme(url).isin("http", "https") & (netloc(url) != "") & is_same_domain(url, seed)


def filter_urls(
    df: DataFrame, url: str = "url", order: str | None = None, allowed_domains: Iterable[str] = (), blocked_domains: Iterable[str] = (), include_paths: Iterable[str] = (),
    exclude_paths: Iterable[str] = (), allowed_extensions: Iterable[str] | None = None, blocked_extensions: Iterable[str] = (), unique: bool = True, filters: Iterable[Callable[[Column], Column]] = (),
) -> DataFrame:
    """Rows whose url passes all filters, own ones (a condition of the url) too; then, of urls alike, the first in the given order."""
    u = F.col(url)
    kept = df.where(domain_allowed(u, allowed_domains, blocked_domains) & path_allowed(u, include_paths, exclude_paths) & content_type_allowed(u, allowed_extensions, blocked_extensions))
    for own in filters:
        kept = kept.where(own(u))
    if not unique:
        return kept
    if order is None:
        return kept.withColumn("__key", dedup_key(u)).dropDuplicates(["__key"]).drop("__key")
    rank = F.row_number().over(Window.partitionBy(dedup_key(u)).orderBy(order))
    return kept.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
