"""Classification of stored responses: challenges, pages that need scripts, proxy errors, headers, delays, unsafe addresses."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.time import micros
from pyspark.sql import types as T

from pagemill.functions.url import netloc

# Rule, status codes (none: any), server prefix, pattern; the first that holds wins.
CHALLENGES = (
    ("cloudflare_js", (403, 429, 503), "cloudflare", r"cdn-cgi/challenge-platform/\S+orchestrate/jsch/v1"),
    ("cloudflare_managed", (403, 503), "cloudflare", r"cdn-cgi/challenge-platform/\S+orchestrate/(captcha|managed)/v1"),
    ("cloudflare_turnstile", (403, 503), None, r"challenges\.cloudflare\.com/turnstile"),
    ("cloudflare_interstitial", (403, 503), "cloudflare", r"Just a moment\.\.\."),
    ("recaptcha", (), None, r"(google\.com/recaptcha|g-recaptcha|grecaptcha)"),
    ("hcaptcha", (), None, r"(hcaptcha\.com|h-captcha)"),
    ("aws_waf", (403, 405), None, r"(awswaf|aws-waf-token|captcha\.awswaf\.com)"),
    ("akamai", (403, 429, 503), None, r"(/_sec/cp_challenge|akamai.*bot.*manager|akam/\d+/)"),
    ("imperva", (403, 429), None, r"(incapsula|visid_incap|_incap_ses|reese84)"),
    ("datadome", (403,), None, r"(datadome\.co|dd\.js|api\.datadome\.co)"),
    ("perimeterx", (403, 429), None, r"(perimeterx|px-captcha|captcha\.px-cdn\.net|human-challenge)"),
    ("sucuri", (403,), "sucuri", r"(sucuri\.net|cloudproxy|access denied.*sucuri)"),
    ("meta_refresh", (), None, r"<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]+url="),
    ("generic_block", (403, 429), None, r"(bot detected|automated access|Please verify you are (a )?human|unusual traffic from your computer)"),
)
# Characters of a page that are looked at, what pages that need scripts hold, proxy errors, headers and networks that are refused.
SCANNED = 15_000
SCRIPT_PAGES = (
    r"(?i)<div\s+id=[\"'](?:root|app|__next|__nuxt)[\"']>\s*</div>",
    r"(?is)<noscript>.*?enable javascript",
    r"(?i)__NEXT_DATA__",
    r"(?i)window\.__NUXT__",
    r"(?i)<div\s+id=[\"']gatsby-",
)
PROXY_ERRORS = ("net::err_proxy", "net::err_tunnel", "connection refused", "connection reset", "connection timed out", "failed to connect", "could not resolve proxy")
REFUSED_HEADERS = ("host", "content-length", "transfer-encoding", "connection", "keep-alive", "expect", "te", "trailer", "upgrade", "proxy-authorization", "proxy-connection")
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")
PRIVATE_NAMES, PRIVATE_SUFFIXES = ("localhost", "metadata.google.internal"), (".internal", ".local", ".corp", ".home.arpa")


def detect_challenge(status: Column, headers: Column, body: Column) -> Column:
    """struct<detected, type, detail>: rules on the first 15,000 characters, then a nearly empty refusal, then a header."""
    head = F.left(F.coalesce(body, F.lit("")), F.lit(SCANNED))
    server = F.lower(F.coalesce(headers["server"], headers["Server"], F.lit("")))
    kind = None
    for name, codes, prefix, pattern in CHALLENGES:
        test = head.rlike(f"(?i){pattern}")
        if prefix:
            test = F.startswith(server, F.lit(prefix)) & test
        if codes:
            test = status.isin(*codes) & test
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    silent = status.isin(403, 429) & (F.length(F.trim(F.coalesce(body, F.lit("")))) < 500)
    kind = kind.when(silent, "silent_block").when(F.coalesce(headers["cf-mitigated"], F.lit("")) == "challenge", "cloudflare_mitigated")
    detail = F.concat(F.lit("Detected "), kind, F.lit(" challenge (HTTP "), status.cast("string"), F.lit(")"))
    return F.struct(kind.isNotNull().alias("detected"), kind.alias("type"), detail.alias("detail"))


def cloudflare_kind(html: Column) -> Column:
    kind = None
    for name in ("non-interactive", "managed", "interactive"):
        test = F.contains(html, F.lit(f"cType: '{name}'")) | F.contains(html, F.lit(f'cType: "{name}"'))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.when(F.contains(html, F.lit("challenges.cloudflare.com/turnstile")), "embedded_turnstile")


def needs_scripts(html: Column) -> Column:
    """A page shell that a script fills: by its marks, or by less than 200 visible characters."""
    marked = html.rlike(SCRIPT_PAGES[0])
    for p in SCRIPT_PAGES[1:]:
        marked = marked | html.rlike(p)
    text = F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
    return marked | (F.length(text) < 200)


def needs_scripts_by_domain(pages: DataFrame, html: str = "html", url: str = "url", order: str = "scraped_at") -> DataFrame:
    """pages with needs_scripts as the first page of its domain decides; of a domain only its first page is shuffled."""
    domain = F.lower(netloc(F.col(url)))
    judged = pages.withColumn("__domain", domain).withColumn("__own", needs_scripts(F.col(html)))
    first = judged.where("__own is not null").groupBy("__domain").agg(F.min_by("__own", F.struct(order, url)).alias("needs_scripts"))
    return judged.join(first, "__domain", "left").drop("__domain", "__own")


def is_proxy_error(message: Column) -> Column:
    return F.exists(F.array(*map(F.lit, PROXY_ERRORS)), lambda p: F.contains(F.lower(message), p))


def sanitize_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*REFUSED_HEADERS))


def retry_after(status: Column, headers: Column, now: Column) -> Column:
    """Seconds to wait after a 429: a number, or the time until an HTTP date, at least 0; null otherwise."""
    value = F.coalesce(headers["Retry-After"], headers["retry-after"])
    date = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.when(date.isNotNull(), F.greatest(F.lit(0.0), (micros(date) - micros(now)) / 1e6))
    return F.when(status == 429, F.coalesce(F.trim(value).try_cast("double"), until))


def _safe(url: str | None) -> bool | None:
    if url is None:
        return None
    m = re.match(r"^(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url, re.IGNORECASE)
    if not m or not m[2].strip("[]"):
        return False
    name = m[2].strip("[]").lower()
    try:
        address = ipaddress.ip_address(name)
    except ValueError:
        return name not in PRIVATE_NAMES and not name.endswith(PRIVATE_SUFFIXES)
    return not any(address in ipaddress.ip_network(n) for n in PRIVATE_NETWORKS)


def is_public_url(url: Column) -> Column:
    """Http to a host that is not of a private network, by address or name; nothing is resolved."""

    def run(urls: pd.Series) -> pd.Series:
        return urls.map(_safe)

    return F.pandas_udf(run, T.BooleanType())(url)


def pair_events(events: DataFrame) -> DataFrame:
    """(scrape_id, url, method, resource_type, ts, status, response_time_ms, content_type): each response with the last
    request of its url in the same scrape before it. Repeated rows count once.

    One shuffle by (scrape_id, url), so a busy host is spread over its scrapes.
    """
    rows = events.dropDuplicates(["event_id"])
    by = Window.partitionBy("scrape_id", "url").orderBy("ts", F.when(F.col("kind") == "request", 0).otherwise(1), "event_id")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    request = F.last(F.when(F.col("kind") == "request", F.struct("method", "resource_type", "ts")), ignorenulls=True).over(so_far)
    paired = rows.where("scrape_id is not null").withColumn("request", request).where("kind = 'response' and request is not null")
    elapsed = (micros("ts") - micros("request.ts")) / 1000
    return paired.select("event_id", "scrape_id", "url", "request.method", "request.resource_type", F.col("request.ts").alias("requested_at"), "status", elapsed.alias("response_time_ms"), F.coalesce(F.col("resp_headers")["content-type"], F.lit("")).alias("content_type"))


def image_difference(before: Column, after: Column) -> Column:
    """Percent of four-byte groups that differ: 0 for equal images, 100 where sizes differ by more than a fifth."""

    def one(a: bytes | None, b: bytes | None) -> float | None:
        if a is None or b is None:
            return None
        if a == b:
            return 0.0
        n = min(len(a), len(b))
        if n < 0.8 * max(len(a), len(b)) or n < 4:
            return 100.0
        import numpy as np

        whole = n // 4
        x, y = (np.frombuffer(v, np.uint32, whole) for v in (a, b))
        return (int((x != y).sum()) + (a[whole * 4 : n] != b[whole * 4 : n])) / whole * 100

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(run, T.DoubleType())(before, after)
