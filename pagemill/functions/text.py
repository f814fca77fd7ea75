"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\S+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once for a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WHITE), 0)), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """Code points / 4, or / 3.5 where more than 5% are braces or parentheses; rounded down."""
    n = F.length(text)
    marks = n - F.length(F.regexp_replace(text, r"[{}()]", ""))
    return F.when(n == 0, 0).otherwise(F.when(marks / n > 0.05, F.floor(n / 3.5)).otherwise(F.floor(n / 4.0))).cast("long")


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_sentences(text: Column) -> Column:
    """Cut at white space between a full stop, ! or ? and a capital A-Z."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_for_llm(markdown: Column) -> Column:
    """Without lines that are only an anchor link, images (their alt text stays), html comments, links without a target. The patterns are fixed values."""
    x = F.regexp_replace(markdown, r"(?m)^\s*\[.*?\]\(#.*?\)\s*$", "")
    x = F.regexp_replace(x, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    x = collapse_blank_lines(x)
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"\[([^\]]*)\]\(\s*\)", "$1")
    return strip(x)


# Fixed value.
LINK = r"\[([^\]]*)\]\(([^)]+)\)"


def markdown_with_citations(markdown: Column) -> Column:
    """Links as numbered references, numbers by first appearance of the address; the list of references follows."""
    targets = F.array_distinct(F.regexp_extract_all(markdown, F.lit(LINK), 2))
    # The text between links stays; each link becomes [text][number].
    between = F.split(markdown, LINK, -1)
    words, addresses = F.regexp_extract_all(markdown, F.lit(LINK), 1), F.regexp_extract_all(markdown, F.lit(LINK), 2)
    pieces = F.transform(words, lambda w, i: F.concat(F.lit("["), w, F.lit("]["), F.array_position(targets, addresses[i]).cast("string"), F.lit("]"), between[i + 1]))
    body = F.concat(between[0], F.array_join(pieces, ""))
    listed = F.array_join(F.transform(targets, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]: "), t)), "\n")
    return F.when(F.size(targets) == 0, markdown).otherwise(F.concat(body, F.lit("\n\n---\n\n**References**\n\n"), listed))


def split_by_headings(markdown: Column) -> Column:
    """Sections that begin at a heading line; blank sections are left out."""
    marked = F.regexp_replace(markdown, r"(?m)^(#{1,6}\s)", "\u0000$1")
    return F.filter(F.transform(F.split(marked, "\u0000"), strip), lambda s: s != "")


def pdf_text_to_html(text: Column) -> Column:
    """A paragraph per run of text between blank lines."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.filter(F.split(safe, r"\n\n"), lambda p: strip(p) != "")
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")
    return F.concat(F.lit("<html><head><title>PDF Document</title></head><body>\n"), body, F.lit("\n</body></html>"))


def visible_length(html: Column) -> Column:
    """Characters left when tags go and the ends are trimmed."""
    return F.length(strip(F.regexp_replace(html, r"<[^>]+>", "")))


def extraction_prompt(content: Column, task: Column, schema_hint: Column | None = None) -> Column:
    head = F.concat(F.lit("## Web Page Content\n\n"), content, F.lit("\n\n## Extraction Task\n\n"), task)
    return head if schema_hint is None else F.when(schema_hint.isNull(), head).otherwise(F.concat(head, F.lit("\n\n\n## Expected Output Schema\n\n"), schema_hint))


def truncate_prompt(content: Column, limit: int = 100_000, back_to: int = 50_000, mark: str = "\n\n[Content truncated]") -> Column:
    """At most limit characters, cut back to the last blank line if that lies beyond back_to."""
    head = F.substring(content, 1, limit)
    tail = F.length(F.substring_index(head, "\n\n", -1))
    at = F.length(head) - tail - 2
    cut = F.when(at > back_to, F.left(head, at)).otherwise(head)
    return F.when(F.length(content) <= limit, content).otherwise(F.concat(cut, F.lit(mark)))


def cache_key(url: Column, params: dict[str, Column]) -> Column:
    """First 16 hex digits of a hash over the url and all parameters that are not null, in order of name."""
    parts = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in sorted(params.items())]
    given = F.filter(F.array(*parts), lambda p: p["v"].isNotNull()) if parts else F.array()
    return F.substring(F.sha2(F.concat(url, F.lit("\n"), F.to_json(given) if parts else F.lit("[]")), 256), 1, 16)


def base64_field(value: Column) -> Column:
    """Bytes, or the UTF-8 of a text, as base64 in one line."""
    return F.replace(F.base64(value.cast("binary")), F.lit("\r\n"), F.lit(""))


def csv_field(value: Column) -> Column:
    """Quoted where needed, quotes doubled."""
    return F.when(value.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)
