"""Problem 7: pieces of at most max_tokens, cut at natural places, with overlap.

Size is the token estimate: code points / 4, or / 3.5 where more than 5% of them are ``{ } ( )``, rounded down. Prefix
sums of brackets give the size of any span at once; a sorted array of boundaries (blank line, line, sentence, word) is
searched for the last one under the limit; the next piece begins overlap_tokens before the cut, at a word start where
there is one; a run without boundary is cut hard.

Defined results: null or empty text has no pieces; a text within the limit is one piece, equal to it; every piece is a
span text[start:end] with its size at most max_tokens; pieces cover the text in order without gaps; each profile row gives
its own pieces (a repeated row gives them again). Every piece but the first begins with at least overlap_tokens of the one
before; only where brackets lie so densely at the end of a piece that this much and one more character would be over the
limit, the overlap is left out. An overlap of max_tokens or more is refused; max_tokens below 1 counts as 1, a negative
overlap as 0. Texts are handled whole, row by row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strongest first: a boundary is taken if it lies in the last part of the piece that its class allows.
BOUNDARIES = ((re.compile(r"\n[ \t\r]*\n\s*"), 0.5), (re.compile(r"\n+"), 0.6), (re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+"), 0.7), (re.compile(r"\s+"), 0.8))
_BRACKETS = re.compile(r"[{}()]")
_WORD = re.compile(r"\s+")


def token_estimate(text: Column) -> Column:
    """The estimate as a native expression."""
    n = F.length(text)
    brackets = n - F.length(F.regexp_replace(text, r"[{}()]", ""))
    return F.when(brackets > n * 0.05, F.floor(n / 3.5)).otherwise(F.floor(n / 4.0)).cast("long")


def pieces(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of one text."""
    n, limit = len(text), max(1, max_tokens)
    if not n:
        return []
    at = np.fromiter((m.start() for m in _BRACKETS.finditer(text)), np.int64)

    def size(a: int, b: int) -> int:
        k = int(np.searchsorted(at, b) - np.searchsorted(at, a))
        return int((b - a) / (3.5 if k > 0.05 * (b - a) else 4.0))

    if size(0, n) <= limit:
        return [(0, n)]
    ends = [([m.end() for m in pattern.finditer(text)], share) for pattern, share in BOUNDARIES]
    words = ends[-1][0]
    longest, dense = 4 * limit + 3, int(3.5 * limit)  # the longest span within the limit with few brackets, and with many
    back = max(0, overlap_tokens)
    if back >= limit:
        raise ValueError(f"an overlap of {overlap_tokens} tokens does not fit into pieces of {max_tokens}")
    out, start, last = [], 0, 0
    while True:
        if size(start, n) <= limit:
            out.append((start, n))
            return out
        hard = min(n, start + longest)
        if size(start, hard) > limit:
            hard = start + max(1, dense)
        if hard <= last:
            start = last
            continue
        cut = hard
        for places, share in ends:
            # A piece goes beyond the one before, and is more than its overlap with the next one.
            low = max(last, start + share * (hard - start))
            k = bisect_right(places, hard) - 1
            while k >= 0 and places[k] > low and size(start, places[k]) > limit:
                k -= 1
            if k >= 0 and places[k] > low and size(start, places[k]) > back:
                cut = places[k]
                break
        out.append((start, cut))
        nxt = last = cut
        if back:
            # Step back so that the span before the cut is at least the overlap, from a word start where one is near.
            low = max(start + 1, cut - 4 * back)
            while low > start + 1 and size(low, cut) < back:
                low -= 1
            k = bisect_right(words, low) - 1
            near = k >= 0 and words[k] > start and cut - words[k] < (cut - low) * 1.5 + 8 and size(words[k], cut) <= back + (limit - back) // 2
            nxt = words[k] if near else low
        start = nxt


def chunk(records: DataFrame, profiles: DataFrame, id_col: str = "scrape_id", text_col: str = "markdown", with_text: bool = True) -> DataFrame:
    """(profile, id, n_pieces, piece_no, start, end, tokens, piece) of every record under every profile.

    profiles (profile, max_tokens, overlap_tokens) is configuration: it is read to the driver and refused above 1,000 rows.
    """
    rows = [(r[0], int(r[1]), int(r[2] or 0)) for r in profiles.select("profile", "max_tokens", "overlap_tokens").where("max_tokens is not null").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("a table of chunk profiles holds at most 1,000 rows")
    if bad := [r[0] for r in rows if r[2] >= max(1, r[1])]:
        raise ValueError(f"profiles with an overlap of max_tokens or more: {bad}")
    id_type = records.schema[id_col].dataType.simpleString()
    schema = f"profile string, __id {id_type}, n_pieces int, piece_no int, start int, end int, tokens int" + (", piece string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["__id"], batch["__text"]):
                dense = None
                for name, limit, overlap in rows:
                    if dense is None:
                        dense = len(text) - len(_BRACKETS.sub("", text)) > 0.05 * len(text)
                    spans = pieces(text, limit, overlap)
                    for no, (a, b) in enumerate(spans):
                        part = text[a:b]
                        brackets = len(_BRACKETS.findall(part))
                        row = (name, key, len(spans), no, a, b, int((b - a) / (3.5 if brackets > 0.05 * (b - a) else 4.0)))
                        out.append((*row, part) if with_text else row)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    texts = records.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") > 0)
    return texts.mapInPandas(run, schema).withColumnRenamed("__id", id_col)


def found(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """Records that the chunker had to cut: their own size is over max_tokens."""
    # Only texts over the smallest limit can be cut, so the others need not reach Python.
    least = profiles.agg(F.min("max_tokens")).first()[0]
    big = records.where(token_estimate(F.col("markdown")) > F.lit(least if least is not None else 1 << 62))
    return chunk(big, profiles, with_text=False).where("n_pieces > 1 and piece_no = 0").select("profile", "scrape_id").distinct()
