"""Chunkers: arrays of pieces of a text, sizes in words. Blank text has no piece."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import WHITE, let, split_sentences, strip, word_count


def sliding_window(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of size words that begin every size - overlap words; a text of at most size words stays as it is."""
    step = max(size - overlap, 1)

    def windows(words: Column) -> Column:
        n = F.size(words)
        # The last window is the first that reaches the end.
        last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(cut)

    return let(F.regexp_extract_all(text, F.lit(WHITE), 0), windows)


def _pack(pieces: Column, size: int, overlap: int, separator: str, alone: bool) -> Column:
    """Fold of pieces into chunks of at most size words; a longer piece is a chunk of its own.

    With overlap, a chunk begins with the last pieces of the one before, as many as fit into overlap words. With alone, a
    piece that begins with # begins a chunk. A step looks at no more than the open chunk.
    """
    counted = F.transform(pieces, lambda p: F.struct(p.alias("t"), word_count(p).alias("n")))
    empty = F.filter(counted, lambda _: F.lit(False))
    start = F.struct(F.array().cast("array<string>").alias("done"), empty.alias("open"), F.lit(0).alias("n"))

    def join(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda x: x["t"]), separator)

    def kept(xs: Column) -> Column:
        if not overlap:
            return F.filter(xs, lambda _: F.lit(False))

        def more(acc: Column, x: Column) -> Column:
            fits = acc["on"] & (acc["n"] + x["n"] <= overlap)
            return F.struct((acc["k"] + fits.cast("int")).alias("k"), (acc["n"] + x["n"]).alias("n"), fits.alias("on"))

        k = F.aggregate(F.reverse(xs), F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("on")), more)["k"]
        return F.slice(xs, F.size(xs) - k + 1, k)

    def step(acc: Column, piece: Column) -> Column:
        full = (acc["n"] + piece["n"] > size) & (F.size(acc["open"]) > 0)
        if alone:
            full = full | (F.startswith(piece["t"], F.lit("#")) & (F.size(acc["open"]) > 0))
        rest = F.when(full, kept(acc["open"])).otherwise(acc["open"])
        return F.struct(
            F.when(full, F.array_append(acc["done"], join(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.array_append(rest, piece).alias("open"),
            (F.when(full, F.aggregate(kept(acc["open"]), F.lit(0), lambda a, y: a + y["n"])).otherwise(acc["n"]) + piece["n"]).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], join(acc["open"]))).otherwise(acc["done"])

    return F.aggregate(counted, start, step, finish)


def fixed_length(text: Column, size: int = 1000, overlap: int = 0) -> Column:
    """Whole sentences up to size words; overlap repeats the last sentences of the chunk before."""
    return _pack(split_sentences(text), size, overlap, " ", False)


def semantic(text: Column, size: int = 1000) -> Column:
    """Paragraphs up to size words; a heading begins a chunk."""
    parts = F.split(F.regexp_replace(text, r"(?m)^(#{1,6}\s)", "\u0000$1"), "\\n\\s*\\n|\u0000")
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")
    return _pack(parts, size, 0, "\n\n", True)


def chunker(strategy: str, size: int = 1000, overlap: int = 200):
    """Chunker by name."""
    if strategy == "fixed":
        return lambda text: fixed_length(text, size, overlap)
    if strategy == "sliding":
        return lambda text: sliding_window(text, size, overlap)
    if strategy == "semantic":
        return lambda text: semantic(text, size)
    raise ValueError(f"unknown chunking strategy: {strategy}")
