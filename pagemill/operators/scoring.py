"""Relevance by Okapi BM25, over the sections of one text and over a corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let, split_by_headings, tokenize
from pagemill.sources.scratch import written

K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", query.lower())


def _is(term: str):
    return lambda word: word == term


def _counts(text: Column, terms: list[str]) -> Column:
    """struct<n, tf>: words of a text and how often it holds each term. The text is cut into words once."""
    return let(tokenize(text), lambda words: F.struct(F.size(words).alias("n"), F.array(*(F.size(F.filter(words, _is(t))) for t in terms)).alias("tf")))


def _scores(counts: Column, terms: list[str], times: list[int]) -> Column:
    """array<double> of an array of counts."""
    n = F.size(counts)
    mean = F.greatest(F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"]) / F.greatest(n, F.lit(1)), F.lit(1.0))
    zeros = F.array(*(F.lit(0) for _ in terms))
    df = F.aggregate(counts, zeros, lambda a, x: F.zip_with(a, x["tf"], lambda m, tf: m + F.when(tf > 0, 1).otherwise(0)))
    weights = F.transform(df, lambda d: F.when(d == 0, 0.0).otherwise(F.log((n - d + 0.5) / (d + 0.5) + 1)))

    def score(weighted: Column, average: Column, x: Column) -> Column:
        value = F.lit(0.0)
        for i, k in enumerate(times):
            tf = F.get(x["tf"], i)
            value = value + k * F.get(weighted, i) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * x["n"] / average))
        return value

    return let(F.struct(weights.alias("w"), mean.alias("m")), lambda s: F.transform(counts, lambda x: score(s["w"], s["m"], x)))


def section_scores(sections: Column, query: str) -> Column:
    """array<double>: BM25 of each section against the query's terms; a term given twice counts twice."""
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    if not terms:
        return F.transform(sections, lambda _: F.lit(0.0))
    return let(F.transform(sections, lambda s: _counts(s, distinct)), lambda c: _scores(c, distinct, [terms.count(t) for t in distinct]))


def fit_markdown(markdown: Column, query: str, top_k: int = 5, min_score: float = 0.0) -> Column:
    """The sections that answer the query best, best first (ties in order of the text); the text itself where none does.

    Sections, their counts and their scores are each made once for a text: linear in its length.
    """
    if not query_terms(query or ""):
        return markdown

    def best(sections: Column, scores: Column) -> Column:
        places = F.filter(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))), lambda r: r["s"] < -min_score)
        chosen = F.slice(F.sort_array(places), 1, top_k)
        joined = F.array_join(F.transform(chosen, lambda r: F.get(sections, r["i"])), "\n\n")
        return F.when((F.size(sections) > 1) & (F.size(chosen) > 0), joined)

    found = let(split_by_headings(markdown), lambda sections: let(section_scores(sections, query), lambda scores: best(sections, scores)))
    return F.coalesce(found, markdown)


def corpus_scores(documents: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document with a score over 0, statistics over all documents.

    The texts are read once: one pass counts terms natively per document; only documents, never their words, are aggregated, and the statistics of
    the corpus are one row.
    """
    terms = query_terms(query)
    distinct = sorted(set(terms))
    counts = _counts(F.coalesce(F.col(text_col), F.lit("")), distinct)
    # A row of counts per document is all that is read again when the statistics are known.
    docs = written(documents.select(F.col(id_col), counts.alias("c")).select(id_col, F.col("c.n").alias("n"), *(F.get("c.tf", F.lit(i)).alias(f"tf{i}") for i in range(len(distinct)))))
    stats = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(distinct)))).select(F.struct("*").alias("s"))
    value = F.lit(0.0)
    for t in terms:
        i = distinct.index(t)
        df, tf = F.col(f"s.df{i}"), F.col(f"tf{i}")
        idf = F.log((F.col("s.docs") - df + 0.5) / (df + 0.5) + 1)
        value = value + F.when(df > 0, idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("n") / F.greatest(F.col("s.mean"), F.lit(1.0))))).otherwise(0.0)
    return docs.join(F.broadcast(stats)).select(id_col, value.alias("score")).where("score > 0")  # stats is one row
