"""Problem 4: records whose sets of word shingles are similar, without comparing all pairs.

Each text's set of hashed shingles is sketched by a SetSketch: register i holds floor(1 - log_b x) of the least x that any
shingle draws from an exponential law for i, cut to 0..q+1. Sketches of parts merge by the maximum of registers. Texts
with equal sets are one class, found by a fingerprint. Classes meet where all registers of a band are equal; such pairs of
fitting sizes are estimated jointly by likelihood from the counts of greater, smaller and equal registers, and those that
may reach the threshold are verified on the sets themselves.

``similar_pairs`` gives pairs between class representatives plus membership; ``found`` expands them.

Defined results: a null text, or one with fewer words than a shingle has, is similar to nothing, and so is a row
without id. Rows that repeat an id
with the same text count once; of an id with several texts, the one whose set has the least fingerprint counts. Every pair found is verified; of pairs at the threshold exactly, banding misses
(1 - t^rows)^bands, 0.6% with the defaults at 0.6, fewer above it. A class that holds a third of all rows is one
representative from the first shuffle on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, meet, written

WORDS = 3
THRESHOLD = 0.6
BAND_ROWS, BANDS = 5, 64
#: Base of the spacing, rate, and largest register value of the sketch.
BASE, RATE, TOP = 1.001, 20.0, 65534
_MEMO = 200_000


@lru_cache(maxsize=1)
def _factors(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(1, 1 << 63, m, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, m, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit hashes of the runs of n consecutive words of a text."""

    def __init__(self, n: int):
        import regex
        from xxhash import xxh3_64_intdigest

        self.n, self.find, self.hash, self.memo = n, regex.compile(r"[\p{L}\p{N}]+").findall, xxh3_64_intdigest, {}
        self.odd = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(n)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.find(text.lower()) if text else []
        if len(words) < self.n:
            return np.zeros(0, np.uint64)
        memo, new = self.memo, self.hash
        if len(memo) > _MEMO:
            memo.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            x = memo.get(w)
            if x is None:
                x = memo[w] = new(w.encode())
            h[i] = x
        k = len(words) - self.n + 1
        s = np.zeros(k, np.uint64)
        for j, odd in enumerate(self.odd):
            s += h[j : j + k] * odd
        return np.unique(_mix(s))


def sketch(hashes: np.ndarray, m: int) -> np.ndarray:
    """Registers of a set of hashes; the sketch of a union is the maximum of the sketches."""
    a, c = _factors(m)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048, None] * a[None, :]
        part ^= c[None, :]
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, part.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def estimate(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of rows of registers, cardinalities known."""
    m = u.shape[1]
    more, less = (u > v).sum(1), (u < v).sum(1)
    same = m - more - less
    wu, wv = nu / (nu + nv), nv / (nu + nv)
    low, high = np.zeros(len(u)), np.minimum(nu / nv, nv / nu)
    log_b = math.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / log_b

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(np.maximum(wu - wv * j, 1e-12)), p(np.maximum(wv - wu * j, 1e-12))
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    ratio = (math.sqrt(5) - 1) / 2  # the likelihood is concave: golden section
    for _ in range(30):
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        right = likelihood(x) < likelihood(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def sketches(records: DataFrame, id_col: str, text_col: str, words: int, rows: int, bands: int) -> DataFrame:
    """(id, n, fp, registers, bands) of every text that has a shingle."""
    m = rows * bands
    id_type = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"]):
                s = shingles(text)
                if not len(s):
                    continue
                k = sketch(s, m)
                h = salt.copy()
                for column in k.reshape(bands, rows).T.astype(np.uint64):
                    h = _mix(h * np.uint64(31) + column)
                out.append((key, len(s), fingerprint(s), k.tobytes(), h.astype(np.int64)))
            yield pd.DataFrame(out, columns=["id", "n", "fp", "registers", "bands"])

    texts = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.mapInPandas(run, f"id {id_type}, n int, fp string, registers binary, bands array<long>")


def similar_pairs(records: DataFrame, id_col: str = "scrape_id", text_col: str = "markdown", threshold: float = THRESHOLD, words: int = WORDS, rows: int = BAND_ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(rep_a, rep_b, similarity) of classes of equal sets, and the membership (rep, id)."""
    records = records.select(id_col, text_col).where(F.col(id_col).isNotNull())
    sketched = written(sketches(records, id_col, text_col, words, rows, bands))
    ids = sketched.groupBy("id").agg(F.min("fp").alias("fp"))
    reps = ids.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = meet(ids, reps, ["fp"], "n").select("rep", "id")
    # Of a class, one row goes on: the one whose id is the representative. (n, registers, bands follow from the set.)
    only = written(sketched.join(reps, (sketched.fp == reps.fp) & (sketched.id == reps.rep), "left_semi").dropDuplicates(["id"]))
    keys = only.select("id", "n", F.explode("bands").alias("key"))
    a, b = keys.toDF("a", "na", "key"), keys.toDF("b", "nb", "key")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    met = a.join(b, "key").where(fits).select("a", "b").distinct()
    side = only.select("id", "n", "registers")
    met = met.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
    slack = 4 * math.sqrt(threshold * (1 - threshold) / (rows * bands))

    @F.pandas_udf("double")
    def likely(na: pd.Series, ra: pd.Series, nb: pd.Series, rb: pd.Series) -> pd.Series:
        if not len(na):
            return pd.Series([], dtype="float64")
        u, v = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (ra, rb))
        return pd.Series(estimate(u, v, na.to_numpy(float), nb.to_numpy(float)))

    near = written(met.where(likely("na", "ra", "nb", "rb") >= threshold - slack).select("a", "b"))
    needed = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    sets = shingle_sets(records.join(needed, records[id_col] == needed["id"], "left_semi"), id_col, text_col, words)
    sets = sets.join(only.select("id", "fp"), ["id", "fp"], "left_semi").dropDuplicates(["id"]).select("id", "shingles")
    near = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    pairs = near.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold), members


def fingerprint(s: np.ndarray) -> str:
    """Name of a set of hashes: equal sets have equal names."""
    fp = _mix(np.array([s.sum(), np.bitwise_xor.reduce(_mix(s))], np.uint64)).astype(np.int64)
    return f"{fp[0]:x}.{fp[1]:x}"


def shingle_sets(records: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, fp, shingles) of the whole texts."""

    @F.pandas_udf("fp string, shingles array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        shingles = Shingler(words)
        found = [shingles(t) for t in texts]
        return pd.DataFrame({"fp": [fingerprint(s) if len(s) else None for s in found], "shingles": [s.astype(np.int64) for s in found]})

    return records.select(F.col(id_col).alias("id"), sets(text_col).alias("s")).select("id", "s.fp", "s.shingles")


def groups(pairs: DataFrame, members: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, group, links): connected groups by label spreading over representatives; links counts a record's similar records.

    Each round gives every node the least label among its neighbours and then the label of that label, so that long
    chains halve; it stops when nothing changes.
    """
    edges = written(pairs.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")).union(pairs.select("rep_b", "rep_a")))
    labels = written(members.select(F.col("rep").alias("x")).distinct().withColumn("label", F.col("x")))
    before = None
    for _ in range(rounds):
        least = edges.join(labels.toDF("y", "other"), "y").groupBy("x").agg(F.min("other").alias("other"))
        hooked = labels.join(least, "x", "left").select("x", F.least("label", F.coalesce("other", "label")).alias("label"), F.col("label").alias("old"))
        jumped = hooked.join(hooked.select(F.col("x").alias("label"), F.col("label").alias("far")), "label", "left")
        new = written(jumped.select("x", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        discard(labels, before)
        labels, before = new.select("x", "label"), new
        if new.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("groups did not settle; raise rounds")
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    near = edges.join(sizes.toDF("y", "size"), "y").groupBy("x").agg(F.sum("size").alias("near"))
    out = members.join(labels.toDF("rep", "group"), "rep").join(sizes, "rep").join(near.toDF("rep", "near"), "rep", "left")
    return out.select("id", "group", (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("links"))


def found(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (scrape_id_a, scrape_id_b), a < b: this result asks for classes expanded."""
    pairs, members = similar_pairs(records, threshold=threshold)
    a, b = members.toDF("rep_a", "a"), members.toDF("rep_b", "b")
    across = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select(F.least("a", "b").alias("scrape_id_a"), F.greatest("a", "b").alias("scrape_id_b"))
    within = members.toDF("rep", "scrape_id_a").join(members.toDF("rep", "scrape_id_b"), "rep").where("scrape_id_a < scrape_id_b").select("scrape_id_a", "scrape_id_b")
    return across.union(within)
