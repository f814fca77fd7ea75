"""Problem 9: a mix of sources at target shares.

A plan is made from histograms alone: documents are counted by (source, exact token length, seeded bucket). A source with
enough tokens is taken whole as often as its budget holds it; the rest of the budget is filled by a share of each length,
and the last remainder, a few longest lengths, by a bounded knapsack over lengths (a bitset of reachable sums). A seeded
order within a length says which documents these are. Sources that cannot reach their share give all they have max_uses
times; the report and ``found`` read this off the plan.

Defined results: null and empty texts have no tokens and are never short of anything; documents of a source that is null
or not listed are left out; a listed source without documents has 0 tokens and is short; weights that are null or not
positive give share 0; max_uses null or below 1 counts as 1; a source listed twice counts by its first row in order of
weight (the largest). Repeated document rows are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import written

BUCKETS = 64


def _all():
    """A window over all rows, for tables of one row per listed source only."""
    return Window.partitionBy(F.lit(1))


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, weight, max_uses, share) with one row per source."""
    t = targets.where("source is not null").select("source", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_uses", F.lit(1)), F.lit(1)).alias("max_uses"))
    t = t.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "max_uses"))).where("rn = 1").drop("rn")
    whole = F.sum("weight").over(_all())
    return t.select("source", "weight", "max_uses", F.when(whole > 0, F.col("weight") / whole).otherwise(0.0).alias("share"))


def histogram(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(source, n_tokens, bucket, n) of the listed sources; a few rows per source and length, never one per document."""
    listed = sized.join(F.broadcast(clean_targets(targets).select("source")), "source", "left_semi")
    return listed.groupBy("source", "n_tokens", bucket_of(seed).alias("bucket")).agg(F.count("*").alias("n"))


def bucket_of(seed: int):
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)).cast("int")


def balance(hist: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, share, max_uses, tokens, total, goal) per listed source; goal: its share of budget, or of all tokens."""
    per = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"))
    rows = clean_targets(targets).join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    rows = rows.withColumn("total", F.sum("tokens").over(_all()))
    return rows.select("source", "share", "max_uses", "tokens", "total", (F.col("share") * (F.lit(budget) if budget is not None else F.col("total"))).alias("goal"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the sum is as near to budget as it can be without passing it.

    lengths ascend. Every length gives the same share of its documents, what a length falls short of passes on to the next,
    so that less than the longest length is missing at the end. Some long documents are given back, and a bounded knapsack
    fills the remainder of a few longest lengths: for each sum within it, one entry says by which length it was first reached.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take, owed = np.zeros(len(counts), np.int64), 0.0
    for i, (length, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        owed += length * n * (budget / total)
        if length > 0:
            take[i] = min(n, int(owed // length))
            owed -= int(take[i]) * length
    rest = budget - int((lengths * take).sum())
    wanted = 3 * int(lengths.max())
    for i in np.flatnonzero((take > 0) & (lengths > 0))[::-1]:
        if rest >= wanted:
            break
        back = min(int(take[i]), -(-(wanted - rest) // int(lengths[i])))
        take[i] -= back
        rest += back * int(lengths[i])
    spare = counts - take
    mask, reach = (1 << (rest + 1)) - 1, 1
    by, times = np.full(rest + 1, -1, np.int32), np.zeros(rest + 1, np.int32)
    for i in np.flatnonzero((spare > 0) & (lengths > 0) & (lengths <= rest))[::-1].tolist():
        left, size, length = min(int(spare[i]), rest // int(lengths[i])), 1, int(lengths[i])
        while left > 0 and not reach >> rest & 1:  # binary split of the count
            k = min(size, left)
            new = (reach << (k * length)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((rest >> 3) + 1, "little"), np.uint8), bitorder="little")[: rest + 1]
                at = np.flatnonzero(bits)
                by[at], times[at] = i, k
                reach |= new
            left, size = left - k, size * 2
    goal = reach.bit_length() - 1
    while goal:  # a sum is reached from one that was reached in an earlier step, so each step is used once
        i, k = int(by[goal]), int(times[goal])
        take[i] += k
        goal -= k * int(lengths[i])
    return take


def plan(hist: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, n_tokens, full_uses, extra): every document of the length full_uses times, and extra of them once more."""
    rows = balance(hist, targets, budget).withColumn("budget", F.floor("goal"))
    lengths = hist.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
    both = lengths.join(F.broadcast(rows.select("source", "max_uses", "tokens", "budget")), "source")  # as many rows as sources are listed

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n_tokens")
        tokens, most, goal = int(group["tokens"].iloc[0]), int(group["max_uses"].iloc[0]), int(group["budget"].iloc[0])
        uses = min(most, goal // tokens) if tokens else 0
        n = group["n"].to_numpy(np.int64)
        extra = fill(group["n_tokens"].to_numpy(np.int64), n, goal - uses * tokens) if uses < most and tokens else n * 0
        return pd.DataFrame({"source": group["source"], "n_tokens": group["n_tokens"], "full_uses": uses, "extra": extra})

    # One group per source, of one row per distinct length: bounded by the longest text, not by the documents.
    return both.groupBy("source").applyInPandas(one, "source string, n_tokens long, full_uses int, extra long")


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of the documents in the mix; uses at most max_uses."""
    hist = written(histogram(sized, targets, seed))
    plans = plan(hist, targets, budget)
    # Buckets are taken whole in their order; only within the last one documents are ranked.
    upto = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = hist.withColumn("upto", upto).join(plans.hint("merge"), ["source", "n_tokens"])
    per = per.select("source", "n_tokens", "bucket", "full_uses", F.greatest(F.lit(0), F.least("n", F.col("extra") - (F.col("upto") - F.col("n")))).alias("k"))
    docs = sized.select("doc_id", "source", "n_tokens", bucket_of(seed).alias("bucket")).join(per, ["source", "n_tokens", "bucket"])
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    uses = F.col("full_uses") + F.when(rank <= F.col("k"), 1).otherwise(0)
    return docs.select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")


def reached(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """(source, share, got, short) per listed source: what the plan takes of it; short where it is all there is and not its share."""
    hist = written(histogram(sized, targets, seed))
    plans = plan(hist, targets, budget)
    n = hist.groupBy("source", "n_tokens").agg(F.sum("n").alias("n")).join(plans.hint("merge"), ["source", "n_tokens"])
    got = n.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("n") * F.col("full_uses") + F.col("extra"))).alias("got"))
    rows = balance(hist, targets, budget).join(got, "source", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return rows.select("source", "share", "got", ((F.col("got") >= F.col("max_uses") * F.col("tokens")) & (F.col("goal") > F.col("got"))).alias("short"))


def shares(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, target_share, tokens_in_mix, actual_share, short) of the mix."""
    whole = F.sum("got").over(_all())
    rows = reached(sized, targets, budget)
    return rows.select("source", F.round("share", 9).alias("target_share"), F.col("got").alias("tokens_in_mix"), F.round(F.when(whole > 0, F.col("got") / whole).otherwise(0.0), 9).alias("actual_share"), "short")


def found(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Listed sources that cannot reach their share, as the plan finds."""
    return reached(sized, targets).where("short").select("source")
