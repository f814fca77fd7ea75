"""Changes between snapshots of a page."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import content_hash, word_count


def difference(before: Column, after: Column, lines: int = 20) -> Column:
    """First lines of the unified difference, joined as they come; empty for equal texts, null where either is null."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        out = difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), lineterm="")
        return "".join(x for _, x in zip(range(lines), out))

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, T.StringType())(before, after)


def snapshots_changes(snapshots: DataFrame, key: str = "url", text: str = "text", ts: str = "scraped_at", tie: str | None = None, with_difference: bool = False) -> DataFrame:
    """snapshots with change_type, hashes and word counts against the one before of the same key.

    Only hashes and counts go through the window; texts do so only where the difference is asked for.
    """
    rows = snapshots.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = rows.withColumn("current_hash", content_hash(F.col(text))).withColumn("current_word_count", word_count(F.col(text)))
    w = Window.partitionBy(key).orderBy(*([ts, tie] if tie else [ts]))
    rows = rows.withColumn("previous_hash", F.lag("current_hash").over(w)).withColumn("previous_word_count", F.lag("current_word_count").over(w))
    kind = F.when(F.col("previous_hash").isNull(), "added").when(F.col("previous_hash") == F.col("current_hash"), "unchanged").otherwise("modified")
    rows = rows.withColumn("change_type", kind)
    if with_difference:
        rows = rows.withColumn("__before", F.lag(text).over(w))
        changed = F.when(F.col("change_type") == "modified", F.col("__before"))
        rows = rows.withColumn("diff_summary", difference(changed, F.col(text))).drop("__before")
    return rows


def latest_snapshots(snapshots: DataFrame, key: str = "url", text: str = "text", ts: str = "scraped_at") -> DataFrame:
    """(key, text, ts) of the newest snapshot of each key; of equal times the greater text."""
    newest = F.max_by(F.struct(text, ts), F.struct(ts, text))
    return snapshots.where(F.col(text).isNotNull()).groupBy(key).agg(newest.alias("s")).select(key, f"s.{text}", f"s.{ts}")


def compare_snapshots(before: DataFrame, after: DataFrame, key: str = "url", text: str = "text") -> DataFrame:
    """(key, change_type) of two tables with one row per key: added, unchanged, modified, and removed."""
    a = before.select(key, content_hash(F.col(text)).alias("previous_hash"))
    b = after.select(key, content_hash(F.col(text)).alias("current_hash"))
    kind = F.when(F.col("previous_hash").isNull(), "added").when(F.col("current_hash").isNull(), "removed").when(F.col("previous_hash") == F.col("current_hash"), "unchanged").otherwise("modified")
    return a.join(b, key, "full").withColumn("change_type", kind)
