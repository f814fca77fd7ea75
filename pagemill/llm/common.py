"""Helpers shared by the corpus operators: tables, hosts; written intermediate results are those of the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.scratch import discard, remove_written, shared_folder, written

__all__ = ("HOST_PATTERN", "discard", "host_of", "meet", "remove_written", "shared_folder", "table", "written")

#: Optional scheme, optional user info, then the host without its port.
HOST_PATTERN = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host_of(url: Column) -> Column:
    """Host in lower case, without port and leading ``www.``; null where the url has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST_PATTERN, 1)), r"^www\.", "")
    return F.when(host != "", host)


#: Bound of the number of keys whose rows are not shuffled by meet(): those with more than this share of the whole weight.
MOST_HOT = 10_000


def meet(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, how: str = "inner", least: float = 0) -> DataFrame:
    """rows joined with side, which has one row per key and, in weight, about how many rows have it.

    Keys with more than 1/MOST_HOT of the whole weight, fewer than MOST_HOT therefore, are broadcast and their rows stay
    where they lie; only rows of other keys are shuffled, so no task gets a hot key. how: inner or left. Keys of a weight
    below least meet nothing.
    """
    bound = (side.agg(F.sum(weight)).first()[0] or 0) / MOST_HOT
    columns = [c for c in side.columns if c not in (*keys, weight)]
    side = side.where(F.col(weight) >= least)
    hot = side.where(F.col(weight) > bound).drop(weight).withColumn("__hot", F.lit(True))
    near = rows.join(F.broadcast(hot), keys, "left")  # fewer than MOST_HOT rows
    rest = near.where("__hot is null").drop("__hot", *columns).join(side.where(F.col(weight) <= bound).drop(weight), keys, how)
    return near.where("__hot").drop("__hot").unionByName(rest)
