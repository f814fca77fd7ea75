"""Readers and writers of the engine's tables: stored pages, results by job, proxies, checkpoints of crawls."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.functions.time import micros

PROXY_SCHEMES = ("http", "https", "socks4", "socks5")
PDF_LIMIT = 50 * 1024 * 1024


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files gave fewer: one small file must not leave pages to one core.

    Tables with more splits than cores, all large ones, stay as they are and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages: (page_id, url, html, status_code, scraped_at, ingested_at, success)."""
    rows = read_table(spark, folder, "scrapes")
    return rows.select(F.col("scrape_id").alias("page_id"), "url", "html", F.col("metadata.status_code").alias("status_code"), "scraped_at", "ingested_at", "success")


def write_results(results: DataFrame, folder: str, job_type: str = "job_type", mode: str = "append") -> None:
    """Results as JSON lines, a folder per job type."""
    results.write.mode(mode).partitionBy(job_type).json(folder)


def read_results(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def list_results(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of stored files, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def result_key(job_id, at):
    """Name of a stored result: job and second."""
    return F.concat_ws("_", job_id, F.unix_timestamp(at).cast("string"))


def is_job_id(value):
    return value.rlike("^[a-f0-9]{12}$")


def proxies(spark: SparkSession, listed: str) -> DataFrame:
    """(position, proxy_url) of a comma-separated list: known schemes only, each once, in order."""
    row = spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("position", "raw"))
    return known_proxies(row.select("position", F.trim("raw").alias("proxy_url")))


def known_proxies(listed: DataFrame) -> DataFrame:
    """Of (position, proxy_url), those of known schemes, each at its first position."""
    known = listed.where(F.lower(F.regexp_extract("proxy_url", r"^(\w+)://", 1)).isin(*PROXY_SCHEMES))
    return known.groupBy("proxy_url").agg(F.min("position").alias("position")).select("position", "proxy_url")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, warning, content) of PDF files; content of those over the limit is not kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    warning = F.when(F.col("length") > PDF_LIMIT, "PDF is larger than 50 MB").when(F.col("length") == 0, "PDF is empty")
    return files.select("path", "length", warning.alias("warning"), F.when(warning.isNull(), F.col("content")).alias("content"))


def due(schedules: DataFrame, now) -> DataFrame:
    """Enabled schedules whose next run has come."""
    return schedules.where(F.col("enabled") & (F.col("next_run") <= now))


def listed(schedules: DataFrame):
    """Schedules, newest first."""
    return schedules.orderBy(F.desc("created_at"), "job_id")


def _cron_field(text: str, low: int, high: int) -> set[int]:
    """Numbers of a field: *, numbers, ranges and steps, in lists."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        a, b = (low, high) if span == "*" else (int(first), int(last) if last else high if step else int(first))
        if not low <= a <= b <= high or step and int(step) < 1:
            raise ValueError(text)
        out.update(range(a, b + 1, int(step or 1)))
    return out


def cron_next(expression: str | None, now: datetime) -> datetime:
    """First minute after now that a cron expression of five fields names; an hour later where the expression is invalid or names none in eight years."""
    try:
        minutes, hours, days, months, weekdays = (_cron_field(x, *b) for x, b in zip((expression or "").split(), ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    except ValueError:
        return now + timedelta(seconds=3600)
    any_day, any_weekday = len(days) == 31, {x % 7 for x in weekdays} == set(range(7))
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    for _ in range(366 * 8):
        week = (day.weekday() + 1) % 7 in {x % 7 for x in weekdays}
        # Days of the month and of the week: either will do where both are named.
        fits = (week or day.day in days) if not any_day and not any_weekday else week and day.day in days
        if day.month in months and fits:
            for h in sorted(hours):
                for m in sorted(minutes):
                    if (at := day.replace(hour=h, minute=m)) > now:
                        return at
        day += timedelta(days=1)
    return now + timedelta(seconds=3600)


def next_run(expression: Column, now: Column) -> Column:
    """When a schedule runs next."""

    def run(expressions: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) else cron_next(x, pd.Timestamp(t).to_pydatetime()) for x, t in zip(expressions, times)], dtype="datetime64[us]")

    return F.pandas_udf(run, "timestamp_ntz")(expression, now)


def cached(requests: DataFrame, cache: DataFrame, now, ttl: int, key: str = "key") -> DataFrame:
    """requests with the cached response of their key, null where there is none or it is older than ttl seconds."""
    fresh = cache.where((micros(now) - micros("stored_at")) <= ttl * 1_000_000)
    newest = fresh.groupBy(key).agg(F.max_by("response", "stored_at").alias("response"))
    return requests.join(newest, key, "left")


def save_checkpoint(state: DataFrame, folder: str, job_id: str) -> None:
    """State of a crawl (kind: visited or queued, url, depth, seq), replaced as a whole."""
    state.write.mode("overwrite").parquet(f"{folder}/{job_id}")


def load_checkpoint(spark: SparkSession, folder: str, job_id: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{job_id}")


def union_first(parts: Iterable[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first part that has a key."""
    whole = None
    for i, part in enumerate(parts):
        ranked = part.withColumn("__priority", F.lit(i))
        whole = ranked if whole is None else whole.unionByName(ranked)
    first = whole.groupBy(*key).agg(F.min("__priority").alias("__priority"))
    return whole.join(first, [*key, "__priority"], "left_semi").drop("__priority")
