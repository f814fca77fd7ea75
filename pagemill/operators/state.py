"""Folds over ordered events of one key: proxy state, rate limits, idempotent replays, latest job status.

A fold reads its key's events in order from a sorted partition, one at a time, so the memory of a task does not grow with
the busiest key; keys never need to fit into a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.time import micros

RECENT = 300.0
KEEP, NEW = 0.7, 0.3


class ProxyState:
    """Counters of one proxy; recent ones begin anew with the first event 300 s after their window began."""

    FIELDS = ("ok", "speed", "succeed", "timeouts", "failures", "reanimated", "recent_succeed", "recent_timeouts", "recent_failures")
    TYPES = "ok boolean, speed double, succeed long, timeouts long, failures long, reanimated long, recent_succeed long, recent_timeouts long, recent_failures long"

    def __init__(self, began: float):
        self.ok, self.speed, self.began, self.until = True, 0.0, began, None
        self.succeed = self.timeouts = self.failures = self.reanimated = 0
        self.recent_succeed = self.recent_timeouts = self.recent_failures = 0

    def see(self, at: float, kind: str, latency: float | None, backoff: float) -> None:
        if at - self.began >= RECENT:
            self.recent_succeed = self.recent_timeouts = self.recent_failures = 0
            self.began = at
        if self.until is not None and at >= self.until:
            self.ok, self.until, self.reanimated = True, None, self.reanimated + 1
        if kind == "ok":
            self.ok, self.until = True, None
            self.succeed += 1
            self.recent_succeed += 1
            if latency is not None:
                self.speed = KEEP * self.speed + NEW * latency if self.speed else latency
            return
        self.ok, self.until = False, at + backoff
        self.failures += 1
        self.recent_failures += 1
        if kind == "timeout":
            self.timeouts += 1
            self.recent_timeouts += 1

    def evicted(self, threshold: int) -> bool:
        return self.recent_succeed == 0 and self.recent_failures >= threshold


def fold(events: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[tuple], Any], step: Callable[[Any, tuple], Any], end: Callable[[Any], tuple], schema: str) -> DataFrame:
    """(key, fields of schema): step over a key's events in order, end once per key."""
    fields = [x.strip().split()[0] for x in schema.split(",")]
    key_type = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, some = None, None, False
        for batch in batches:
            out = []
            for k, *row in zip(batch[key], *(batch[c] for c in columns)):
                if not some or k != at:
                    if some:
                        out.append((at, *end(state)))
                    at, state, some = k, start(tuple(row)), True
                state = step(state, tuple(row))
            if out:
                yield pd.DataFrame(out, columns=[key, *fields])
        if some:
            yield pd.DataFrame([(at, *end(state))], columns=[key, *fields])

    rows = events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return rows.select(key, *columns).mapInPandas(run, f"{key} {key_type}, {schema}")


def proxy_state(events: DataFrame, backoff: float = 60.0, threshold: int = 5) -> DataFrame:
    """State of each proxy after its last event, and whether it should be evicted."""
    rows = events.where("ts is not null and kind in ('ok', 'fail', 'timeout')").withColumn("at", micros("ts") / 1e6)

    def step(state: ProxyState, row: tuple) -> ProxyState:
        at, kind, latency = row
        state.see(at, kind, None if latency is None or latency != latency else latency, backoff)
        return state

    def end(state: ProxyState) -> tuple:
        return (*(getattr(state, f) for f in ProxyState.FIELDS), state.evicted(threshold))

    return fold(rows, "proxy_url", ["at", "kind", "latency"], ["at", "kind", "latency"], lambda row: ProxyState(row[0]), step, end, ProxyState.TYPES + ", evict boolean")


def pool_stats(state: DataFrame) -> DataFrame:
    """One row: proxies, those in order, those out, mean speed of those in order that have one."""
    fast = F.when(F.col("ok") & (F.col("speed") > 0), F.col("speed"))
    return state.agg(F.count("*").alias("total"), F.count_if("ok").alias("active"), F.count_if(~F.col("ok")).alias("evicted"), F.round(F.coalesce(F.avg(fast), F.lit(0.0)), 4).alias("avg_speed"))


def least_used(state: DataFrame, uses: str) -> DataFrame:
    """The proxy in order with the fewest uses; ties by url."""
    return state.where("ok").orderBy(uses, "proxy_url").limit(1)


def admitted(events: DataFrame, key: str, rpm: int | Column, id_col: str, ts: str = "ts") -> DataFrame:
    """events' ids with allowed: a leaky bucket per key, which holds rpm requests and drains rpm a minute. rpm may be each row's own."""
    key_type, id_type = (events.schema[c].dataType.simpleString() for c in (key, id_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, level, last = None, 0.0, 0.0
        for batch in batches:
            out = []
            for k, row, t, rpm in zip(batch[key], batch[id_col], batch["__at"], batch["__rpm"]):
                if k != at:
                    at, level, last = k, 0.0, t
                level, last = max(0.0, level - (t - last) * rpm / 60.0), t
                ok = level + 1 <= rpm
                level += ok
                out.append((k, row, ok))
            yield pd.DataFrame(out, columns=[key, id_col, "allowed"])

    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__at", micros(ts) / 1e6)
    rows = rows.withColumn("__rpm", (rpm if isinstance(rpm, Column) else F.lit(rpm)).cast("double"))
    rows = rows.repartition(key).sortWithinPartitions(key, "__at", id_col)
    return rows.select(key, id_col, "__at", "__rpm").mapInPandas(run, f"{key} {key_type}, {id_col} {id_type}, allowed boolean")


def first_of_day(events: DataFrame, keys: list[str], id_col: str, ts: str = "ts", hours: int = 24) -> DataFrame:
    """(id, replayed): an event within hours of the last one of its key that was no replay repeats that one's response."""
    id_type = events.schema[id_col].dataType.simpleString()
    span = hours * 3_600_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, opened = None, 0
        for batch in batches:
            out = []
            for key, row, t in zip(batch["__key"], batch["id"], batch["__at"]):
                fresh = key != at or t - opened >= span
                if fresh:
                    at, opened = key, t
                out.append((row, not fresh))
            yield pd.DataFrame(out, columns=[id_col, "replayed"])

    # Two 64-bit hashes name a key; events of a key meet in one sorted partition and pass through one by one.
    key = F.concat_ws("-", F.xxhash64(*keys), F.xxhash64(*reversed(keys), F.lit(1)))
    rows = events.where(F.col(ts).isNotNull()).select(key.alias("__key"), F.col(id_col).alias("id"), micros(ts).alias("__at"))
    return rows.repartition("__key").sortWithinPartitions("__key", "__at", "id").mapInPandas(run, f"{id_col} {id_type}, replayed boolean")


def latest_status(events: DataFrame, key: str, status: str, ts: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, ts).alias("status"), F.max(ts).alias("updated_at"))


def within_ttl(rows: DataFrame, ts: str, now, seconds: int) -> DataFrame:
    """Rows no older than seconds at now."""
    return rows.where((micros(F.lit(now)) - micros(ts)) <= seconds * 1_000_000)


def merge_cookies(old, new):
    """Union of two maps; values of the second win."""
    keep = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.coalesce(new, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(keep, F.coalesce(new, F.create_map().cast("map<string,string>")))
