"""Streaming forms: windowed usage, snapshot changes, proxy state, idempotent requests, job status, event frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.time import micros
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators.state import ProxyState


def usage_windows(events: DataFrame, ts: str, client: str, is_error: Column, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests and errors per client and window; events later than the watermark are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(client).alias("client"))
    out = w.agg(F.count("*").alias("requests"), F.sum(is_error.cast("long")).alias("errors"))
    return out.select(F.col("window.start").alias("window_start"), "client", "requests", "errors")


def idempotent(events: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def proxy_states(events: DataFrame, backoff: float = 60.0, threshold: int = 5) -> DataFrame:
    """State of each proxy after every batch that holds one of its events."""
    fields = ("ok", "speed", "began", "until", "succeed", "timeouts", "failures", "reanimated", "recent_succeed", "recent_timeouts", "recent_failures")
    stored = "ok boolean, speed double, began double, until double, succeed long, timeouts long, failures long, reanimated long, recent_succeed long, recent_timeouts long, recent_failures long"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        proxy = None
        if state.exists:
            proxy = ProxyState(0.0)
            for name, value in zip(fields, state.get):
                setattr(proxy, name, value)
        rows = pd.concat(list(batches))[["at", "kind", "latency"]].sort_values(["at", "kind", "latency"])  # one batch of one proxy
        for at, kind, latency in rows.itertuples(index=False):
            proxy = proxy or ProxyState(at)
            proxy.see(at, kind, None if pd.isna(latency) else latency, backoff)
        state.update(tuple(getattr(proxy, f) for f in fields))
        yield pd.DataFrame([(key[0], *(getattr(proxy, f) for f in ProxyState.FIELDS), proxy.evicted(threshold))], columns=["proxy_url", *ProxyState.FIELDS, "evict"])

    rows = events.where("ts is not null and proxy_url is not null and kind in ('ok', 'fail', 'timeout')").select("proxy_url", (micros("ts") / 1e6).alias("at"), "kind", "latency")
    return rows.groupBy("proxy_url").applyInPandasWithState(update, f"proxy_url string, {ProxyState.TYPES}, evict boolean", stored, "update", GroupStateTimeout.NoTimeout)


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(url, scraped_at, change_type) of each snapshot (url, hash, scraped_at) against the last of its url so far."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["scraped_at", "hash"])  # one batch of one url
        kinds = []
        for h in rows["hash"]:
            kinds.append("added" if last is None else "unchanged" if last == h else "modified")
            last = h
        state.update((last,))
        yield pd.DataFrame({"url": key[0], "scraped_at": rows["scraped_at"].to_numpy(), "change_type": kinds})

    return snapshots.where("url is not null and hash is not null").groupBy("url").applyInPandasWithState(update, "url string, scraped_at timestamp, change_type string", "hash string", "append", GroupStateTimeout.NoTimeout)


def job_status(events: DataFrame, key: str, status: str, ts: str) -> DataFrame:
    """Latest status of each job; for update mode."""
    return events.groupBy(key).agg(F.max_by(status, ts).alias("status"), F.max(ts).alias("updated_at"))


def event_frame(kind: Column, payload: Column) -> Column:
    """A server-sent event of a JSON payload."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))
