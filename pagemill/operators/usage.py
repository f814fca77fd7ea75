"""Usage and metrics over event tables: counters, rates, histograms, top clients, pool statistics, text export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def usage_by_client(events: DataFrame, client: str, endpoint: str, ts: str, size: Column, is_error: Column) -> DataFrame:
    """A row per client: requests, bandwidth, errors, error rate, first and last seen, requests per endpoint.

    Counts go over (client, endpoint) first, so the map of a client is built from as many rows as it has endpoints.
    """
    per = events.groupBy(F.col(client).alias("client"), F.col(endpoint).alias("endpoint")).agg(
        F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(is_error.cast("long")).alias("errors"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")
    )
    out = per.groupBy("client").agg(
        F.sum("n").alias("total_requests"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bandwidth_bytes"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("endpoint").isNotNull(), F.struct("endpoint", "n"))))).alias("endpoints"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return out.withColumn("error_rate", F.round(F.col("total_errors") / F.greatest("total_requests", F.lit(1)), 4))


def usage_summary(events: DataFrame, client: str, size: Column, is_error: Column) -> DataFrame:
    """One row of totals."""
    per = events.groupBy(F.col(client).alias("client")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(is_error.cast("long")).alias("errors"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bandwidth_bytes"), F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"), F.count("client").alias("unique_clients"))
    return total.withColumn("error_rate", F.round(F.col("total_errors") / F.greatest("total_requests", F.lit(1)), 4))


def top_clients(events: DataFrame, client: str, k: int = 10) -> DataFrame:
    """The k busiest clients; ties by name."""
    return events.groupBy(F.col(client).alias("client")).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "client").limit(k)


def endpoint_totals(events: DataFrame, endpoint: str) -> DataFrame:
    return events.groupBy(F.col(endpoint).alias("endpoint")).agg(F.count("*").alias("requests"))


def domain_stats(events: DataFrame, domain: Column, success: Column) -> DataFrame:
    """Successes and failures per domain; rows of unknown outcome do not count."""
    known = events.select(domain.alias("domain"), success.alias("ok")).where("domain is not null and ok is not null")
    out = known.groupBy("domain").agg(F.sum(F.col("ok").cast("long")).alias("success"), F.sum((~F.col("ok")).cast("long")).alias("failed"))
    out = out.withColumn("total", F.col("success") + F.col("failed"))
    return out.withColumn("success_rate", F.round(F.col("success") / F.col("total"), 3))


def histogram(events: DataFrame, value: Column, bounds: Sequence[float] = BOUNDS, compat: bool = False) -> DataFrame:
    """(position, le, n): values up to each bound, then all. One pass, one row of sums.

    With compat, counts are accumulated once more, as a widespread exporter's defect has it.
    """
    v = events.select(value.cast("double").alias("v")).where("v is not null")
    row = v.agg(*(F.sum((F.col("v") <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("all"))
    entries = []
    for i, b in enumerate(bounds):
        n = F.coalesce(F.col(f"b{i}"), F.lit(0))
        if compat:
            n = sum((F.coalesce(F.col(f"b{j}"), F.lit(0)) for j in range(i)), n)
        entries.append(F.struct(F.lit(i).alias("position"), F.lit(str(b)).alias("le"), n.cast("long").alias("n")))
    entries.append(F.struct(F.lit(len(bounds)).alias("position"), F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return row.select(F.inline(F.array(*entries)))


def prometheus(counters: DataFrame, prefix: str) -> DataFrame:
    """(name, text) of counters (name, help, value) in text exposition format."""
    name = F.concat(F.lit(prefix), F.col("name"))
    text = F.concat(F.lit("# HELP "), name, F.lit(" "), F.col("help"), F.lit("\n# TYPE "), name, F.lit(" counter\n"), name, F.lit(" "), F.col("value").cast("string"))
    return counters.select("name", text.alias("text"))


def histogram_sum(events: DataFrame, value: Column) -> DataFrame:
    """One row (count, sum) of the values, the sum to four places."""
    return events.select(value.cast("double").alias("v")).agg(F.count("v").alias("count"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("sum"))


def prometheus_histogram(counts: DataFrame, total: DataFrame, name: str, help_text: str, prefix: str) -> DataFrame:
    """(position, line) of a histogram (position, le, n) and its (count, sum) in text exposition format."""
    full = prefix + name
    head = counts.sparkSession.createDataFrame([(-2, f"# HELP {full} {help_text}"), (-1, f"# TYPE {full} histogram")], "position int, line string")
    bounds = counts.select("position", F.concat(F.lit(f'{full}_bucket{{le="'), "le", F.lit('"} '), F.col("n").cast("string")).alias("line"))
    ends = F.array(F.struct(F.lit(1000).alias("position"), F.concat(F.lit(f"{full}_sum "), F.col("sum").cast("string")).alias("line")), F.struct(F.lit(1001).alias("position"), F.concat(F.lit(f"{full}_count "), F.col("count").cast("string")).alias("line")))
    return head.union(bounds).union(total.select(F.inline(ends)))


def acquire_stats(samples: DataFrame, key: str, ts: str, ms: str, digits: int = 2) -> DataFrame:
    """(key, acquires, avg_ms, p95_ms): mean and nearest-rank percentile of the latest samples.

    Of n samples in all, n up to 1,000 count; beyond that the buffer was cut to its last 500 each time it passed 1,000.
    """
    valid = samples.where(F.col(ms).isNotNull())
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(ms)))
    kept = valid.withColumn("__rank", latest).where("__rank <= 1000").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("__rank").alias("r"), F.col(ms).alias("v")))).alias("xs"))
    n = valid.groupBy(key).agg(F.count("*").alias("acquires"))
    size = F.when(F.col("acquires") <= 1000, F.col("acquires")).otherwise(500 + (F.col("acquires") - 1001) % 501).cast("int")
    values = F.sort_array(F.transform(F.slice("xs", F.lit(1), size), lambda x: x["v"]))
    rows = n.join(kept, key).select(key, "acquires", values.alias("v"))
    at = F.least(F.floor(F.size("v") * 0.95).cast("int"), F.size("v") - 1)
    return rows.select(key, "acquires", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), digits).alias("avg_ms"), F.round(F.get("v", at), digits).alias("p95_ms"))


def status_rollup(queue_ok: Column, pool_ok: Column) -> Column:
    return F.when(~queue_ok, "unhealthy").when(~pool_ok, "degraded").otherwise("ok")
