"""Problem 1: lines that stand in many records of one host.

The state has two tables. ``counts`` (h1, h2, n): one row per line of a source, with the number of records that hold it.
``pending`` (h1, h2, id, line_no): where the lines below the threshold stand, so never more than threshold - 1 records of a
line. ``advance`` merges a new partition as a delta: counts are added, the lines now at the threshold are known, and rows of
the partition and pending rows that are of such a line are the new marks; what is left is the new pending table. So a record
that came earlier is touched only when a line of its own crosses, and a later one meets all lines over the threshold by
then. ``loaded`` does so for one partition after the other; ``rebuild`` rewrites only the records that hold a mark. A line
is named by two 64-bit hashes of its source and its words, so neither table nor shuffle carries text.

Defined results: null or blank markdown, and a url without host, give no line. Lines without letters are never marked.
Each input row is one record; a line repeated within a record counts once and is marked everywhere. An empty table gives
empty results. Columns of the input other than those named pass through ``rebuild`` unharmed, whatever their names. Counts
are pre-aggregated before the shuffle. Lines with more than a 10,000th of all occurrences, fewer than 10,000 therefore, are
broadcast, and the rows that hold them are marked where they lie; only rows of other lines are shuffled by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import discard, host_of, meet, written

THRESHOLD = 5
#: Parts in which a whole table is loaded.
PARTS = 4


def words_of(line: Column) -> Column:
    """Runs of letters in lower case, joined by spaces; the target of a link does not count."""
    text = F.regexp_replace(line, r"\]\([^)]*\)", "] ")
    return F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " "))


def _keys(markdown: Column, host: Column) -> Column:
    """array<struct<h1, h2, no>> of the lines with letters; the words of a line are made once."""

    def key(words: Column, no: Column) -> Column:
        return F.when(words != "", F.struct(F.xxhash64(host, words).alias("h1"), F.xxhash64(words, host, F.lit(1)).alias("h2"), no.alias("no")))

    return F.filter(F.transform(F.transform(F.split(markdown, "\n"), words_of), key), lambda k: k.isNotNull())


def lines_of(records: DataFrame, id_col: str = "scrape_id", markdown: str = "markdown", url: str = "url") -> DataFrame:
    """(id, line_no, h1, h2, first) of every line with letters; first: the first time that the record holds it."""
    host = host_of(F.col(url))

    def marked(keys: Column) -> Column:
        def row(k: Column, i: Column) -> Column:
            before = F.get(keys, i - 1)
            return F.struct(k["no"].alias("line_no"), k["h1"].alias("h1"), k["h2"].alias("h2"), ((i == 0) | (before["h1"] != k["h1"]) | (before["h2"] != k["h2"])).alias("first"))

        return F.transform(keys, row)

    rows = records.where(host.isNotNull()).select(F.col(id_col).alias("id"), let(F.array_sort(_keys(F.col(markdown), host)), marked).alias("lines"))
    return rows.select("id", F.inline("lines"))


def line_counts(records: DataFrame, markdown: str = "markdown", url: str = "url") -> DataFrame:
    """The delta of a partition: records per line of each source."""
    return _counted(lines_of(records.withColumn("__id", F.lit(0)), "__id", markdown, url))


def _counted(lines: DataFrame) -> DataFrame:
    return lines.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"))


def merge(state: DataFrame | None, delta: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The new state, and the lines (h1, h2, n) that crossed the threshold with this delta."""
    if state is None:
        return delta, delta.where(F.col("n") >= threshold)
    both = state.withColumn("old", F.col("n")).unionByName(delta.withColumn("old", F.lit(0).cast("long")))
    both = both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("old").alias("old"))
    return both.drop("old"), both.where((F.col("n") >= threshold) & (F.col("old") < threshold)).drop("old")


def split_by(rows: DataFrame, counts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """rows (h1, h2, ...) with over: whether their line is at the threshold."""
    met = meet(rows, counts.withColumn("over", F.lit(True)), ["h1", "h2"], "n", "left", threshold)
    return met.withColumn("over", F.coalesce("over", F.lit(False)))


def marked_lines(records: DataFrame, crossed: DataFrame, id_col: str = "scrape_id", markdown: str = "markdown", url: str = "url") -> DataFrame:
    """(id, line_no) of the crossed lines (h1, h2, n), line_no from 0."""
    found = split_by(lines_of(records, id_col, markdown, url), crossed, 0).where("over")
    return found.select(F.col("id").alias(id_col), "line_no")


def advance(state: tuple[DataFrame | None, DataFrame | None], delta: DataFrame, threshold: int = THRESHOLD) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """The state (counts, pending) after the partition delta, and the marks (scrape_id, line_no) that it adds."""
    counts, pending = state
    new = written(lines_of(delta))
    after = written(merge(counts, _counted(new), threshold)[0])
    rows = new.select("h1", "h2", "id", "line_no")
    both = written(split_by(rows if pending is None else rows.unionByName(pending), after, threshold))
    discard(counts, new)
    return (after, both.where("not over").drop("over")), both.where("over").select(F.col("id").alias("scrape_id"), "line_no")


def loaded(partitions: list[DataFrame], threshold: int = THRESHOLD) -> DataFrame:
    """(scrape_id, line_no) of the marks after the partitions have come one after the other."""
    state, marks = (None, None), None
    for delta in partitions:
        state, added = advance(state, delta, threshold)
        marks = added if marks is None else marks.union(added)
    return marks


def partitions_of(records: DataFrame, when: str = "ingested_at", most: int = PARTS) -> list[DataFrame]:
    """records in order of ingestion, cut at quarters of years into at most so many parts; rows without a time come first."""
    quarters = sorted(r[0] for r in records.where(F.col(when).isNotNull()).select(F.date_trunc("quarter", when).cast("timestamp_ntz")).distinct().collect())  # as many as the calendar has
    cuts = [quarters[len(quarters) * i // most] for i in range(1, most) if 0 < len(quarters) * i // most < len(quarters)]
    bounds = [None, *dict.fromkeys(cuts), None]
    out = []
    for low, high in zip(bounds, bounds[1:]):
        part = records
        if low is not None:
            part = part.where(F.col(when) >= F.lit(low).cast("timestamp_ntz"))
        if high is not None:
            before = F.col(when) < F.lit(high).cast("timestamp_ntz")
            part = part.where(before | F.col(when).isNull() if low is None else before)
        out.append(part)
    return out


def rebuild(records: DataFrame, marks: DataFrame, id_col: str = "scrape_id", markdown: str = "markdown") -> DataFrame:
    """Only the records with a marked line, their markdown without these lines; other columns as they were."""
    drop = marks.groupBy(F.col(id_col).alias("__id")).agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(F.split(F.col(markdown), "\n"), lambda line, i: ~F.array_contains(F.col("__drop"), i))
    return records.join(drop, F.col(id_col) == F.col("__id")).withColumn(markdown, F.array_join(kept, "\n")).drop("__id", "__drop")


def found(records: DataFrame, threshold: int = THRESHOLD, when: str | None = None) -> DataFrame:
    """(scrape_id, line_no) of the marked lines; with when, a time of ingestion, the table is loaded in parts in its order."""
    return loaded([records] if when is None else partitions_of(records, when), threshold)
