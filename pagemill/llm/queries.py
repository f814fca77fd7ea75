"""Queries of the corpus problems over the test tables, and SQL where the semantics can be said in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import p1_lines, p2_garbled, p3_residue, p4_neardup, p5_content, p6_language, p7_chunks, p8_tokens, p9_mix, p10_subjects
from pagemill.llm.common import table, written


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The table loaded in order of ingestion, delta after delta."""
    return p1_lines.found(table(spark, sf, "scrapes").select("scrape_id", "url", "markdown", "ingested_at"), when="ingested_at")


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Records that held a repeated line, rebuilt without it."""
    records = table(spark, sf, "scrapes").select("scrape_id", "url", "markdown")
    return p1_lines.rebuild(records, p1_found(spark, sf)).select("scrape_id", "markdown")


def p1_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """p1_clean, the table coming as four deltas."""
    records = table(spark, sf, "scrapes").select("scrape_id", "url", "markdown")
    part = F.pmod(F.xxhash64("scrape_id"), F.lit(4))
    return p1_lines.rebuild(records, p1_lines.loaded([records.where(part == k) for k in range(4)])).select("scrape_id", "markdown")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_garbled.found(table(spark, sf, "scrapes").select("scrape_id", "text", "metadata"))


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return p2_garbled.repaired(table(spark, sf, "scrapes").select("scrape_id", "text", "metadata"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_residue.found(table(spark, sf, "scrapes").select("scrape_id", "url", "metadata", "text", "html"))


def p3_cases(spark: SparkSession, sf: str) -> DataFrame:
    return p3_residue.cases(table(spark, sf, "scrapes").select("scrape_id", "url", "metadata", "text", "html"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_neardup.found(table(spark, sf, "scrapes").select("scrape_id", "markdown"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record that has text: its group and the number of its similar records."""
    return p4_neardup.groups(*p4_neardup.similar_pairs(table(spark, sf, "scrapes").select("scrape_id", "markdown")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_content.found(table(spark, sf, "scrapes").select("scrape_id", "url", "markdown", "html"))


def p5_article(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "scrapes").select(F.col("scrape_id").alias("id"), "url", "markdown", "html")
    return p5_content.article(records, p5_content.furniture(records))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    scrapes = table(spark, sf, "scrapes")
    return p6_language.found(scrapes.select("scrape_id", "metadata", "text"), p3_residue.found(scrapes.select("scrape_id", "url", "metadata", "text", "html")))


def p6_passages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "scrapes").select(F.col("scrape_id").alias("id"), F.col("metadata.language").alias("label"), "text")
    return p6_language.passages(rows, p6_language.fit(rows))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_chunks.found(table(spark, sf, "scrapes").select("scrape_id", "markdown"), table(spark, sf, "chunk_profiles"))


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return p7_chunks.chunk(table(spark, sf, "scrapes").select("scrape_id", "markdown"), table(spark, sf, "chunk_profiles"))


def p7_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """Each profile's pieces of a record put together again without their overlaps; pieces over the limit are left out, so that they would be missed."""
    limits = table(spark, sf, "chunk_profiles").select("profile", "max_tokens")
    pieces = p7_pieces(spark, sf).join(F.broadcast(limits), "profile").where("tokens <= max_tokens")  # at most 1,000 profiles
    parts = pieces.groupBy("profile", "scrape_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "piece"))).alias("x"))  # pieces of one text
    texts = F.transform("x", lambda p, i: F.when(i == 0, p["piece"]).otherwise(F.substr(p["piece"], F.get("x", i - 1)["end"] - p["start"] + 1)))
    return parts.select("profile", "scrape_id", F.array_join(texts, "").alias("markdown"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return p8_tokens.encode(table(spark, sf, "documents").select("doc_id", "text"))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that do not come back from their ids: none."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    back = p8_tokens.decode(p8_ids(spark, sf), spark).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id", "full").where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("back"))).select("doc_id")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return p8_tokens.with_lengths(table(spark, sf, "documents").select("doc_id", "source", "text"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_mix.found(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return p9_mix.shares(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_mix_documents(spark: SparkSession, sf: str) -> DataFrame:
    return p9_mix.mix(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_within(spark: SparkSession, sf: str) -> DataFrame:
    """Of each listed source with tokens: whether no document is used more than max_uses times, its tokens are within its share, and no document that could be used once more fits into what is missing."""
    targets, sized = table(spark, sf, "mix_targets"), written(_sized(spark, sf))
    goals = p9_mix.balance(p9_mix.histogram(sized, targets), targets).where("tokens > 0").select("source", "max_uses", "goal")
    uses = sized.where("n_tokens > 0").join(p9_mix.mix(sized, targets).select("doc_id", "uses"), "doc_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    by_uses = uses.groupBy("source", "uses").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("got"), F.min("n_tokens").alias("shortest"))
    used = by_uses.groupBy("source").agg(F.max("uses").alias("most"), F.min("uses").alias("least"), F.sum("got").alias("got"), F.min_by("shortest", "uses").alias("shortest"))
    full = (F.col("goal") - F.col("got") < F.col("shortest")) | (F.col("least") == F.col("max_uses"))
    return goals.join(used, "source").select("source", ((F.col("most") <= F.col("max_uses")) & (F.col("got") <= F.col("goal")) & full).alias("within"))


def _subjects(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf, x) for x in ("documents", "subject_labels", "subjects"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_subjects.found(*_subjects(spark, sf))


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per subject."""
    return p10_found(spark, sf).groupBy("subject").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_found, p8_ids, p9_found, p10_found)
    more = (p1_clean, p1_loaded, p2_restored, p3_cases, p4_groups, p5_article, p6_passages, p7_pieces, p7_rejoined, p8_decoded, p9_shares, p9_mix_documents, p9_within, p10_composition)
    return {f.__name__: f for f in (*found, *more)}


_HOST = r"regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)', 1)), '^www\.', '')"
_LINES = rf"""
    WITH lines AS (
      SELECT scrape_id, {_HOST} AS host, unnest(string_split(markdown, chr(10))) AS line,
             generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no
      FROM scrapes),
    keyed AS (
      SELECT scrape_id, host, line_no, line,
             trim(regexp_replace(lower(regexp_replace(line, '\]\([^)]*\)', '] ', 'g')), '[^\pL]+', ' ', 'g')) AS k
      FROM lines WHERE host <> ''),
    often AS (
      SELECT host, k FROM keyed WHERE k <> '' GROUP BY host, k HAVING count(DISTINCT scrape_id) >= 5)"""
_SIZE = "CAST(floor(CASE WHEN length(markdown) - length(regexp_replace(markdown, '[{}()]', '', 'g')) > 0.05 * length(markdown) THEN length(markdown) / 3.5 ELSE length(markdown) / 4.0 END) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    sql = {
        "p1_found": f"{_LINES} SELECT scrape_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN often USING (host, k)",
        "p1_clean": f"""{_LINES},
    hit AS (SELECT DISTINCT scrape_id, line_no FROM keyed JOIN often USING (host, k))
    SELECT l.scrape_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE h.line_no IS NULL), '') AS markdown
    FROM lines l LEFT JOIN hit h ON l.scrape_id = h.scrape_id AND l.line_no = h.line_no
    WHERE l.scrape_id IN (SELECT scrape_id FROM hit) GROUP BY l.scrape_id""",
        "p4_found": f"WITH {_PAIRS} SELECT a AS scrape_id_a, b AS scrape_id_b FROM pairs",
        "p4_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
    r AS (SELECT scrape_id AS id, scrape_id AS g FROM n UNION SELECT e.y, r.g FROM r JOIN e ON e.x = r.id)
    SELECT r.id, min(g) AS "group", (SELECT count(*) FROM e WHERE e.x = r.id) AS links FROM r GROUP BY r.id""",
        "p7_rejoined": "SELECT profile, scrape_id, markdown FROM scrapes, chunk_profiles WHERE length(markdown) > 0",
        "p7_found": f"SELECT profile, scrape_id FROM scrapes, chunk_profiles WHERE {_SIZE} > max_tokens",
        "p9_within": "SELECT source, true AS within FROM mix_targets t WHERE target_weight IS NOT NULL AND source IN (SELECT source FROM documents WHERE length(text) > 0)",
        "p8_decoded": "SELECT doc_id FROM documents WHERE false",
    }
    return sql | {"p1_loaded": sql["p1_clean"]}


_PAIRS = r"""
    w AS (SELECT scrape_id, regexp_extract_all(lower(markdown), '[\pL\pN]+') AS ws FROM scrapes WHERE markdown IS NOT NULL),
    s AS (SELECT DISTINCT scrape_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
    n AS (SELECT scrape_id, count(*) AS n FROM s GROUP BY scrape_id),
    c AS (SELECT a.scrape_id AS a, b.scrape_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.scrape_id < b.scrape_id GROUP BY 1, 2),
    pairs AS (SELECT a, b FROM c JOIN n x ON x.scrape_id = a JOIN n y ON y.scrape_id = b WHERE c >= 0.6 * (x.n + y.n - c))"""
