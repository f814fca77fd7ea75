import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from pagemill.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_corpus_operators():
    code = "import sys; import pagemill.plans.catalog, pagemill.plans.stages, pagemill.streaming.streams, pagemill.sources.tables; sys.exit(any(m.startswith('pagemill.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "markdown" in df.columns


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["url_parts", "text_measures", "page_metadata", "usage_domains", "changes_snapshots", "crawl_map"])
def test_catalog_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(catalog.oracle_sql()[name])
    names = sorted(want.columns)
    got = catalog.queries()[name](spark, str(DATA)).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.select(*map(duckdb.ColumnExpression, names)).fetchall()))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_filters_reach_the_scan_below_the_page_function(spark):
    from pyspark.sql import functions as F

    from pagemill.operators import pages

    df = spark.read.parquet(str(DATA / "scrapes.parquet")).withColumn("m", pages.metadata(F.col("html"))).where("success").select("scrape_id", "m.title")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(success,true)" in plan.replace(" ", "") or "PushedFilters: [IsNotNull(success), EqualTo(success,true)]" in plan
    assert "markdown" not in plan
