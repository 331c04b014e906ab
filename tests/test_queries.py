"""The driver's contract: names, SQL for known queries, the smallest data set, and the core without its optional part."""

import math
import os
import subprocess
import sys
from datetime import datetime, timezone

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from storyweft import queries as core

SMALL = "/root/testdata/sf0.001"
# Least rows of the queries that SQL can't state: several passes over text or markup.
WITHOUT_SQL = {"normalized_entries": 100, "p2_found": 100, "readable_articles": 1, "safe_markup": 50, "story_board": 50}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    """A value as it is compared."""
    if value is None or isinstance(value, float) and math.isnan(value) or value is pd.NaT:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value).isoformat()
    return str(value) if not isinstance(value, (int, bool)) else int(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW \"{name[:-8]}\" AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    """Rows and columns are those of the SQL; the few queries without one have the columns they say."""
    df = core.queries()[name](spark, SMALL)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in core.SQL:
        assert name in WITHOUT_SQL and len(got) >= WITHOUT_SQL[name]
        return
    cursor = duck.execute(core.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_entry_and_views(spark):
    assert entry.entry(spark).count() > 0
    from storyweft.plans.views import Views

    v = Views.load(spark, SMALL)
    v.register(spark)
    assert spark.sql("select count(*) from sw_clusters").first()[0] >= 0
    assert v.sections.count() >= 0 and v.snippets.count() > 0


def test_core_stands_alone():
    """Imports of the core don't reach for the optional part."""
    code = "import sys; sys.modules['storyweft.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
