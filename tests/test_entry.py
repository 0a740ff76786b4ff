import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmill.plans import registry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_needs_no_training_text_package():
    for path in glob.glob("quillmill/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "quillmill.llm" not in open(path).read(), path


def test_each_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, small)
    want = con.sql(registry.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
