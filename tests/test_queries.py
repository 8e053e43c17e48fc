"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def names():
    import re
    from pathlib import Path

    catalog = Path(entry.__file__).parent / "tidemark" / "catalog"
    found = []
    for f in sorted(catalog.glob("*.py")):
        found += re.findall(r'@query\(\s*"([a-z0-9_]+)"', f.read_text())
    return found + [f"p{n}_extract_actions_{lang}" for n, lang in ((12, "java"), (13, "python"), (14, "csharp"))]


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = pd.DataFrame(rel.fetchall(), columns=cols, dtype=object)
    assert sorted(got.columns) == sorted(cols)
    assert canon(got.astype(object)) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_listed(spark):
    """All of the catalog; what an optional package adds beside it is tested there."""
    from tidemark.catalog import load

    assert sorted(names()) == sorted(load()[0])
    assert set(names()) <= set(entry.queries())
