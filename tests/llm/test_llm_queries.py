"""The registered queries: all fourteen are there, and those with SQL equal it on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    found = [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    assert sorted(q.split("_")[0] for q in found) == sorted([f"op{n}" for n in range(1, 14)] + ["pipeline"])


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_chat", "op9_near_dedup", "op11_mixing", "op12_prefix_trie", "op13_ranked_search"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(rel.fetchall(), columns=[d[0] for d in rel.description], dtype=object)
    assert canon(entry.queries()[name](spark, SF).toPandas().astype(object)) == canon(want)
