import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from nearkin.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def test_entry_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["seq", "n_earlier", "first_earlier", "nearest"] and got.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(got) == rows(con.sql(ORACLE[name]).df())
