"""Queries on few rows with keys as large as in large tables, against their SQL."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from nearkin.functions import measures
from pyspark.sql import functions as F


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives what its SQL gives on small tables."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, columns in tables.items():
            pd.DataFrame(columns).convert_dtypes().to_parquet(f"{tmp_path}/{t}.parquet", index=False)
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
        return got

    return run


def test_whole_interpolation_is_cut_off_not_rounded(spark, same):
    long = lambda v: F.lit(v).cast("long")
    at = lambda *v: spark.range(1).select(measures.lerp_whole(*map(long, v))).first()[0]
    big = 10**15
    assert (at(0, big, 0, 5, big - 1), at(0, big, 5, 0, big - 1), at(0, big, 0, 5, big)) == (4, 1, 5)
    assert at(-(2**62), 2**62 - 1, 0, 2**62, 2**62 - 2) == (2**63 - 2) * 2**62 // (2**63 - 1)
    same("percent_lerp", orders={"o_orderkey": [6995931, 10**10, 4 * 10**9 + 1, 1], "o_custkey": [690187, 10**10, 10**9, 0]})


@pytest.mark.parametrize("most", [999_999, 1_000_000, 5_999_999])
def test_next_entry_is_behind_numbers_of_seven_digits(same, most):
    assert same("next_entry", events={"event_id": [most, None, 123_456]}).first()["next"] == most + 1


FAR = {"event_id": [0, 1, 63, 45_523, 45_524, 99_999, 500_000, 5_999_999], "user_id": [0, 1, 100, 12, 123, 1_234, 5, 89_999]}


def test_clocks_of_100_hours_and_more_are_as_in_the_sql(same):
    same("hms_format", events=FAR)


def test_frame_texts_of_100_hours_and_more_are_as_in_the_sql(same):
    same("frame_texts", events=FAR)
