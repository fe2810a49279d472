"""Intermediate tables that outlive lost executors, and joins in which hot keys are dealt to several tasks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys at most that count as hot, so that a table of them is small whatever the input.
HOT_KEYS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master, whose driver and executors are one
    process, gets a folder of its own where none is set; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="nearkin-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once and written to the cluster's shared folder; what follows reads it from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def hot_keys(rows: DataFrame, keys: list[str], share: int) -> DataFrame:
    """(keys, _shares): the keys with more than `share` rows, or more than a 100,000th of all, and into how many shares their
    rows are to be dealt. At most HOT_KEYS rows of that size, so it may be broadcast."""
    limit = max(share, -(-rows.count() // HOT_KEYS))
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / limit).cast("int").alias("_shares")).where("_shares > 1")


def dealt_join(many: DataFrame, few: DataFrame, keys: list[str], share: int = 20_000, how: str = "inner", where=None, hot: DataFrame | None = None) -> DataFrame:
    """An equi-join, with an optional further condition, in which the rows of `many` with a hot key are dealt to several tasks,
    each with all of the key's rows in `few`. `many` is read twice, so it should be settled or cheap, or `hot` has its
    `hot_keys`; rows are dealt by a hash of all their columns, so a repeated task deals them alike. how: inner or left."""
    hot = F.broadcast(hot_keys(many, keys, share) if hot is None else hot)
    shares = F.coalesce("_shares", F.lit(1))
    left = many.withColumn("_deal", F.xxhash64(*many.columns)).join(hot, keys, "left").withColumn("_share", F.pmod("_deal", shares).cast("int")).drop("_deal", "_shares")
    right = few.join(hot, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    joined = left.join(right, [*keys, "_share"], how).drop("_share")
    return joined if where is None else joined.where(where)


def hot_of(counted: DataFrame, keys: list[str], n: str, share: int = 20_000) -> DataFrame:
    """`hot_keys` out of a settled table that has each key's number of rows already."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    limit = max(share, -(-total // HOT_KEYS))
    return counted.select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_shares")).where("_shares > 1")
