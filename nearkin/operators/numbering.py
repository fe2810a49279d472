"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearkin.operators.dealing import settled


def numbered(rows: DataFrame, *order: str, name: str = "no") -> DataFrame:
    """Rows with their number from 0 in an order. Spark deals ranges of the order to partitions, which are settled; only each
    partition's number of rows is summed up, and rows are numbered where they are."""
    ordered = settled(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    # one row for each partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before", "_first")
    return ordered.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_mono") - F.col("_first")).drop("_part", "_mono", "_before", "_first")
