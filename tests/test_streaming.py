import random

from nearkin.operators.fold import greedy_dedup
from nearkin.plans.index import HashIndex
from nearkin.schemas import STRING
from nearkin.streaming.arrivals import greedy_dedup_stream, search_then_store


def test_streamed_fold_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"v{i % 3}", i, i, 0, rng.getrandbits(16)) for i in range(120)]
    schema = "video string, ts long, id long, hi long, lo long"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = greedy_dedup_stream(stream, 6).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {r["id"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {r["id"] for r in greedy_dedup(spark.createDataFrame(rows, schema), "video", ["ts", "id"], 6).collect()}


def test_arrivals_are_searched_then_stored(spark, tmp_path):
    schema = "seq long, hi long, lo long, src string, store boolean"
    HashIndex.create(spark, f"{tmp_path}/i", STRING).add(spark.createDataFrame([(0, 0, "old")], "hi long, lo long, src string"))
    for rows in ([(1, 0, 1, "a", True), (2, 0, 1, "b", True)], [(3, 0, 0, "c", True), (4, -1, 0, "d", False), (5, -1, 0, "e", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        search_then_store(stream, f"{tmp_path}/i", f"{tmp_path}/r", f"{tmp_path}/c", within=1, ident=STRING).awaitTermination(120)
    found = {(r["src"], r["other"], r["distance"]) for r in spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/r").collect()}
    assert found == {("a", "old", 1), ("b", "old", 1), ("b", "a", 0), ("c", "old", 0), ("c", "a", 1), ("c", "b", 1)}
    assert HashIndex.open(spark, f"{tmp_path}/i", STRING).scan().count() == 5
