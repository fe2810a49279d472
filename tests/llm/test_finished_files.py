import time

from samples import make

from nearkin.llm.components import components
from nearkin.llm.near_dedup import near_duplicates
from nearkin.llm.textcore import free_finished


def shuffles(spark):
    """Shuffles whose files Spark keeps."""
    return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def least(spark, most, seconds=10):
    """The number of shuffles, when it has come down to `most` or not for a while: Spark's cleaner is a thread of its own."""
    until = time.time() + seconds
    while (n := shuffles(spark)) > most and time.time() < until:
        time.sleep(0.1)
    return n


def test_rounds_keep_no_files_of_earlier_rounds(spark):
    free_finished(spark)
    before = least(spark, 0, 2)
    got = components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"))
    assert least(spark, before + 3) <= before + 3  # the last count's
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 201)}


def test_near_duplicates_keep_no_files_of_finished_steps(spark, corpus):
    free_finished(spark)
    before = least(spark, 0, 2)
    got = near_duplicates(make(spark, corpus))
    assert least(spark, before + 3) <= before + 3
    assert got.count() == len(corpus)
