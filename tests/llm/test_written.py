"""Tables written between the steps of an operator."""

import time

from pyspark.sql import functions as F

from tidemark.llm.common import SHUFFLE_CLEANUP, written


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.length())} if found.length() else set()


def test_written_tables_leave_no_shuffle_files(spark):
    before = {x for x in shuffle_files(spark) if x.startswith("shuffle_")}
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("key")).count(), "counts")
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == was
    # they are removed in the background
    for _ in range(50):
        left = {x for x in shuffle_files(spark) if x.startswith("shuffle_")} - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and table.agg(F.sum("count")).first()[0] == 1000
