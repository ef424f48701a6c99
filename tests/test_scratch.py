"""Tables in the shared folder."""

import time

import pytest
from pyspark.sql import functions as F

from rillflow import scratch


def test_saved_tables_are_read_again_and_cleared(spark):
    scratch.clear(spark)
    df = scratch.saved(spark.range(5), "numbers")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    assert scratch.clear(spark) == 1
    with pytest.raises(Exception):  # noqa: B017
        df.collect()
    assert scratch.clear(spark) == 0



def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")


def test_parts_are_one_table_and_leave_no_shuffles(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counts = [spark.range(1000).where(F.col("id") % 3 == k).groupBy((F.col("id") % 50).alias("k")).agg(F.count("id").alias("n")) for k in range(3)]
    held = scratch.saved(counts[0], "counts")
    assert shuffle_files(spark) > before and held.count() == 50
    before = shuffle_files(spark)
    df = scratch.saved_parts(iter(counts), "counts")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert df.agg(F.sum("n"), F.count("k")).first()[:] == (1000, 150)
    until = time.time() + 10
    while shuffle_files(spark) > before + 2 and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before + 2


def test_a_dropped_table_is_gone_and_others_stay(spark):
    scratch.clear(spark)
    one, other, given = scratch.saved(spark.range(5), "numbers"), scratch.saved_parts([spark.range(3), spark.range(4)], "numbers"), spark.range(2)
    scratch.drop(one, given)
    scratch.drop(one)
    assert other.count() == 7 and given.count() == 2
    with pytest.raises(Exception):  # noqa: B017
        one.collect()
    assert scratch.clear(spark) == 1
