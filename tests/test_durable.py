import glob
import os
import tempfile
import time

from pyspark.sql import functions as F

from auditlake.llm.shared import components, staged
from auditlake.operators.durable import REMOVE_SHUFFLES, durable


def shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    return set(glob.glob(f"{top}/**/blockmgr-*/*/shuffle_*", recursive=True))


def left_over(spark, before):
    """Shuffle files that came since; they are removed in the background."""
    for _ in range(40):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return new


def test_written_tables_leave_no_shuffle_files(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    sums = rows.repartition(5, "id").groupBy("k").agg(F.sum("id").alias("n"))
    before = shuffle_files(spark)
    want = sorted(sums.collect())
    assert shuffle_files(spark) - before  # kept for a plan that may be run again
    before = shuffle_files(spark)
    for write in (durable, lambda df: staged(df, "sums")):
        assert sorted(write(sums).collect()) == want
        assert not left_over(spark, before)
        assert sorted(sums.collect()) == want
    assert spark.conf.get(REMOVE_SHUFFLES, "false") == "false"


def test_components_leave_no_shuffle_files(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 20 <> 19")
    before = shuffle_files(spark)
    found = components(edges)
    assert not left_over(spark, before)
    assert found.groupBy("component").count().orderBy("component").collect() == [(0, 20), (20, 20), (40, 20)]
