"""Means and modes per group: rows are shuffled once, and hot groups give the same."""

from pyspark.sql import functions as F

from priorline.operators.pivots import common_values
from priorline.skew import HOT_ROWS_SETTING


def test_one_shuffle_and_the_same_with_hot_groups(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("at"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 11).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), (F.col("id") % 5).alias("z"),
    ).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 1L AS at, 2D AS x, 3D AS y, 4L AS z"))
    plain = common_values(rows.drop("z"), ["k"], ["x", "y"], "at")
    text = spark._jvm.PythonSQLUtils.explainString(plain._jdf.queryExecution(), "simple").split("Initial Plan")[0]
    assert text.count("Exchange ") == 1
    want = sorted(map(str, common_values(rows, ["k"], ["x", "y", "z"], "at").collect()))
    spark.conf.set(HOT_ROWS_SETTING, "200")
    try:
        got = sorted(map(str, common_values(rows, ["k"], ["x", "y", "z"], "at").collect()))
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
    assert got == want and len(want) == rows.select("k").distinct().count()
