"""Report rows: blocks are shuffled once, and documents of many blocks give the same rows."""

from pyspark.sql import functions as F

from priorline.functions import reports
from priorline.skew import HOT_ROWS_SETTING

BODIES = [
    "01/02/2024\n07:30 (ET)\nABC@XYZ\nNew Yorkers\nDoe, John\nOut\nInjury/Illness", "Roe, Jane\nOut\nRest", "Foe, Jim\nProbable", "Foe, Jim\nProbable",
    "South Town\nNOT YET SUBMITTED", "Injury - left\nknee", "Philadelphia 76ers\nPoe, Max\nDoubtful\nIllness", "Game Date\nGame Time",
]


def test_one_shuffle_and_the_same_for_large_documents(spark):
    at = (F.xxhash64("id") % len(BODIES) + len(BODIES)) % len(BODIES)
    body = F.element_at(F.array(*map(F.lit, BODIES)), (at + 1).cast("int"))
    blocks = spark.range(900).select((F.col("id") % 4).alias("doc"), F.col("id").alias("line"), body.alias("body"))
    blocks = blocks.withColumn("doc", F.when(F.col("line") < 400, 0).otherwise(F.col("doc")))
    plain = reports.report_rows(blocks, "doc", "line", "body")
    text = spark._jvm.PythonSQLUtils.explainString(plain._jdf.queryExecution(), "simple").split("Initial Plan")[0]
    assert text.count("Exchange ") == 1
    want = sorted(map(str, plain.collect()))
    spark.conf.set(HOT_ROWS_SETTING, "150")
    try:
        got = sorted(map(str, reports.report_rows(blocks, "doc", "line", "body").collect()))
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
    assert got == want and len(want) > 500
