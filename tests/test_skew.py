"""The hot-key plan must return exactly what the plain window plan returns."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from priorline import skew


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{i % 40}"
        rows.append((key, i % 50, i, float(random.randint(-50, 50)) if i % 7 else None))
    return spark.createDataFrame(rows, "k string, t int, id int, x double").cache()


def same(a, b):
    left = sorted(map(tuple, a.collect()), key=str)
    right = sorted(map(tuple, b.collect()), key=str)
    assert left == right


def test_positions(skewed, hot):
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = skewed.withColumn("p", (F.row_number().over(w) - 1).cast("long"))
    same(skew.with_position(skewed, ["k"], ["t", "id"], "p"), plain)


@pytest.mark.parametrize("lookback", [1, 5, 30])
def test_bounded(skewed, hot, lookback):
    w = Window.partitionBy("k").orderBy("t", "id")

    def project(win):
        frame = win.rowsBetween(-lookback, -1)
        return [F.sum("x").over(frame).alias("s"), F.count("x").over(frame).alias("n"), F.lag("id").over(win).alias("l")]

    same(skew.bounded_frames(skewed, ["k"], ["t", "id"], lookback, project), skewed.select("*", *project(w)))


@pytest.mark.parametrize("current", [False, True])
def test_running(skewed, hot, current):
    kinds = ["sum", "count", "min", "max", "first", "last"]
    totals = [skew.Total(k, F.col("x"), k) for k in kinds]
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    plain = skewed.select("*", *[t.fold().over(w).alias(t.name) for t in totals])
    same(skew.running_totals(skewed, ["k"], ["t", "id"], totals, current), plain)


def test_best_rows_salted(skewed, monkeypatch):
    monkeypatch.setattr(skew, "GROUP_LIMIT", 3)
    w = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    plain = skewed.withColumn("r", F.row_number().over(w)).filter("r <= 5")
    same(skew.best_rows(skewed, ["k"], [F.desc("t"), F.desc("id")], 5, "r"), plain)


def test_small_k_is_trimmed_before_the_shuffle(skewed):
    plan = skew.best_rows(skewed, ["k"], [F.desc("t"), F.desc("id")], 3)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert "WindowGroupLimit" in text
