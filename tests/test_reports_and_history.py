"""Team tokens of reports, participants without history, counts of differing cells."""

import pytest
from pyspark.sql import functions as F

from priorline.functions.text import token_kind
from priorline.operators import pivots, quality


def test_team_tokens_with_and_without_digits(spark):
    tokens = ["Boston Celtics", "Philadelphia 76ers", "Philadelphia 76", "Boston", "BOS@PHI", "James, LeBron", "NOT YET SUBMITTED", "", None]
    rows = spark.createDataFrame(list(enumerate(tokens)), "i int, t string")
    found = {r.t: (r.a, r.b) for r in rows.select("t", token_kind(F.col("t"), F.lit(False)).alias("a"), token_kind(F.col("t"), F.lit(True)).alias("b")).collect()}
    assert found == {
        "Boston Celtics": ("team", None),
        "Philadelphia 76ers": ("team", None),
        "Philadelphia 76": (None, None),
        "Boston": ("status", "status"),
        "BOS@PHI": ("matchup", None),
        "James, LeBron": ("player", None),
        "NOT YET SUBMITTED": ("reason", "reason"),
        "": (None, None),
        None: (None, None),
    }


def test_participants_without_history_are_an_error(spark):
    history = spark.createDataFrame([(1,), (1,), (2,)], "team int")
    pivots.require_history(spark.createDataFrame([(1,), (2,), (1,)], "team int"), history, "team")
    with pytest.raises(ValueError, match="no history for"):
        pivots.require_history(spark.createDataFrame([(1,), (3,)], "team int"), history, "team")
    with pytest.raises(ValueError, match=r"\[2\]"):
        pivots.require_history(spark.createDataFrame([(1,), (2,)], "team int"), history, "team", least=2)


def test_differing_cells_are_counted_per_column(spark):
    cells = spark.createDataFrame([("a",), ("b",), ("a",)], "column_name string")
    assert {tuple(r) for r in quality.difference_summary(cells).collect()} == {("a", 2), ("b", 1)}
