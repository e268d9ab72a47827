"""Operators give the same rows when their keys are treated as hot."""

import pytest

import oracle
from priorline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "w1_prior_mean", "w2_split_relative", "w4_season_mean", "w5_season_std", "w6_wma", "w7_trend_slope", "w9_records",
    "w10_rest_days", "w13_last_meetings", "w15_recency_mean", "w17_bench_profile", "w18_absence_streak", "w27_fixed_weights",
    "w28_fill_forward", "w23_trip_km", "c7_referee_effect", "k6_confidence_quantiles", "e6_chronological", "e7_training_window",
]


@pytest.mark.parametrize("name", NAMES)
def test_hot(spark, hot, name):
    con = oracle.connect(SF)
    verdict = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert verdict.startswith("OK"), verdict
