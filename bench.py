"""Time the headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "w1_prior_mean", "w4_season_mean", "w6_wma", "w7_trend_slope", "w8_form_columns", "w9_records", "w13_last_meetings", "w15_recency_mean",
    "w18_absence_streak", "w19_league_games", "w20_league_days", "w21_league_ewm_mean", "w24_trailing_km", "j1_pair_sides", "j3_attach_lines",
    "j8_dated_odds", "j12_asof_roster", "a4_line_summary", "a5_totals_pivot", "k1_top_players", "k2_lineup_summary", "r4_odds_block",
    "c1_market_regime", "c7_referee_effect", "c9_availability_effect", "c11_slot_effects", "c12_travel_block", "e9_accuracy_by_threshold",
    "e14_betting_outcome", "e15_betting_summary", "e19_game_level", "e20_consensus", "s15_insert_if_absent",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from priorline.plans.catalog import QUERIES
    from priorline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=int(cores), memory="16g")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, plan and full result",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
