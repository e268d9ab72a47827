"""Features at a row must not move when that row's own or any later value changes."""

import pytest
from pyspark.sql import functions as F

from priorline.operators import asof, effects, league, players
from priorline.operators import windows as W
from priorline.plans.standins import standin

SF = "/root/testdata/sf0.001"
KEYS = W.SeriesKeys("team_id", "season", "home", ("game_date", "game_id"))
CUT = "1998-01-01"


@pytest.fixture(scope="module")
def teams(spark):
    return standin(spark, SF, "team_games").withColumn("pts", F.col("pts").cast("double")).cache()


def changed(df, value):
    return df.withColumn(value, F.when(F.col("game_date") >= CUT, F.col(value) * 7 + 1000).otherwise(F.col(value)))


def frozen(df, names):
    """Feature values of rows up to the first changed date (their inputs lie strictly before it)."""
    kept = df.filter(F.col("game_date") <= CUT).select("game_id", *names)
    return sorted(map(str, kept.select(*[F.round(c, 9) if t == "double" else F.col(c) for c, t in kept.dtypes]).collect()))


BUILDERS = {
    "form": lambda df: W.form_columns(df, KEYS, ["pts"], std=["pts"]),
    "split": lambda df: W.split_relative_mean(df, KEYS, "pts", 5),
    "rolling_games": lambda df: league.attach(
        df, league.rolling_games(df, "game_date", "game_id", [league.Rolled("m", "pts", 30, "mean"), league.Rolled("d", "pts", 30, "median")]), ["game_date"]
    ),
    "rolling_days": lambda df: league.attach(df, league.rolling_days(df, "game_date", [league.Rolled("s", "pts", 14, "std")]), ["game_date"]),
    "ewm": lambda df: league.attach(df, league.ewm_before(df, "game_date", "game_id", [league.Decayed("pts", "mean", "e{span}")]), ["game_date"]),
    "history": lambda df: league.attach(df, asof.history_means(df, df, "team_id", "season", "game_date", ["pts"]), ["team_id", "season", "game_date"]),
}


@pytest.mark.parametrize("name", list(BUILDERS))
def test_no_leak(teams, name):
    build = BUILDERS[name]
    plain, moved = build(teams), build(changed(teams, "pts"))
    names = [c for c in plain.columns if c not in teams.columns]
    assert names and frozen(plain, names) == frozen(moved, names)


def test_recency_mean_does_not_leak(spark):
    rows = standin(spark, SF, "appearances")
    build = lambda df: players.recency_mean(df, ["season", "player_id"], ("game_date", "game_id"), "pts", "minutes")
    names = ["player_id", "pts_cum_avg"]
    assert frozen(build(rows), names) == frozen(build(changed(rows, "pts")), names)


def test_effects_do_not_leak(spark, teams):
    games = standin(spark, SF, "games").selectExpr("game_id", "season", "game_date", "home_pts + away_pts AS points")
    members = standin(spark, SF, "officials").select("game_id", F.col("official_id").alias("ref"))

    def build(df):
        out = effects.participant_effects(df, members, game="game_id", season="season", date="game_date", member="ref", metrics=["points"])
        return out.join(games.select("game_id", "game_date"), "game_id")

    names = ["ref_avg_points_diff_before", "ref_sum_points_diff_before"]
    assert frozen(build(games), names) == frozen(build(changed(games, "points")), names)


def test_row_order_does_not_matter(teams):
    build = BUILDERS["form"]
    names = [c for c in build(teams).columns if c.startswith("pts_")]
    shuffled = teams.orderBy(F.xxhash64("game_id", "team_id"))
    assert frozen(build(teams), names) == frozen(build(shuffled), names)
