"""W: entity windows over the event series."""

from pyspark.sql import functions as F

from priorline.operators import windows as W
from priorline.plans.registry import query
from priorline.plans.standins import rounded, standin

KEYS = W.SeriesKeys("entity", "season", "home", ("ts", "event_id"))


def _series(spark, sf_dir):
    return standin(spark, sf_dir, "series").drop("minutes", "event_type", "wl")


_OVER = "OVER (PARTITION BY {p} ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _prior(n, partition="entity"):
    return _OVER.format(p=partition, n=n)


@query(
    "w1_prior_mean",
    f"""SELECT event_id, round(avg(pts) {_prior(5)}, 6) AS pts_last_all_5_before,
        round(avg(pts) {_prior(10)}, 6) AS pts_last_all_10_before FROM series""",
    "series",
)
def w1(spark, sf_dir):
    out = W.prior_means(_series(spark, sf_dir), KEYS, ["pts"], [5, 10])
    return rounded(out.select("event_id", "pts_last_all_5_before", "pts_last_all_10_before"))


@query(
    "w2_split_relative",
    f"""SELECT event_id, round(avg(pts) {_prior(5, 'entity, home')} - avg(pts) {_prior(5)}, 6) AS pts_last_split_5_before
        FROM series""",
    "series",
)
def w2(spark, sf_dir):
    out = W.split_relative_mean(_series(spark, sf_dir), KEYS, "pts", 5)
    return rounded(out.select("event_id", "pts_last_split_5_before"))


@query(
    "w3_window_delta",
    f"""SELECT event_id, round(avg(pts) {_prior(10)} - avg(pts) {_prior(5)}, 6) AS pts_last_10_minus_last_5_before
        FROM series""",
    "series",
)
def w3(spark, sf_dir):
    out = W.window_delta(_series(spark, sf_dir), KEYS, "pts", 10, 5)
    return rounded(out.select("event_id", "pts_last_10_minus_last_5_before"))


_SEASON = "entity, season, home"


@query(
    "w4_season_mean",
    f"""WITH prev AS (SELECT entity, season + 1 AS season, home, avg(pts) AS m FROM series GROUP BY 1, 2, 3)
        SELECT event_id, round(coalesce(avg(pts) OVER (PARTITION BY s.entity, s.season, s.home ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m, avg(pts) {_prior(5, 's.entity')}), 6) AS pts_season_before_avg
        FROM series s LEFT JOIN prev p ON p.entity = s.entity AND p.season = s.season AND p.home = s.home""",
    "series",
)
def w4(spark, sf_dir):
    out = W.season_mean(_series(spark, sf_dir), KEYS, "pts")
    return rounded(out.select("event_id", "pts_season_before_avg"))


@query(
    "w5_season_std",
    """WITH prev AS (SELECT entity, season + 1 AS season, home, stddev_samp(pts) AS m FROM series GROUP BY 1, 2, 3)
        SELECT event_id, round(coalesce(stddev_pop(pts) OVER (PARTITION BY s.entity, s.season, s.home ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m), 3) AS pts_season_before_std
        FROM series s LEFT JOIN prev p ON p.entity = s.entity AND p.season = s.season AND p.home = s.home""",
    "series",
)
def w5(spark, sf_dir):
    out = W.season_std(_series(spark, sf_dir), KEYS, "pts")
    return rounded(out.select("event_id", "pts_season_before_std"), 3)


def _wma_sql(partition, n, name="w"):
    """Direct statement of the rule: place weights over the shifted window held as a list."""
    return f"""{name} AS (SELECT event_id, CASE WHEN len(list_filter(xs, lambda x: x IS NOT NULL)) > 0 THEN
          list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * (i + lead_gap))) /
          list_sum(list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN xs[i] IS NOT NULL THEN i + lead_gap END)) END AS v
        FROM (SELECT event_id, list(pts) {_prior(n, partition)} AS xs,
              CASE WHEN row_number() OVER (PARTITION BY {partition} ORDER BY ts, event_id) <= {n} THEN 1 ELSE 0 END AS lead_gap
              FROM series))"""


@query(
    "w6_wma",
    f"WITH {_wma_sql('entity', 5)} SELECT event_id, round(v, 6) AS pts_wma_5_before FROM w",
    "series",
)
def w6(spark, sf_dir):
    return rounded(W.weighted_means(_series(spark, sf_dir), KEYS, ["pts"], 5).select("event_id", "pts_wma_5_before"))


@query(
    "w6_wma_split",
    f"""WITH {_wma_sql('entity', 5, 'a')}, {_wma_sql('entity, home', 5, 'b')}
        SELECT event_id, round(b.v - a.v, 6) AS pts_wma_split_5_before FROM a JOIN b USING (event_id)""",
    "series",
)
def w6_split(spark, sf_dir):
    out = W.split_relative_weighted(_series(spark, sf_dir), KEYS, "pts", 5)
    return rounded(out.select("event_id", "pts_wma_split_5_before"))


@query(
    "w6_wma_delta",
    f"""WITH {_wma_sql('entity', 10, 'a')}, {_wma_sql('entity', 5, 'b')}
        SELECT event_id, round(a.v - b.v, 6) AS pts_wma_10_minus_wma_5_before FROM a JOIN b USING (event_id)""",
    "series",
)
def w6_delta(spark, sf_dir):
    out = W.weighted_delta(_series(spark, sf_dir), KEYS, "pts", 10, 5)
    return rounded(out.select("event_id", "pts_wma_10_minus_wma_5_before"))


@query(
    "w7_trend_slope",
    f"""WITH x AS (SELECT *, count(pts) OVER (PARTITION BY entity, season ORDER BY ts, event_id) AS k FROM series)
        SELECT event_id, round(CASE WHEN count(pts) {_prior(5, 'entity, season')} >= 2 THEN
          regr_slope(pts, k) {_prior(5, 'entity, season')} END, 4) AS pts_trend_slope_last_5_before FROM x""",
    "series",
)
def w7(spark, sf_dir):
    out = W.trend_slopes(_series(spark, sf_dir), KEYS, ["pts"], 5)
    return rounded(out.select("event_id", "pts_trend_slope_last_5_before"), 4)


def _slope_sql(v, k, n, partition="entity, season"):
    over = _prior(n, partition)
    return f"CASE WHEN count({v}) {over} >= 2 THEN regr_slope({v}, {k}) {over} END"


_COUNTED = """x AS (SELECT *, count(pts) OVER (PARTITION BY entity, season ORDER BY ts, event_id) AS k,
          count(pts) OVER (PARTITION BY entity, season, home ORDER BY ts, event_id) AS ks,
          count(minutes) OVER (PARTITION BY entity, season ORDER BY ts, event_id) AS km,
          count(minutes) OVER (PARTITION BY entity, season, home ORDER BY ts, event_id) AS kms FROM series)"""


@query(
    "w7_split",
    f"""WITH {_COUNTED} SELECT event_id, round({_slope_sql('pts', 'ks', 5, 'entity, season, home')} - {_slope_sql('pts', 'k', 5)}, 4) AS pts_trend_slope_split_5_before FROM x""",
    "series",
)
def w7_split(spark, sf_dir):
    out = W.split_relative_slopes(_series(spark, sf_dir), KEYS, ["pts"], 5)
    return rounded(out.select("event_id", "pts_trend_slope_split_5_before"), 4)


@query(
    "w7_delta",
    f"""WITH {_COUNTED} SELECT event_id, round({_slope_sql('pts', 'k', 5)} - {_slope_sql('pts', 'k', 10)}, 4) AS pts_trend_slope_last_5_minus_last_10_before FROM x""",
    "series",
)
def w7_delta(spark, sf_dir):
    out = W.slope_deltas(_series(spark, sf_dir), KEYS, ["pts"], 5, 10)
    return rounded(out.select("event_id", "pts_trend_slope_last_5_minus_last_10_before"), 4)


_TEAM_OVER = "OVER (PARTITION BY {p} ORDER BY game_date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
ORDER = ("game_date", "game_id")


@query(
    "w9_records",
    f"""SELECT game_id, team_id, n AS game_number, w AS wins_before, round(CASE WHEN w + l > 0 THEN w / (w + l) ELSE 0.0 END, 6) AS record_before
        FROM (SELECT game_id, team_id, row_number() OVER (PARTITION BY season_kind, season, team_id ORDER BY game_date, game_id) AS n,
          coalesce(CAST(sum(CASE WHEN wl = 'W' THEN 1 ELSE 0 END) {_TEAM_OVER.format(p='season_kind, season, team_id', n='UNBOUNDED')} AS BIGINT), 0) AS w,
          coalesce(CAST(sum(CASE WHEN wl = 'L' THEN 1 ELSE 0 END) {_TEAM_OVER.format(p='season_kind, season, team_id', n='UNBOUNDED')} AS BIGINT), 0) AS l
          FROM team_games)""",
    "team_games",
)
def w9(spark, sf_dir):
    out = W.records(standin(spark, sf_dir, "team_games"), ["season_kind", "season", "team_id"], ORDER, "wl")
    return rounded(out.select("game_id", "team_id", "game_number", "wins_before", "record_before"))


@query(
    "w10_rest_days",
    """SELECT game_id, team_id, CAST(coalesce(date_diff('day', lag(game_date) OVER
        (PARTITION BY team_id, season ORDER BY game_date, game_id), game_date), 0) AS INTEGER) AS rest_days_before FROM team_games""",
    "team_games",
)
def w10(spark, sf_dir):
    out = W.rest_days(standin(spark, sf_dir, "team_games"), ["team_id", "season"], ORDER, "game_date")
    return out.select("game_id", "team_id", "rest_days_before")


def _conceded(spark, sf_dir):
    games = standin(spark, sf_dir, "games").select(
        "game_id", "game_date", "season", "home_team", "away_team", "home_pts", "away_pts", "total_line"
    )
    out = W.season_running_mean(games, ["home_team", "season"], ORDER, "away_pts", "home_conceded_before")
    return W.season_running_mean(out, ["away_team", "season"], ORDER, "home_pts", "away_conceded_before")


_CONCEDED_SQL = """SELECT *, avg(away_pts) OVER (PARTITION BY home_team, season ORDER BY game_date, game_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS home_conceded_before,
        avg(home_pts) OVER (PARTITION BY away_team, season ORDER BY game_date, game_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS away_conceded_before FROM games"""


@query(
    "w11_conceded",
    f"""SELECT game_id, round(home_conceded_before, 6) AS home_conceded_before,
        round(away_conceded_before, 6) AS away_conceded_before FROM ({_CONCEDED_SQL})""",
    "games",
)
def w11(spark, sf_dir):
    return rounded(_conceded(spark, sf_dir).select("game_id", "home_conceded_before", "away_conceded_before"))


@query(
    "w12_expected_gap",
    f"""SELECT game_id, round(coalesce(avg(total_line / 2 - home_conceded_before) OVER (PARTITION BY home_team, season
          ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS gap_mean_before
        FROM ({_CONCEDED_SQL})""",
    "games",
)
def w12(spark, sf_dir):
    base = _conceded(spark, sf_dir).withColumn("expected", F.col("total_line") / 2)
    out = W.expected_minus_conceded(base, ["home_team", "season"], ORDER, "expected", "home_conceded_before")
    return rounded(out.select("game_id", "gap_mean_before"), 4)


_LAGS = ", ".join(
    f"lag(home_pts + away_pts, {i}) OVER (PARTITION BY home_team, away_team ORDER BY game_date, game_id) AS total_meeting_{i}_before"
    for i in range(1, 6)
)


@query(
    "w13_last_meetings",
    f"""SELECT game_id, {_LAGS}, round(avg(home_pts + away_pts) OVER (PARTITION BY home_team, away_team
        ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS total_meetings_mean_before FROM games""",
    "games",
)
def w13(spark, sf_dir):
    games = standin(spark, sf_dir, "games").withColumn("total", F.col("home_pts") + F.col("away_pts"))
    out = W.last_meetings(games, ["home_team", "away_team"], ORDER, "total")
    names = [f"total_meeting_{i}_before" for i in range(1, 6)]
    return rounded(out.select("game_id", *names, "total_meetings_mean_before"))


@query(
    "w14_pregame_form",
    f"""WITH t AS (SELECT game_id, home, avg(pts) {_TEAM_OVER.format(p='team_id', n=5)} AS any5,
          avg(pts) {_TEAM_OVER.format(p='team_id, home', n=5)} AS side5 FROM team_games)
        SELECT h.game_id, round(h.any5, 6) AS home_any_5, round(h.side5, 6) AS home_home_5, round(a.any5, 6) AS away_any_5,
          round(a.side5, 6) AS away_away_5 FROM t h JOIN t a ON h.game_id = a.game_id AND h.home AND NOT a.home""",
    "team_games",
)
def w14(spark, sf_dir):
    from priorline.operators.games import pregame_form

    keys = W.SeriesKeys("team_id", "season", "home", ORDER)
    return rounded(pregame_form(standin(spark, sf_dir, "team_games"), keys, "game_id", "pts", 5))


@query(
    "w26_smoothing",
    """WITH d AS (SELECT model, predicted_on, avg(predicted_total) AS level FROM predictions GROUP BY 1, 2)
        SELECT model, predicted_on, round(avg(level) OVER (PARTITION BY model ORDER BY predicted_on
          ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS level_smooth_7 FROM d""",
    "predictions",
)
def w26(spark, sf_dir):
    daily = standin(spark, sf_dir, "predictions").groupBy("model", "predicted_on").agg(F.avg("predicted_total").alias("level"))
    out = W.smooth(daily, ["model"], ["predicted_on"], "level", 7)
    return rounded(out.select("model", "predicted_on", "level_smooth_7"), 4)


_FIXED = (20, 15, 10, 8, 6, 5, 4, 3, 2, 1)  # fixed values: older moving-average weights


def _fixed_sql(pick):
    return f"""SELECT event_id, round(CASE WHEN len(list_filter(xs, lambda x: x IS NOT NULL)) > 0 THEN
          list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * wt[{pick}])) /
          list_sum(list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN xs[i] IS NOT NULL THEN wt[{pick}] END)) END, 6)
          AS pts_fixed_weight_10_before
        FROM (SELECT event_id, list(pts) {_prior(10)} AS xs, [20, 15, 10, 8, 6, 5, 4, 3, 2, 1] AS wt FROM series)"""


@query("w27_fixed_weights", _fixed_sql("i"), "series")
def w27(spark, sf_dir):
    out = W.fixed_weight_mean(_series(spark, sf_dir), ["entity"], KEYS.order, "pts", _FIXED)
    return rounded(out.select("event_id", "pts_fixed_weight_10_before"))


@query("w27_fixed_weights_newest", _fixed_sql("len(xs) + 1 - i"), "series")
def w27_newest(spark, sf_dir):
    out = W.fixed_weight_mean(_series(spark, sf_dir), ["entity"], KEYS.order, "pts", _FIXED, oldest_first=False)
    return rounded(out.select("event_id", "pts_fixed_weight_10_before"))


@query(
    "w29_season_bounded",
    f"SELECT event_id, round(avg(pts) {_prior(5, 'entity, season')}, 6) AS pts_last_all_5_before FROM series",
    "series",
)
def w29(spark, sf_dir):
    out = W.prior_means(_series(spark, sf_dir), KEYS, ["pts"], [5], by_season=True)
    return rounded(out.select("event_id", "pts_last_all_5_before"))


_FORM_MEANS = ", ".join(
    f"round(avg({v}) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS {v}_last_all_{n}_before"
    for v in ("pts", "minutes")
    for n in (1, 2, 3, 5, 10)
)


def _family_sql(v, k, ks):
    """The relative and difference families and the season mean of one value."""
    short, long, split = _slope_sql(v, k, 5), _slope_sql(v, k, 10), _slope_sql(v, ks, 5, "entity, season, home")
    return f"""round(avg({v}) {_prior(5, 'entity, home')} - avg({v}) {_prior(5)}, 6) AS {v}_last_split_5_before,
          round(avg({v}) {_prior(5)} - avg({v}) {_prior(10)}, 6) AS {v}_last_5_minus_last_10_before,
          round({short}, 4) AS {v}_trend_slope_last_5_before, round({long}, 4) AS {v}_trend_slope_last_10_before,
          round({short} - {long}, 4) AS {v}_trend_slope_last_5_minus_last_10_before, round({split} - {short}, 4) AS {v}_trend_slope_split_5_before,
          round(coalesce(avg({v}) {_prior('UNBOUNDED', _SEASON)}, prev_{v}, avg({v}) {_prior(5)}), 6) AS {v}_season_before_avg"""


@query(
    "w8_form_columns",
    f"""WITH {_wma_sql('entity', 5, 'w')}, {_wma_sql('entity', 5, 'wm').replace('list(pts)', 'list(minutes)')}, {_COUNTED},
        prev AS (SELECT entity, season + 1 AS season, home, avg(pts) AS prev_pts, avg(minutes) AS prev_minutes FROM series GROUP BY 1, 2, 3)
        SELECT event_id, {_FORM_MEANS}, round(w.v, 6) AS pts_wma_5_before, round(wm.v, 6) AS minutes_wma_5_before,
          {_family_sql('pts', 'k', 'ks')}, {_family_sql('minutes', 'km', 'kms')}
        FROM x JOIN w USING (event_id) JOIN wm USING (event_id) LEFT JOIN prev USING (entity, season, home)""",
    "series",
)
def w8(spark, sf_dir):
    values = W.form_families(["pts", "minutes"], ["PTS", "min"])
    base = standin(spark, sf_dir, "series").select("event_id", "entity", "season", "home", "ts", *values)
    out = W.form_columns(base, KEYS, values).drop("entity", "season", "home", "ts", *values)
    return rounded(out.withColumns({c: F.round(c, 4) for c in out.columns if "_trend_slope_" in c}))


def flagship(spark, sf_dir):
    """Prior-5 mean, split-relative mean and 10-minus-5 delta of every event, from one look at the keys."""
    rows = _series(spark, sf_dir)
    hot = W.look(rows, KEYS, W.CHECK)
    out = W.prior_means(rows, KEYS, ["pts"], [5, 10], hot=hot)
    out = W.window_delta(W.split_relative_mean(out, KEYS, "pts", 5, hot=hot), KEYS, "pts", 10, 5)
    names = ["pts_last_all_5_before", "pts_last_all_10_before", "pts_last_split_5_before", "pts_last_10_minus_last_5_before"]
    return rounded(out.select("event_id", "entity", *names))
