"""W23-W24, C7-C12: travel, crew and availability effects."""

from pyspark.sql import functions as F

from priorline.functions.text import canonical_name
from priorline.operators import effects, travel
from priorline.operators.windows import trailing_days
from priorline.plans.registry import query
from priorline.plans.standins import rounded, standin, table
from priorline.session import cut_lineage
from priorline.skew import best_rows


def _cities(spark, sf_dir):
    """Team ids take the coordinates of a nation; one nation has none, to keep an unknown city."""
    teams = standin(spark, sf_dir, "team_games").select(F.col("team_id").alias("team")).distinct()
    nations = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "CASE WHEN n_nationkey <> 7 THEN CAST(25 + n_nationkey AS DOUBLE) END AS lat", "CAST(-70 - n_regionkey * 11 AS DOUBLE) AS lon"
    )
    return teams.join(nations, F.col("team") % 25 == F.col("n_nationkey")).select("team", "lat", "lon")


_LOG_SQL = """cities AS (SELECT DISTINCT team_id AS team, CASE WHEN n_nationkey <> 7 THEN CAST(25 + n_nationkey AS DOUBLE) END AS lat,
        CAST(-70 - n_regionkey * 11 AS DOUBLE) AS lon FROM team_games JOIN nation ON n_nationkey = team_id % 25),
    log AS (SELECT game_id, game_date, team_id AS team, home AS is_home, CASE WHEN home THEN team_id ELSE opponent_id END AS host FROM team_games),
    prev AS (SELECT l.*, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(is_home) OVER w AS phome
      FROM log l LEFT JOIN cities c ON c.team = host WINDOW w AS (PARTITION BY l.team ORDER BY game_date, game_id)),
    trips AS (SELECT game_id, game_date, team, is_home, CASE WHEN is_home AND phome THEN 0.0 ELSE coalesce(2 * 6371.0 * asin(sqrt(
        power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2))), 0.0) END AS km FROM prev)"""


def _trips(spark, sf_dir):
    games = standin(spark, sf_dir, "games").select("game_id", "game_date", "home_team", "away_team")
    log = travel.team_log(games, ["game_id", "game_date"], "home_team", "away_team")
    return travel.trip_km(log, _cities(spark, sf_dir), "team", ["game_date", "game_id"], "host", "is_home")


@query("w23_trip_km", f"WITH {_LOG_SQL} SELECT game_id, team, round(km, 4) AS km FROM trips", "team_games")
def w23(spark, sf_dir):
    return rounded(_trips(spark, sf_dir).select("game_id", "team", "km"), 4)


_TRAIL = ", ".join(
    f"round(coalesce(sum(km) OVER (PARTITION BY team ORDER BY game_date RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0), 4) AS km_last_{n}_days"
    for n in travel.TRAVEL_DAYS
)


@query("w24_trailing_km", f"WITH {_LOG_SQL} SELECT game_id, team, {_TRAIL} FROM trips", "team_games")
def w24(spark, sf_dir):
    out = trailing_days(_trips(spark, sf_dir), ["team"], "game_date", "km", travel.TRAVEL_DAYS, "km_last_{n}_days")
    return rounded(out.drop("game_date", "is_home", "host", "km"), 4)


_SIDES = ", ".join(
    f"round(ln(1 + {'h' if s == 'home' else 'a'}.km_last_{n}_days), 4) AS km_last_{n}_days_{s}" for s in ("home", "away") for n in travel.TRAVEL_DAYS
)


@query(
    "c12_travel_block",
    f"WITH {_LOG_SQL}, tr AS (SELECT game_id, is_home, {_TRAIL.replace('round(', '(').replace(', 4)', ')')} FROM trips) "
    f"SELECT h.game_id, {_SIDES} FROM tr h JOIN tr a ON h.game_id = a.game_id AND h.is_home AND NOT a.is_home",
    "team_games",
)
def c12(spark, sf_dir):
    games = standin(spark, sf_dir, "games").select("game_id", "game_date", "home_team", "away_team")
    out = travel.travel_block(games, _cities(spark, sf_dir), "game_id", "game_date", "home_team", "away_team")
    return rounded(out.drop("game_date", "home_team", "away_team"), 4)


_CREW_SQL = """names AS (SELECT DISTINCT game_id, trim(regexp_replace(replace(regexp_replace(raw_name, '\\(#\\d+\\)', '', 'g'), '.', ' '), '\\s+', ' ', 'g')) AS nm FROM officials),
    crew AS (SELECT game_id, nm, row_number() OVER (PARTITION BY game_id ORDER BY nm COLLATE "C") AS slot FROM names QUALIFY slot <= 3)""".replace(' COLLATE "C"', "")


def _crew(spark, sf_dir):
    return cut_lineage(effects.crews(standin(spark, sf_dir, "officials"), "game_id", canonical_name(F.col("raw_name"))))


def _ref_games(spark, sf_dir, crew):
    games = standin(spark, sf_dir, "games").selectExpr(
        "game_id", "season", "game_date", "home_pts + away_pts AS points", "home_pts + away_pts - total_line AS line_error"
    )
    return games.join(crew.select("game_id"), "game_id", "left_semi")


_REF_SQL = f"""{_CREW_SQL}, pg AS (SELECT game_id, season, game_date, home_pts + away_pts AS points, home_pts + away_pts - total_line AS line_error
        FROM games WHERE game_id IN (SELECT game_id FROM crew))"""
_METRICS = ["points", "line_error"]


def _ref_stats():
    out = []
    for m in _METRICS:
        out.append(f"round(avg(d_{m}), 5) AS ref_avg_{m}_diff_before, round(stddev_pop(d_{m}), 4) AS ref_std_{m}_diff_before, round(sum(d_{m}), 5) AS ref_sum_{m}_diff_before")
    return ", ".join(out)


def _ref_delta(m):
    now = f"nw_s_{m} / nullif(nw_n_{m}, 0) - (na_s_{m} - coalesce(nw_s_{m}, 0)) / nullif(na_n_{m} - nw_n_{m}, 0)"
    old = f"ow_s_{m} / nullif(ow_n_{m}, 0) - (oa_s_{m} - coalesce(ow_s_{m}, 0)) / nullif(oa_n_{m} - ow_n_{m}, 0)"
    return f"CASE WHEN nw > 0 AND na > nw THEN {now} WHEN ow > 0 AND oa > ow THEN {old} END AS d_{m}"


def _agg(prefix):
    return f"count(g.game_id) AS {prefix}, " + ", ".join(f"sum({m}) AS {prefix}_s_{m}, count({m}) AS {prefix}_n_{m}" for m in _METRICS)


@query(
    "c7_referee_effect",
    f"""WITH {_REF_SQL}, cr AS (SELECT c.game_id, nm, season, game_date, points, line_error FROM crew c JOIN pg USING (game_id)),
        q AS (SELECT DISTINCT nm, season, game_date FROM cr),
        nw AS (SELECT q.nm, q.season, q.game_date, {_agg('nw')} FROM q LEFT JOIN cr g ON g.nm = q.nm AND g.season = q.season AND g.game_date < q.game_date GROUP BY 1, 2, 3),
        dd AS (SELECT DISTINCT season, game_date FROM pg),
        na AS (SELECT dd.season, dd.game_date, {_agg('na')} FROM dd LEFT JOIN pg g ON g.season = dd.season AND g.game_date < dd.game_date GROUP BY 1, 2),
        ow AS (SELECT nm, season + 1 AS season, {_agg('ow')} FROM cr g GROUP BY 1, 2), oa AS (SELECT season + 1 AS season, {_agg('oa')} FROM pg g GROUP BY 1),
        st AS (SELECT nm, season, game_date, {', '.join(_ref_delta(m) for m in _METRICS)} FROM nw LEFT JOIN na USING (season, game_date)
          LEFT JOIN ow USING (nm, season) LEFT JOIN oa USING (season))
        SELECT game_id, {_ref_stats()} FROM cr JOIN st USING (nm, season, game_date) GROUP BY game_id""",
    "officials games",
)
def c7(spark, sf_dir):
    crew = _crew(spark, sf_dir)
    members = crew.select("game_id", F.explode(F.array("ref_1", "ref_2", "ref_3")).alias("ref")).filter("ref IS NOT NULL")
    out = effects.participant_effects(
        _ref_games(spark, sf_dir, crew), members, game="game_id", season="season", date="game_date", member="ref", metrics=_METRICS
    )
    std = {f"ref_std_{m}_diff_before": F.round(f"ref_std_{m}_diff_before", 4) for m in _METRICS}
    return rounded(out.withColumns(std), 5)


@query(
    "c8_crew_effect",
    f"""WITH {_REF_SQL}, ky AS (SELECT game_id, CASE WHEN count(*) = 3 THEN string_agg(nm, '|' ORDER BY nm) END AS k FROM crew GROUP BY 1),
        cr AS (SELECT pg.*, k FROM pg JOIN ky USING (game_id)),
        w AS (SELECT x.game_id, {', '.join(f'avg(g.{m}) AS w_{m}, stddev_pop(g.{m}) AS sd_{m}, coalesce(sum(g.{m}), 0) AS ws_{m}, count(g.{m}) AS wn_{m}' for m in _METRICS)}
          FROM cr x LEFT JOIN cr g ON g.k = x.k AND g.season IN (x.season, x.season - 1) AND g.game_date < x.game_date GROUP BY 1),
        dd AS (SELECT DISTINCT season, game_date FROM pg),
        a AS (SELECT dd.season, dd.game_date, {', '.join(f'coalesce(sum(g.{m}), 0) AS s_{m}, count(g.{m}) AS n_{m}' for m in _METRICS)}
          FROM dd LEFT JOIN pg g ON g.season IN (dd.season, dd.season - 1) AND g.game_date < dd.game_date GROUP BY 1, 2)
        SELECT game_id, {', '.join(f'round(w_{m} - (s_{m} - ws_{m}) / nullif(n_{m} - wn_{m}, 0), 5) AS ref_trio_{m}_diff_before, round(sd_{m}, 4) AS ref_trio_{m}_std_before' for m in _METRICS)}
        FROM cr JOIN w USING (game_id) JOIN a USING (season, game_date)""",
    "officials games",
)
def c8(spark, sf_dir):
    crew = _crew(spark, sf_dir)
    out = effects.crew_effects(
        _ref_games(spark, sf_dir, crew), crew, game="game_id", season="season", date="game_date",
        slots=["ref_1", "ref_2", "ref_3"], metrics=_METRICS,
    )
    std = {f"ref_trio_{m}_std_before": F.round(f"ref_trio_{m}_std_before", 4) for m in _METRICS}
    return rounded(out.withColumns(std), 5)


def _absences(spark, sf_dir):
    rows = standin(spark, sf_dir, "appearances").filter("listed").select("game_id", "team_id", "player_id")
    return effects.absence_facts(rows, "game_id", "team_id", "player_id")


@query("c8b_absence_facts", "SELECT DISTINCT game_id, team_id, player_id FROM appearances WHERE listed", "appearances")
def c8b(spark, sf_dir):
    return _absences(spark, sf_dir)


def _team_history(spark, sf_dir):
    return standin(spark, sf_dir, "team_games").selectExpr(
        "game_id", "team_id", "season", "game_date", "2 * pts - plus_minus AS points", "2 * pts - plus_minus - total_line AS line_error"
    )


_AVAIL_SQL = """hist AS (SELECT game_id, team_id, season, game_date, 2 * pts - plus_minus AS points, 2 * pts - plus_minus - total_line AS line_error
        FROM team_games WHERE total_line IS NOT NULL),
    miss AS (SELECT DISTINCT game_id, team_id, player_id FROM appearances WHERE listed),
    q AS ({requests}),
    mm AS (SELECT m.player_id, h.* FROM miss m JOIN hist h USING (game_id, team_id)),
    ab AS (SELECT q.*, count(m.game_id) AS n_a, coalesce(sum(m.points), 0) AS s_p, coalesce(sum(m.line_error), 0) AS s_l FROM q LEFT JOIN mm m
        ON m.team_id = q.team_id AND m.player_id = q.player_id AND m.season IN (q.season, q.season - 1) AND m.game_date < q.game_date GROUP BY ALL),
    td AS (SELECT t.team_id, t.season, t.game_date, count(h.game_id) AS n_t, sum(h.points) AS t_p, sum(h.line_error) AS t_l
      FROM (SELECT DISTINCT team_id, season, game_date FROM q) t LEFT JOIN hist h ON h.team_id = t.team_id AND h.season IN (t.season, t.season - 1)
        AND h.game_date < t.game_date GROUP BY ALL),
    eff AS (SELECT *, n_t - n_a AS n_p, CASE WHEN n_a > 0 AND n_t > n_a THEN (t_p - s_p) / (n_t - n_a) - s_p / n_a END AS e_p,
        CASE WHEN n_a > 0 AND n_t > n_a THEN (t_l - s_l) / (n_t - n_a) - s_l / n_a END AS e_l FROM ab JOIN td USING (team_id, season, game_date))"""
_LISTED = "SELECT DISTINCT team_id, player_id, season, game_date FROM appearances WHERE listed"


@query(
    "c9_availability_effect",
    f"""WITH {_AVAIL_SQL.format(requests=_LISTED)} SELECT team_id, player_id, season, game_date, round(e_p, 5) AS points_effect,
        round(e_l, 5) AS line_error_effect, n_a AS n_absent_games, n_p AS n_present_games, n_t AS n_total_games FROM eff""",
    "appearances team_games",
)
def c9(spark, sf_dir):
    return rounded(_effects(spark, sf_dir), 5)


def _effects(spark, sf_dir):
    requests = standin(spark, sf_dir, "appearances").filter("listed")
    return effects.availability_effects(
        requests, _team_history(spark, sf_dir), _absences(spark, sf_dir), game="game_id", team="team_id", player="player_id",
        season="season", date="game_date", metrics=_METRICS,
    )


@query(
    "c10_shrunk_effect",
    f"""WITH {_AVAIL_SQL.format(requests=_LISTED)} SELECT team_id, player_id, season, game_date,
        round(CASE WHEN least(n_a, n_p) > 0 THEN e_p * least(n_a, n_p) / (least(n_a, n_p) + 10.0) END, 5) AS points_shrunk FROM eff""",
    "appearances team_games",
)
def c10(spark, sf_dir):
    shrunk = effects.shrink(F.col("points_effect"), F.col("n_absent_games"), F.col("n_present_games"))
    return rounded(_effects(spark, sf_dir).select("team_id", "player_id", "season", "game_date", shrunk.alias("points_shrunk")), 5)


_SIDES_OF = ("home", "away")


def _slot_games(spark, sf_dir):
    """Games with up to four listed players per side in slot columns."""
    listed = standin(spark, sf_dir, "appearances").filter("listed").select("game_id", "team_id", "player_id")
    top = best_rows(listed, ["game_id", "team_id"], [F.col("player_id").asc()], 4, "slot")
    games = standin(spark, sf_dir, "games").select("game_id", "season", "game_date", "home_team", "away_team")
    joined = games.join(top, "game_id", "left")
    picks = [
        F.max(F.when((F.col("team_id") == F.col(f"{s}_team")) & (F.col("slot") == i), F.col("player_id"))).alias(f"{s}_{i}")
        for s in _SIDES_OF
        for i in range(1, 5)
    ]
    return joined.groupBy(*games.columns).agg(*picks)


def _side_stats():
    out = []
    for s in _SIDES_OF:
        here = f"side = '{s}'"
        for m, e in (("points", "x_p"), ("line_error", "x_l")):
            out.append(f"round(avg({e}) FILTER ({here}), 5) AS {s}_mean_{m}, round(max(abs({e})) FILTER ({here}), 5) AS {s}_max_abs_{m}")
        for n, c in (("absent", "n_a"), ("present", "n_p"), ("total", "n_t")):
            out.append(f"coalesce(CAST(sum({c}) FILTER ({here}) AS BIGINT), 0) AS {s}_sum_n_{n}_games")
        both = f"count(*) FILTER ({here} AND n_a > 0 AND n_p > 0)"
        out.append(f"{both} AS {s}_n_players_with_effect, CAST({both} > 0 AS INTEGER) AS {s}_has_effect")
    return ", ".join(out)


_SLOT_REQUESTS = "SELECT DISTINCT team_id, player_id, season, game_date FROM slots"


@query(
    "c11_slot_effects",
    f"""WITH slots AS (SELECT a.game_id, a.team_id, a.player_id, a.season, a.game_date, CASE WHEN a.team_id = g.home_team THEN 'home' ELSE 'away' END AS side
          FROM (SELECT *, row_number() OVER (PARTITION BY game_id, team_id ORDER BY player_id) AS slot FROM appearances WHERE listed) a
          JOIN games g USING (game_id) WHERE slot <= 4 AND a.player_id <> 0),
        {_AVAIL_SQL.format(requests=_SLOT_REQUESTS)},
        x AS (SELECT *, CASE WHEN least(n_a, n_p) > 0 THEN e_p * least(n_a, n_p) / (least(n_a, n_p) + 10.0) END AS x_p,
          CASE WHEN least(n_a, n_p) > 0 THEN e_l * least(n_a, n_p) / (least(n_a, n_p) + 10.0) END AS x_l FROM eff)
        SELECT g.game_id, {_side_stats()} FROM games g LEFT JOIN slots s ON s.game_id = g.game_id
          LEFT JOIN x ON x.team_id = s.team_id AND x.player_id = s.player_id AND x.season = s.season AND x.game_date = s.game_date GROUP BY g.game_id""",
    "appearances games team_games",
)
def c11(spark, sf_dir):
    slots = {s: [f"{s}_{i}" for i in range(1, 5)] for s in _SIDES_OF}
    teams = {s: f"{s}_team" for s in _SIDES_OF}
    out = effects.slot_effects(
        _slot_games(spark, sf_dir), _team_history(spark, sf_dir), _absences(spark, sf_dir), game="game_id", season="season",
        date="game_date", player="player_id", team="team_id", slots=slots, teams=teams, metrics=_METRICS,
    )
    return rounded(out, 5)
