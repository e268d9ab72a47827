"""Domain-shaped tables that Spark derives from the whole driver tables, and the same in SQL.

Every stand-in reads all rows of its source; amounts are kept as whole numbers (cents, points) so
sums are exact in any order on both engines.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Each stand-in: (source tables, Spark SQL, DuckDB SQL).  Both texts state the same rows.
_SERIES = """
SELECT event_id, user_id AS entity, ts, CAST(ts AS DATE) AS day,
       CAST(2021 + {day_of_month} {div} 10 AS INT) AS season,
       event_type IN ('purchase', 'view') AS home, event_type,
       CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS DOUBLE) END AS pts,
       CASE WHEN round(value * 100) >= 3000 THEN 'W' ELSE 'L' END AS wl,
       CAST(CAST(round(value * 100) AS BIGINT) % 37 AS DOUBLE) AS minutes
FROM events
"""

_GAMES = """
SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date,
       CAST(year(o_orderdate) AS INT) AS season,
       o_custkey {div} 12 AS home_team, o_custkey {div} 12 + 1 + o_orderkey % 3 AS away_team,
       CAST(80 + c % 61 AS DOUBLE) AS home_pts, CAST(80 + (c {div} 61) % 59 AS DOUBLE) AS away_pts,
       CAST(CASE WHEN c % 17 = 0 THEN 265 ELSE 240 END AS DOUBLE) AS minutes,
       CASE WHEN c % 23 > 0 THEN CAST(200 + c % 47 AS DOUBLE) + CAST(c % 2 AS DOUBLE) / 2 END AS total_line,
       CASE WHEN c % 29 > 0 THEN CAST(200 + c % 43 AS DOUBLE) END AS open_line,
       CAST(c % 25 AS DOUBLE) - CAST(12 AS DOUBLE) AS spread_home,
       CASE o_orderstatus WHEN 'P' THEN '4' WHEN 'F' THEN '2' ELSE '1' END AS season_kind,
       o_orderpriority AS priority, c AS cents
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) o
"""

_TEAM_GAMES = """
SELECT game_id, game_date, season, season_kind, home_team AS team_id, away_team AS opponent_id, TRUE AS home,
       home_pts AS pts, home_pts - away_pts AS plus_minus, minutes, total_line, spread_home AS spread,
       CASE WHEN home_pts > away_pts THEN 'W' WHEN home_pts < away_pts THEN 'L' END AS wl
FROM games
UNION ALL
SELECT game_id, game_date, season, season_kind, away_team, home_team, FALSE,
       away_pts, away_pts - home_pts, minutes, total_line, -spread_home,
       CASE WHEN away_pts > home_pts THEN 'W' WHEN away_pts < home_pts THEN 'L' END
FROM games
"""

_APPEARANCES = """
SELECT g.game_id, a.player_id, g.game_date, g.season,
       CASE WHEN a.player_id % 2 = 0 THEN g.home_team ELSE g.away_team END AS team_id, a.listed,
       CASE WHEN NOT a.listed THEN CASE WHEN a.cents % 19 = 0 THEN CAST(0 AS DOUBLE) ELSE a.qty END END AS minutes,
       CASE WHEN NOT a.listed THEN CAST(a.cents % 41 AS DOUBLE) END AS pts,
       CAST(95 + a.cents % 31 AS DOUBLE) AS def_rating, CAST(90 + a.cents % 23 AS DOUBLE) AS pace
FROM (SELECT l_orderkey AS game_id, l_partkey AS player_id, max(l_returnflag) = 'R' AS listed,
             sum(l_quantity) AS qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM lineitem GROUP BY l_orderkey, l_partkey) a
JOIN games g ON g.game_id = a.game_id
"""

_OFFICIALS = """
SELECT DISTINCT l_orderkey AS game_id, l_suppkey AS official_id,
       concat('Ref ', CAST(l_suppkey AS {text}), '.  (#', CAST(l_suppkey % 90 AS {text}), ')') AS raw_name
FROM lineitem
"""

_BOOK_ODDS = """
SELECT game_id, game_date, season, home_team, away_team, home_pts + away_pts AS total_points,
       total_line AS total_line_alpha,
       CASE WHEN cents % 7 > 0 THEN CAST(200 + cents % 43 AS DOUBLE) END AS total_line_bravo,
       CASE WHEN cents % 11 > 0 THEN CAST(200 + (cents {div} 3) % 41 AS DOUBLE) END AS total_line_delta,
       open_line AS total_line_consensus_opener,
       CAST(-120 + cents % 13 AS DOUBLE) AS total_alpha_price_over, CAST(-118 + cents % 9 AS DOUBLE) AS total_alpha_price_under,
       CASE WHEN cents % 7 > 0 THEN CAST(100 + cents % 19 AS DOUBLE) END AS total_bravo_price_over,
       CASE WHEN cents % 7 > 0 THEN CAST(-125 + cents % 17 AS DOUBLE) END AS total_bravo_price_under,
       CAST(-115 + cents % 5 AS DOUBLE) AS total_consensus_opener_price_over,
       CAST(-112 + cents % 8 AS DOUBLE) AS total_consensus_opener_price_under,
       spread_home AS spread_alpha_line_home, -spread_home AS spread_alpha_line_away,
       CASE WHEN cents % 7 > 0 THEN spread_home + CAST(cents % 3 AS DOUBLE) END AS spread_bravo_line_home,
       CASE WHEN cents % 7 > 0 THEN -spread_home - CAST(cents % 3 AS DOUBLE) END AS spread_bravo_line_away,
       spread_home - CAST(1 AS DOUBLE) AS spread_consensus_opener_line_home,
       CAST(1 AS DOUBLE) - spread_home AS spread_consensus_opener_line_away,
       CAST(-140 + cents % 31 AS DOUBLE) AS ml_alpha_price_home, CAST(105 + cents % 37 AS DOUBLE) AS ml_alpha_price_away,
       CASE WHEN cents % 7 > 0 THEN CAST(-150 + cents % 41 AS DOUBLE) END AS ml_bravo_price_home,
       CASE WHEN cents % 7 > 0 THEN CAST(110 + cents % 29 AS DOUBLE) END AS ml_bravo_price_away,
       CAST(cents % 101 AS DOUBLE) AS total_pct_bets_over, CAST((cents {div} 5) % 101 AS DOUBLE) AS total_pct_money_over
FROM games
"""

_PREDICTIONS = """
SELECT l_orderkey AS game_id, concat('model_', CAST(l_linenumber % 3 AS {text})) AS model,
       CASE WHEN l_returnflag = 'R' THEN 'TOTAL_POINTS' ELSE 'LINE_ERROR' END AS prediction_type,
       CAST(l_shipdate AS DATE) AS predicted_on, l_partkey AS part_id, l_suppkey AS run_id, l_linenumber AS line_no,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
       CAST(190 + CAST(round(l_extendedprice * 100) AS BIGINT) % 53 AS DOUBLE) AS predicted_total,
       CASE l_linestatus WHEN 'O' THEN 'over' ELSE 'under' END AS side_pick, l_returnflag AS tag
FROM lineitem
"""

_MARKET_ROWS = """
SELECT t.game_id AS event_id, t.game_date, t.season, CASE WHEN t.home THEN 1 ELSE 0 END AS row_index,
       concat('Team ', CAST(t.team_id AS {text}), CASE WHEN t.game_id % 19 = 0 THEN 'x' ELSE '' END) AS team_name,
       CASE WHEN t.home THEN concat('Team ', CAST(t.opponent_id AS {text}), ' @ Team ', CAST(t.team_id AS {text}))
            ELSE concat('Team ', CAST(t.team_id AS {text}), ' @ Team ', CAST(t.opponent_id AS {text})) END AS matchup,
       CASE WHEN t.game_id % 13 > 0 THEN t.pts END AS score,
       CASE WHEN (t.game_id % 2 = 0) = t.home THEN 'O' ELSE 'u' END AS side,
       CAST(t.game_id % 100 AS DOUBLE) AS consensus_pct, t.total_line AS alpha_line,
       CAST(-110 - t.team_id % 7 AS DOUBLE) AS alpha_price, t.spread AS bravo_line,
       CAST(CASE WHEN t.team_id % 9 = 0 THEN -10000 ELSE 100 + t.team_id % 50 END AS DOUBLE) AS bravo_price
FROM team_games t
"""

_MATCHUPS = """
SELECT game_id, game_date, team_id, CASE WHEN game_id % 11 = 0 THEN TRUE ELSE home END AS home, concat('T', CAST(team_id AS {text})) AS abbr,
       CASE WHEN home THEN concat('T', CAST(team_id AS {text}), ' vs. T', CAST(opponent_id AS {text}))
            ELSE concat('T', CAST(team_id AS {text}), ' @ T', CAST(opponent_id AS {text})) END AS matchup,
       concat('00', CAST(game_id % 7 AS {text}), CAST(game_id AS {text})) AS game_text
FROM team_games
"""

_SCORED = """
SELECT p.game_id, p.model, p.line_no, p.part_id, p.run_id, p.cents, p.predicted_on, p.prediction_type, p.side_pick, p.tag,
       p.predicted_total, g.total_line AS line, g.home_pts + g.away_pts AS actual, g.game_date, g.season,
       CAST(-110 - p.cents % 7 AS DOUBLE) AS over_odds,
       CASE WHEN p.cents % 31 > 0 THEN CAST(150 + p.cents % 60 AS DOUBLE) / 100 END AS under_odds
FROM predictions p JOIN games g ON g.game_id = p.game_id
"""

# name: (inputs, template)
_TEMPLATES = {
    "series": (("events",), _SERIES),
    "games": (("orders",), _GAMES),
    "team_games": (("games",), _TEAM_GAMES),
    "appearances": (("lineitem", "games"), _APPEARANCES),
    "officials": (("lineitem",), _OFFICIALS),
    "book_odds": (("games",), _BOOK_ODDS),
    "predictions": (("lineitem",), _PREDICTIONS),
    "scored": (("predictions", "games"), _SCORED),
    "market_rows": (("team_games",), _MARKET_ROWS),
    "matchups": (("team_games",), _MATCHUPS),
}

_SPARK = {"div": "div", "day_of_month": "(day(ts) - 1)", "text": "string"}
_DUCK = {"div": "//", "day_of_month": "(day(ts) - 1)", "text": "VARCHAR"}


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    inputs, template = _TEMPLATES[name]
    frames = {i: standin(spark, sf_dir, i) if i in _TEMPLATES else table(spark, sf_dir, i) for i in inputs}
    text = template.format(**_SPARK)
    for source in frames:
        text = text.replace(f"FROM {source}", f"FROM {{{source}}}").replace(f"JOIN {source}", f"JOIN {{{source}}}")
    return spark.sql(text, **frames)


@cache
def _order(name: str) -> tuple[str, ...]:
    inputs, _ = _TEMPLATES[name]
    parents = [p for i in inputs if i in _TEMPLATES for p in _order(i)]
    return tuple(dict.fromkeys([*parents, name]))


def with_tables(sql: str, names: list[str]) -> str:
    """Prefix ``sql`` with the stand-ins it reads."""
    needed = dict.fromkeys(t for n in names for t in _order(n))
    ctes = [f"{n} AS ({_TEMPLATES[n][1].format(**_DUCK).strip()})" for n in needed]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so both engines print the same value."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])
