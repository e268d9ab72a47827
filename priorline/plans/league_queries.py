"""W19-W22, C1: league regime tables."""

from pyspark.sql import functions as F

from priorline.operators import league as L
from priorline.plans.registry import query
from priorline.plans.standins import rounded, standin


def _odds(spark, sf_dir):
    return standin(spark, sf_dir, "book_odds").withColumn("error", F.col("total_points") - F.col("total_line_alpha"))


_INDEXED = """r AS (SELECT game_date, total_points - total_line_alpha AS error, row_number() OVER (ORDER BY game_date, game_id) - 1 AS i FROM book_odds),
    d AS (SELECT game_date, min(i) AS s FROM r GROUP BY 1)"""
_GAME_STATS = {"mean": "avg", "std": "stddev_pop", "median": "median", "sum": "sum", "count": "count"}


def _game_sql():
    made = []
    for w in L.GAME_WINDOWS:
        for stat, fn in _GAME_STATS.items():
            value = f"{fn}(error) FILTER (r.i >= s - {w})"
            value = f"CAST({value} AS DOUBLE)" if stat == "count" else f"round({value}, 4)"
            made.append(f"{value} AS error_{stat}_{w}")
    return ", ".join(made)


@query(
    "w19_league_games",
    f"WITH {_INDEXED} SELECT d.game_date, {_game_sql()} FROM d LEFT JOIN r ON r.i < s AND r.i >= s - 150 GROUP BY d.game_date",
    "book_odds",
)
def w19(spark, sf_dir):
    columns = [L.Rolled(f"error_{stat}_{w}", "error", w, stat) for w in L.GAME_WINDOWS for stat in _GAME_STATS]
    return rounded(L.rolling_games(_odds(spark, sf_dir), "game_date", "game_id", columns), 4)


def _day_sql():
    made = []
    for n in L.DAY_WINDOWS:
        for stat, fn in _GAME_STATS.items():
            value = f"{fn}(error) FILTER (r.game_date >= d.game_date - {n})"
            value = f"CAST(nullif({value}, 0) AS DOUBLE)" if stat == "count" else f"round({value}, 4)"
            made.append(f"{value} AS error_{stat}_{n}d")
    return ", ".join(made)


@query(
    "w20_league_days",
    f"""WITH r AS (SELECT game_date, total_points - total_line_alpha AS error FROM book_odds),
        d AS (SELECT DISTINCT game_date FROM r)
        SELECT d.game_date, {_day_sql()} FROM d LEFT JOIN r ON r.game_date < d.game_date AND r.game_date >= d.game_date - 14
        GROUP BY d.game_date""",
    "book_odds",
)
def w20(spark, sf_dir):
    columns = [L.Rolled(f"error_{stat}_{n}d", "error", n, stat) for n in L.DAY_WINDOWS for stat in _GAME_STATS]
    return rounded(L.rolling_days(_odds(spark, sf_dir), "game_date", columns), 4)


def _weights(span):
    return f"power({1 - 2 / (span + 1)!r}, s - 1 - r.i)"


@query(
    "w21_league_ewm_mean",
    f"""WITH {_INDEXED} SELECT d.game_date, """
    + ", ".join(
        f"round(sum({_weights(s)} * error) / sum(CASE WHEN error IS NOT NULL THEN {_weights(s)} END), 6) AS ewm_{s}" for s in L.EWM_SPANS
    )
    + " FROM d LEFT JOIN r ON r.i < s GROUP BY d.game_date",
    "book_odds",
)
def w21(spark, sf_dir):
    return rounded(L.ewm_before(_odds(spark, sf_dir), "game_date", "game_id", [L.Decayed("error", "mean", "ewm_{span}")]))


def _ewm_std(s):
    w = f"CASE WHEN error IS NOT NULL THEN {_weights(s)} END"
    return f"""round(CASE WHEN count(error) > 1 THEN sqrt(greatest(sum({w} * error * error) / sum({w}) - power(sum({w} * error) / sum({w}), 2), 0)
        * power(sum({w}), 2) / (power(sum({w}), 2) - sum({w} * {w}))) END, 4) AS ewm_std_{s}"""


@query(
    "w22_league_ewm_std",
    f"""WITH {_INDEXED} SELECT d.game_date, """
    + ", ".join(_ewm_std(s) for s in L.EWM_SPANS)
    + " FROM d LEFT JOIN r ON r.i < s GROUP BY d.game_date",
    "book_odds",
)
def w22(spark, sf_dir):
    return rounded(L.ewm_before(_odds(spark, sf_dir), "game_date", "game_id", [L.Decayed("error", "std", "ewm_std_{span}")]), 4)


BOOKS = ["total_line_alpha", "total_line_bravo", "total_line_delta"]

# Value expressions of the regime block in SQL, by the short names its columns use.
_VALUES = {
    "close": "total_line_alpha",
    "actual": "total_points",
    "error": "total_points - total_line_alpha",
    "abs_error": "abs(total_points - total_line_alpha)",
    "over": "CAST(total_points > total_line_alpha AS DOUBLE)",
    "under": "CAST(total_points < total_line_alpha AS DOUBLE)",
    "push": "CAST(total_points = total_line_alpha AS DOUBLE)",
    "tail_10": "CAST(abs(total_points - total_line_alpha) > 10 AS DOUBLE)",
    "tail_15": "CAST(abs(total_points - total_line_alpha) > 15 AS DOUBLE)",
    "tail_20": "CAST(abs(total_points - total_line_alpha) > 20 AS DOUBLE)",
    "one": "1.0",
    "move": "total_line_alpha - total_line_consensus_opener",
    "abs_move": "abs(total_line_alpha - total_line_consensus_opener)",
    "open_error": "total_points - total_line_consensus_opener",
    "open_abs_error": "abs(total_points - total_line_consensus_opener)",
    "close_better": "CAST(abs(total_points - total_line_alpha) < abs(total_points - total_line_consensus_opener) AS DOUBLE)",
    "book_std": "list_stddev_pop([total_line_alpha, total_line_bravo, total_line_delta])",
}


def _regime_sql():
    games, days = L.regime_columns(True, True)
    values = ", ".join(f"{e} AS {n}" for n, e in _VALUES.items())
    g = []
    for c in games:
        value = f"{_GAME_STATS[c.stat]}({c.value[4:]}) FILTER (v.i >= s - {c.size})"
        g.append(f"{'coalesce(' + value + ', 0)' if c.stat == 'count' else value} AS {c.name}")
    d = []
    for c in days:
        value = f"{_GAME_STATS[c.stat]}({c.value[4:]}) FILTER (v.game_date >= d.game_date - {c.size})"
        d.append(f"{'nullif(' + value + ', 0)' if c.stat == 'count' else value} AS {c.name}")
    e = []
    for s in L.EWM_SPANS:
        w = f"power({1 - 2 / (s + 1)!r}, s - 1 - v.i)"
        for value, name in (("error", "market_bias"), ("abs_error", "market_mae")):
            e.append(f"sum({w} * {value}) / sum(CASE WHEN {value} IS NOT NULL THEN {w} END) AS global_{name}_ewm_{s}g_before")
        std = _ewm_std(s).replace("r.i", "v.i").strip()
        e.append(std.split("round(", 1)[1].rsplit(", 4)", 1)[0] + f" AS global_market_error_std_ewm_{s}g_before")
    ratios = []
    for label in [f"{w}g" for w in L.GAME_WINDOWS] + [f"{n}d" for n in L.DAY_WINDOWS]:
        ratios.append(f"global_actual_total_avg_{label}_before - global_close_total_avg_{label}_before AS global_actual_minus_close_avg_{label}_before")
    for s, n in ((15, 75), (30, 150)):
        ratios.append(f"(global_market_bias_{s}g_before - global_market_bias_{n}g_before) / (global_market_error_std_{n}g_before + 1e-6) AS global_market_bias_norm_diff_{s}g_vs_{n}g_before")
        ratios.append(f"global_market_mae_{s}g_before / (global_market_mae_{n}g_before + 1e-6) AS global_market_mae_ratio_{s}g_vs_{n}g_before")
        ratios.append(f"global_market_error_std_{s}g_before / (global_market_error_std_{n}g_before + 1e-6) AS global_market_std_ratio_{s}g_vs_{n}g_before")
        for label in ("market_bias", "market_mae", "close_total_avg", "actual_total_avg"):
            ratios.append(f"global_{label}_{s}g_before - global_{label}_{n}g_before AS global_{label}_diff_{s}g_{n}g_before")
    names = [c.name for c in games + days] + [x.rsplit(" AS ", 1)[1] for x in e + ratios]
    shown = ", ".join(f"round(CAST({n} AS DOUBLE), 5) AS {n}" for n in names)
    return f"""WITH v AS (SELECT game_date, {values}, row_number() OVER (ORDER BY game_date, game_id) - 1 AS i FROM book_odds),
        d AS (SELECT game_date, min(i) AS s FROM v GROUP BY 1),
        g AS (SELECT d.game_date, {', '.join(g)} FROM d LEFT JOIN v ON v.i < s AND v.i >= s - 150 GROUP BY d.game_date),
        dd AS (SELECT d.game_date, {', '.join(d)} FROM d LEFT JOIN v ON v.game_date < d.game_date AND v.game_date >= d.game_date - 14 GROUP BY d.game_date),
        e AS (SELECT d.game_date, {', '.join(e)} FROM d LEFT JOIN v ON v.i < s GROUP BY d.game_date),
        t AS (SELECT * FROM g JOIN dd USING (game_date) JOIN e USING (game_date)),
        u AS (SELECT *, {', '.join(ratios)} FROM t)
        SELECT game_id, {shown}, round(list_stddev_pop([total_line_alpha, total_line_bravo, total_line_delta]), 5) AS this_game_crossbook_total_std_before,
          round(greatest(total_line_alpha, total_line_bravo, total_line_delta) - least(total_line_alpha, total_line_bravo, total_line_delta), 5)
          AS this_game_crossbook_total_range_before FROM book_odds JOIN u USING (game_date)"""


@query("c1_market_regime", _regime_sql(), "book_odds")
def c1(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds").select(
        "game_id", "game_date", "total_points", "total_line_consensus_opener", *BOOKS
    )
    out = L.regime_block(odds, "game_date", "game_id", "total_points", "total_line_alpha", "total_line_consensus_opener", BOOKS)
    return rounded(out.drop("game_date", "total_points", "total_line_consensus_opener", *BOOKS), 5)
