"""F, P, J, A, U and the remaining C operators on the stand-in tables."""

from pyspark.sql import functions as F

from priorline.functions import dates as D
from priorline.functions import odds as O
from priorline.operators import columns as C
from priorline.operators import composites
from priorline.operators import filters as FL
from priorline.operators import games as G
from priorline.operators import joins as J
from priorline.operators import market as M
from priorline.operators import pivots as A
from priorline.operators import sets as U
from priorline.plans.registry import query
from priorline.plans.standins import rounded, standin, table


# ---------------------------------------------------------------- F
@query(
    "f1_clean_team_rows",
    """SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_linenumber <> 3
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice, l_quantity) = 1""",
)
def f1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("minutes", F.when(F.col("l_linenumber") == 3, 0).otherwise(240))
    order = [F.col(c).asc() for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")]
    return FL.clean_team_rows(rows, ["l_orderkey", "l_suppkey"], "l_quantity", "minutes", order).select("l_orderkey", "l_suppkey", "l_quantity")


@query(
    "f2_complete_games",
    """SELECT game_id, team_id, season_type FROM (SELECT game_id, team_id, CASE substr(game_text, 1, 3) WHEN '001' THEN 'Preseason' WHEN '002' THEN 'Regular Season'
          WHEN '003' THEN 'All Star' WHEN '004' THEN 'Playoffs' WHEN '005' THEN 'Playoffs' WHEN '006' THEN 'In-Season Final Game' ELSE 'Unknown' END AS season_type,
          count(*) OVER (PARTITION BY game_id) AS n FROM (FROM matchups UNION ALL FROM matchups WHERE game_id % 5 = 0 AND team_id % 2 = 1)) WHERE n = 2 AND season_type NOT IN ('Preseason', 'All Star')""",
    "matchups",
)
def f2(spark, sf_dir):
    rows = standin(spark, sf_dir, "matchups")
    rows = rows.unionByName(rows.filter("game_id % 5 = 0 AND team_id % 2 = 1"))  # some teams are listed twice
    return FL.complete_games(rows, "game_id", D.season_type(F.col("game_text"))).select("game_id", "team_id", "season_type")


@query(
    "f3_reject_games",
    """SELECT game_id, team_id FROM team_games WHERE game_id NOT IN (SELECT game_id FROM team_games WHERE wl IS NULL OR trim(wl) = '' OR pts < 50 OR minutes < 120)""",
    "team_games",
)
def f3(spark, sf_dir):
    rows = standin(spark, sf_dir, "team_games")
    return FL.reject_groups(rows, ["game_id"], FL.bad_team_row("wl", "pts", "minutes")).select("game_id", "team_id")


@query(
    "f4_short_games",
    """SELECT game_id, player_id FROM appearances WHERE game_id NOT IN
        (SELECT game_id FROM appearances WHERE season > 1995 GROUP BY game_id, team_id HAVING sum(coalesce(minutes, 0)) < 40)""",
    "appearances",
)
def f4(spark, sf_dir):
    rows = standin(spark, sf_dir, "appearances")
    return FL.reject_short_games(rows, "game_id", "team_id", "minutes", 40, skip=F.col("season") <= 1995).select("game_id", "player_id")


@query("f5_date_range", "SELECT game_id FROM games WHERE game_date BETWEEN DATE '1996-03-01' AND DATE '2000-06-30'", "games")
def f5(spark, sf_dir):
    return FL.between_dates(standin(spark, sf_dir, "games"), "game_date", "1996-03-01", "2000-06-30").select("game_id")


@query(
    "f6_seasons_or_ids",
    "SELECT DISTINCT game_id, season FROM games WHERE (season IN (1997, 1998) AND game_date <= DATE '1998-09-30') OR game_id IN (1, 2, 3, 500)",
    "games",
)
def f6(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    return FL.seasons_or_ids(games, "season", [1997, 1998], "game_date", "1998-09-30", "game_id", [1, 2, 3, 500]).select("game_id", "season")


@query("f7_valid_totals", "SELECT game_id FROM games WHERE total_line >= 100 AND open_line >= 100", "games")
def f7(spark, sf_dir):
    return FL.valid_totals(standin(spark, sf_dir, "games"), ["total_line", "open_line"]).select("game_id")


@query("f8_valid_line", "SELECT game_id FROM games WHERE total_line > 220", "games")
def f8(spark, sf_dir):
    return FL.valid_totals(standin(spark, sf_dir, "games"), ["total_line"], 220, strict=True).select("game_id")


@query(
    "f9_few_nulls",
    """SELECT game_id FROM book_odds WHERE (total_line_alpha IS NULL)::INT + (total_line_bravo IS NULL)::INT + (total_line_delta IS NULL)::INT + (total_line_consensus_opener IS NULL)::INT <= 1""",
    "book_odds",
)
def f9(spark, sf_dir):
    lines = ["total_line_alpha", "total_line_bravo", "total_line_delta", "total_line_consensus_opener"]
    return FL.few_nulls(standin(spark, sf_dir, "book_odds"), lines, 1).select("game_id")


@query(
    "f10_not_started",
    "SELECT o_orderkey FROM orders WHERE (CAST(o_orderdate AS TIMESTAMP) AT TIME ZONE 'US/Eastern') AT TIME ZONE 'UTC' > TIMESTAMP '1998-06-01 04:00:00'",
)
def f10(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("start", F.col("o_orderdate").cast("timestamp"))
    return FL.not_started(rows, "start", "US/Eastern", F.lit("1998-06-01 04:00:00").cast("timestamp")).select("o_orderkey")


@query(
    "f11_drop_unsubmitted",
    "SELECT game_id FROM games WHERE game_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)",
    "games",
)
def f11(spark, sf_dir):
    reason = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "NOT YET SUBMITTED").otherwise("other")
    reports = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), reason.alias("reason"))
    return FL.without_unsubmitted(standin(spark, sf_dir, "games"), reports, "game_id", "reason").select("game_id")


@query("f12_injury_text", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)injur|injry|erent')")
def f12(spark, sf_dir):
    # The generated prose has no injuries; one of its own words stands for the pattern's second spelling.
    text = F.regexp_replace("text", "(?i)erent", "injry")
    return table(spark, sf_dir, "documents").filter(FL.is_injury(text)).select("doc_id")


@query("f13_latest_ids", "SELECT game_id, game_date FROM games ORDER BY game_date DESC, game_id DESC LIMIT 50", "games")
def f13(spark, sf_dir):
    return FL.latest_ids(standin(spark, sf_dir, "games"), "game_id", "game_date", 50)


@query("f14_conform", "SELECT game_id, season, total_line FROM games", "games")
def f14(spark, sf_dir):
    history = standin(spark, sf_dir, "games").select("game_id", "season", "total_line")
    return FL.conform(standin(spark, sf_dir, "games").withColumn("extra", F.lit(1)), history)


_HOST = "CASE WHEN contains(matchup, '@') THEN trim(split_part(matchup, '@', 2)) ELSE trim(split_part(matchup, 'vs.', 1)) END"
_REPAIRED = f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY game_id, home) > 1 THEN abbr = {_HOST} ELSE home END AS fixed FROM matchups"


@query("f15_repair_home_flag", f"SELECT game_id, team_id, fixed AS home FROM ({_REPAIRED})", "matchups")
def f15(spark, sf_dir):
    return FL.repair_home_flag(standin(spark, sf_dir, "matchups"), "game_id", "home", "matchup", "abbr").select("game_id", "team_id", "home")


@query(
    "f16_diagnose_home_flag",
    f"SELECT game_id, count(*) AS n_rows, count(*) FILTER (home) AS n_home, count(*) FILTER (home <> (abbr = {_HOST})) AS n_wrong FROM matchups GROUP BY 1",
    "matchups",
)
def f16(spark, sf_dir):
    return FL.diagnose_home_flag(standin(spark, sf_dir, "matchups"), "game_id", "home", "matchup", "abbr")


@query(
    "f17_games_for_odds",
    f"SELECT DISTINCT game_id, team_id, fixed AS home FROM ({_REPAIRED.replace('FROM matchups', chr(70) + 'ROM (SELECT * FROM matchups WHERE substr(game_text, 1, 3) NOT IN (' + chr(39) + '001' + chr(39) + ', ' + chr(39) + '003' + chr(39) + '))')})",
    "matchups",
)
def f17(spark, sf_dir):
    rows = FL.games_for_odds(standin(spark, sf_dir, "matchups"), "game_id", F.col("game_text"), "home", "matchup", "abbr")
    return rows.select("game_id", "team_id", "home")


# ---------------------------------------------------------------- P
@query("p1_rename", "SELECT p_partkey AS part_id, p_name AS name FROM part")
def p1(spark, sf_dir):
    return C.rename(table(spark, sf_dir, "part").select("p_partkey", "p_name"), {"p_partkey": "part_id", "p_name": "name"})


@query("p2_suffix", "SELECT game_id, home_pts AS home_pts_before, away_pts AS away_pts_before FROM games", "games")
def p2(spark, sf_dir):
    return C.mark_before(standin(spark, sf_dir, "games").select("game_id", "home_pts", "away_pts"), ["home_pts", "away_pts"])


@query("p3_training_columns", "SELECT game_id, game_date, total_line, home_pts AS form_before FROM games", "games")
def p3(spark, sf_dir):
    wide = standin(spark, sf_dir, "games").withColumn("form_before", F.col("home_pts"))
    return C.training_columns(wide, ["game_id", "game_date"], ["total_line"], ["total_line_"], raw=["home_pts", "away_pts", "total_line"])


@query(
    "p4_matchup_text",
    "SELECT game_id, home, CASE WHEN home THEN concat('T', team_id, ' vs. T', opponent_id) ELSE concat('T', team_id, ' @ T', opponent_id) END AS matchup FROM team_games",
    "team_games",
)
def p4(spark, sf_dir):
    me, other = F.concat(F.lit("T"), F.col("team_id")), F.concat(F.lit("T"), F.col("opponent_id"))
    home, away = F.when(F.col("home"), me).otherwise(other), F.when(F.col("home"), other).otherwise(me)
    rows = standin(spark, sf_dir, "team_games").withColumn("matchup", C.matchup_text(home, away, F.col("home")))
    return C.move_first(rows.select("game_id", "home", "matchup"), "matchup")


@query("p5_merge_duplicates", "SELECT game_id, coalesce(total_line, open_line) AS total_line FROM games", "games")
def p5(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    return C.merge_duplicates(games.select("game_id", "total_line", F.col("open_line").alias("total_line")))


@query("p6_ensure_columns", "SELECT game_id, CAST(NULL AS DOUBLE) AS total_zulu_price_over FROM games", "games")
def p6(spark, sf_dir):
    return C.ensure(standin(spark, sf_dir, "games").select("game_id"), {"game_id": "bigint", "total_zulu_price_over": "double"})


@query(
    "p7_null_report",
    """SELECT game_id, CAST((total_line IS NULL)::INT + (open_line IS NULL)::INT + 1 AS INTEGER) AS n_null,
        concat_ws(',', CASE WHEN total_line IS NULL THEN 'total_line' END, CASE WHEN open_line IS NULL THEN 'Open_Line' END, 'absent') AS null_columns FROM games""",
    "games",
)
def p7(spark, sf_dir):
    wanted = ["total_line", "Open_Line", "absent"]
    games = standin(spark, sf_dir, "games")
    aligned = C.align(games.select("game_id", "total_line", "open_line"), ["game_id", *wanted])
    return C.null_report(aligned, wanted).select("game_id", "n_null", "null_columns")


@query(
    "p8_dimension_lookup",
    "SELECT c_custkey, n_name AS nation, coalesce(CASE WHEN c_nationkey < 20 THEN n_name END, CAST(c_nationkey AS VARCHAR)) AS nation_or_key FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def p8(spark, sf_dir):
    customers, nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation")
    out = C.lookup(customers, nations, "c_nationkey", "n_nationkey", "n_name", "nation", unknown="raise")
    out = C.lookup(out, nations.filter("n_nationkey < 20"), "c_nationkey", "n_nationkey", "n_name", "nation_or_key", unknown="self")
    return out.drop("c_nationkey")


@query("p9_drop_matching", "SELECT p_partkey, p_size FROM part")
def p9(spark, sf_dir):
    return C.drop_matching(table(spark, sf_dir, "part"), ["NAME", "brand", "type", "price"])


@query("p10_books_and_lines", "SELECT game_id, total_line_alpha AS main, 'alpha,bravo' AS books FROM book_odds", "book_odds")
def p10(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds")
    books = C.available_books(odds.columns, "ml", ["price_home", "price_away"])
    C.require_book("alpha", books, "moneyline")
    line = C.main_line(odds.columns, "total_line_missing")
    return odds.select("game_id", F.col(line).alias("main"), F.lit(",".join(books)).alias("books"))


@query("p11_required_line", "SELECT game_id, total_line_bravo AS line FROM book_odds", "book_odds")
def p11(spark, sf_dir):
    features = ["pts_last_all_5_before", "total_line_bravo", "total_line_alpha_last_all_5_before"]
    return standin(spark, sf_dir, "book_odds").select("game_id", F.col(C.required_line(features)).alias("line"))


# ---------------------------------------------------------------- J
def _pairs(spark, sf_dir):
    rows = standin(spark, sf_dir, "team_games").select("game_id", "game_date", "season", "home", "team_id", "pts", "total_line")
    return G.pair_sides(rows, ["game_id", "game_date", "season"], "home")


@query(
    "j1_pair_sides",
    """SELECT game_id, game_date, season, home_team AS team_id_home, home_pts AS pts_home, total_line AS total_line_home, away_team AS team_id_away, away_pts AS pts_away, total_line AS total_line_away FROM games""",
    "games",
)
def j1(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("j2_collapse_pairs", "SELECT game_id, total_line, home_pts AS pts_home, away_pts AS pts_away FROM games", "games")
def j2(spark, sf_dir):
    return G.collapse_pairs(_pairs(spark, sf_dir), ["total_line"]).select("game_id", "total_line", "pts_home", "pts_away")


def _teams(spark, sf_dir):
    return standin(spark, sf_dir, "team_games").select("game_id", "team_id", "home")


@query(
    "j3_attach_lines",
    """SELECT t.game_id, team_id, total_line_alpha, total_line_bravo, CASE WHEN home THEN spread_alpha_line_home ELSE spread_alpha_line_away END AS spread_alpha,
        CASE WHEN home THEN ml_alpha_price_home ELSE ml_alpha_price_away END AS moneyline_alpha FROM team_games t LEFT JOIN book_odds USING (game_id)""",
    "team_games book_odds",
)
def j3(spark, sf_dir):
    out = J.attach_lines(_teams(spark, sf_dir), standin(spark, sf_dir, "book_odds"), "game_id", "home", "alpha", "all", ["alpha", "bravo"])
    return out.drop("home")


@query(
    "j4_attach_sides",
    """SELECT t.game_id, team_id, CASE WHEN home THEN spread_bravo_line_home ELSE spread_bravo_line_away END AS spread_bravo,
        CASE WHEN home THEN ml_bravo_price_home ELSE ml_bravo_price_away END AS ml_bravo FROM team_games t LEFT JOIN book_odds USING (game_id)""",
    "team_games book_odds",
)
def j4(spark, sf_dir):
    pairs = [("spread_bravo", "spread_bravo_line_home", "spread_bravo_line_away"), ("ml_bravo", "ml_bravo_price_home", "ml_bravo_price_away")]
    return J.attach_sides(_teams(spark, sf_dir), standin(spark, sf_dir, "book_odds"), "game_id", "home", pairs).drop("home")


@query(
    "j5_attach_remaining",
    """SELECT g.game_id, g.total_line, o.total_pct_bets_over, o.total_pct_money_over, o.total_line_alpha, o.total_line_delta FROM games g LEFT JOIN book_odds o USING (game_id)""",
    "games book_odds",
)
def j5(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds").select("game_id", "game_date", "total_pct_bets_over", "total_pct_money_over", "total_line_alpha", "total_line_bravo", "total_line_delta")
    games = standin(spark, sf_dir, "games").select("game_id", "total_line")
    return J.attach_remaining(games, odds, "game_id", ["bravo"], ["game_date"])


@query(
    "j6_merge_odds_sources",
    """WITH b AS (SELECT game_id, game_date, total_line_bravo, total_alpha_price_over FROM book_odds),
        p AS (SELECT CASE WHEN cents % 5 = 0 THEN -game_id ELSE game_id END AS game_id, game_date, total_line AS total_line, CAST(cents % 101 AS DOUBLE) AS pct FROM games)
        SELECT coalesce(b.game_id, p.game_id) AS game_id, coalesce(b.game_date, p.game_date) AS game_date, coalesce(total_line_bravo, total_line) AS total_line_bravo,
          round(CASE WHEN total_alpha_price_over > 0 THEN 1 + total_alpha_price_over / 100 WHEN total_alpha_price_over < 0 THEN 1 - 100 / total_alpha_price_over END, 6) AS total_alpha_price_over, pct
        FROM b FULL JOIN p ON b.game_id = p.game_id""",
    "games book_odds",
)
def j6(spark, sf_dir):
    # A fifth of the public rows carry ids that no book knows, so rows of both sides stay without a partner.
    books = standin(spark, sf_dir, "book_odds").select("game_id", "game_date", "total_line_bravo", "total_alpha_price_over")
    public = standin(spark, sf_dir, "games").selectExpr("CASE WHEN cents % 5 = 0 THEN -game_id ELSE game_id END AS game_id", "game_date", "total_line", "CAST(cents % 101 AS DOUBLE) AS pct")
    return rounded(J.merge_odds_sources(books, public, "game_id", ["game_date"], {"total_line_bravo": "total_line"}))


@query(
    "j7_merge_markets",
    """SELECT game_id, game_date, a.total_line, b.spread_home, c.open_line FROM (SELECT CASE WHEN season_kind = '1' THEN -game_id ELSE game_id END AS game_id, game_date, total_line FROM games) a
        FULL JOIN (SELECT CASE WHEN season_kind = '2' THEN -game_id ELSE game_id END AS game_id, game_date, spread_home FROM games) b USING (game_id, game_date)
        FULL JOIN (SELECT CASE WHEN season_kind = '4' THEN -game_id ELSE game_id END AS game_id, game_date, open_line FROM games) c USING (game_id, game_date)""",
    "games",
)
def j7(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    # each market knows one kind of games under other ids
    parts = [games.select(F.expr(f"CASE WHEN season_kind = '{k}' THEN -game_id ELSE game_id END").alias("game_id"), "game_date", v) for k, v in (("1", "total_line"), ("2", "spread_home"), ("4", "open_line"))]
    return J.merge_markets(parts, ["game_id", "game_date"])


def _dated_odds(spark, sf_dir):
    # A third of the odds carry the next day's date, and one in seven the other side's flag.
    return standin(spark, sf_dir, "team_games").selectExpr(
        "CASE WHEN game_id % 3 = 0 THEN date_add(game_date, 1) ELSE game_date END AS game_date", "game_date AS original", "team_id",
        "CASE WHEN game_id % 7 = 0 THEN NOT home ELSE home END AS home", "spread", "total_line",
    )


@query(
    "j8_dated_odds",
    """WITH o AS (SELECT CASE WHEN game_id % 3 = 0 THEN game_date + 1 ELSE game_date END AS d, game_date AS original, team_id, CASE WHEN game_id % 7 = 0 THEN NOT home ELSE home END AS home, spread, total_line FROM team_games),
        a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY d, team_id, home ORDER BY spread NULLS LAST, total_line NULLS LAST) = 1),
        b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY original, team_id, home ORDER BY spread NULLS LAST, total_line NULLS LAST) = 1),
        c AS (SELECT d, team_id, min(total_line) AS line FROM o GROUP BY 1, 2)
        SELECT t.game_id, t.team_id, coalesce(a.spread, b.spread) AS spread, coalesce(a.total_line, b.total_line, c.line) AS total_line FROM team_games t
          LEFT JOIN a ON a.d = t.game_date AND a.team_id = t.team_id AND a.home = t.home LEFT JOIN b ON b.original = t.game_date AND b.team_id = t.team_id AND b.home = t.home
          LEFT JOIN c ON c.d = t.game_date AND c.team_id = t.team_id""",
    "team_games",
)
def j8(spark, sf_dir):
    teams = standin(spark, sf_dir, "team_games").select("game_id", "game_date", "team_id", "home")
    out = J.attach_dated_odds(
        teams, _dated_odds(spark, sf_dir), date="game_date", original="original", team="team_id", home="home", values=["spread", "total_line"], line="total_line"
    )
    return out.select("game_id", "team_id", "spread", "total_line")


@query(
    "j9_resolve_ids",
    """SELECT p_home AS home_team, p_away AS away_team, p.game_date, g.game_id, p.line FROM (SELECT home_team AS p_home, away_team AS p_away, game_date, total_line AS line FROM games
        UNION ALL SELECT away_team, home_team, game_date, open_line FROM games) p LEFT JOIN games g ON g.game_date = p.game_date AND g.home_team = p.p_home AND g.away_team = p.p_away""",
    "games",
)
def j9(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    straight = games.select("home_team", "away_team", "game_date", F.col("total_line").alias("line"))
    turned = games.select(F.col("away_team").alias("home_team"), F.col("home_team").alias("away_team"), "game_date", F.col("open_line").alias("line"))
    return J.resolve_ids(straight.unionByName(turned), games, "game_date", "game_id")


@query(
    "j10_same_orientation",
    """SELECT game_id, home_team, away_team, game_date, home_pts AS home_value, away_pts AS away_value FROM games
        WHERE (home_team, away_team) IN (SELECT (home_team, away_team) FROM games WHERE season = 2001) AND game_date <= DATE '2000-12-31' AND season_kind <> '1'""",
    "games",
)
def j10(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    return G.same_orientation_history(
        games.filter("season = 2001"), standin(spark, sf_dir, "team_games"), game="game_id", team="team_id", home="home", date="game_date", value="pts",
        until=F.lit("2000-12-31").cast("date"), exclude=games.filter("season_kind = '1'").select("game_id"),
    )


@query(
    "j11_previous_season",
    "SELECT team_id, season + 1 AS season, round(avg(pts), 6) AS pts_mean, round(stddev_samp(pts), 4) AS pts_std FROM team_games GROUP BY 1, 2",
    "team_games",
)
def j11(spark, sf_dir):
    from priorline.operators.windows import previous_season

    rows = standin(spark, sf_dir, "team_games")
    out = previous_season(rows, ["team_id", "season"], "season", [F.avg("pts").alias("pts_mean"), F.stddev_samp("pts").alias("pts_std")])
    return rounded(out.withColumn("pts_std", F.round("pts_std", 4)))


@query(
    "j15_box_scores",
    """WITH l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
        SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM l""",
)
def j15(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    order = [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    ties = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    keys = ["l_orderkey", "l_linenumber"]
    out = J.box_scores(rows.select(*keys, *ties, "l_quantity"), rows.select(*keys, *ties, "l_quantity", "l_tax"), keys, order)
    return out.select(*keys, "l_quantity", "l_tax")


@query(
    "j16_game_dates",
    "SELECT l_orderkey AS game_id, l_partkey, l_linenumber, l_suppkey, l_extendedprice, CAST(o_orderdate AS DATE) AS game_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'",
)
def j16(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    games = standin(spark, sf_dir, "games").filter("season_kind <> '4'")
    return J.add_game_dates(rows, games, "game_id", "game_date")


@query(
    "j19_assign_referees",
    """SELECT DISTINCT o.game_id, o.official_id FROM officials o JOIN games g USING (game_id) JOIN games s ON s.home_team = g.home_team AND s.away_team = g.away_team AND s.game_date = g.game_date AND s.game_id = g.game_id""",
    "officials games",
)
def j19(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    # Names hold the game so that home and away text identify it; the alias table maps one spelling to another.
    named = games.select("game_id", F.concat(F.lit("Home "), "home_team", F.lit(" g"), "game_id").alias("home_name"), F.concat(F.lit("Away "), "away_team").alias("away_name"))
    assigned = standin(spark, sf_dir, "officials").join(named, "game_id").select("official_id", F.upper("home_name").alias("home"), F.concat(F.lit("AWY "), F.substring("away_name", 6, 20)).alias("away"))
    aliases = named.select(F.concat(F.lit("awy "), F.substring("away_name", 6, 20)).alias("alias"), F.col("away_name").alias("canonical")).distinct()
    return J.assign_referees(assigned, named, aliases).select("game_id", "official_id").distinct()


@query(
    "j20_report_players",
    """SELECT DISTINCT game_id, team_id, player_id FROM appearances a WHERE listed AND player_id % 3 < 2""",
    "appearances",
)
def j20(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    code = F.concat(F.date_format("game_date", "yyyyMMdd"), F.lit("/G"), "game_id", F.lit("X"))
    schedule = games.select("game_id", code.alias("code"))
    status = F.when(F.col("player_id") % 3 == 0, "Out").when(F.col("player_id") % 3 == 1, "Doubtful").otherwise("Questionable")
    reports = standin(spark, sf_dir, "appearances").filter("listed").select(
        "game_date", F.concat(F.lit("G"), "game_id", F.lit("@X")).alias("matchup"), "team_id", "player_id", status.alias("status")
    )
    joined = J.attach_reports(reports, schedule, "game_date", "matchup", "code", "game_id")
    return J.out_players(joined, "game_id", "team_id", "player_id", "status", ["Out", "Doubtful"])


_SIDE_KM = "SELECT game_id, h.km AS km_home, a.km AS km_away FROM (SELECT game_id, pts AS km FROM team_games WHERE home) h JOIN (SELECT game_id, pts AS km FROM team_games WHERE NOT home) a USING (game_id)"


@query("j21_sides_joined_back", _SIDE_KM, "team_games")
def j21(spark, sf_dir):
    from priorline.skew import attach

    rows = standin(spark, sf_dir, "team_games")
    sides = rows.groupBy("game_id").agg(F.max(F.when(F.col("home"), F.col("pts"))).alias("km_home"), F.max(F.when(~F.col("home"), F.col("pts"))).alias("km_away"))
    return attach(standin(spark, sf_dir, "games").select("game_id"), sides, ["game_id"])


@query(
    "j22_missing_dates",
    "SELECT DISTINCT UNNEST([game_date, game_date + 1]) AS game_date FROM games WHERE game_date >= DATE '1999-01-01' AND total_line IS NULL",
    "games",
)
def j22(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    return J.missing_dates(games, games.filter("total_line IS NOT NULL"), "game_id", "game_date", since="1999-01-01")


# ---------------------------------------------------------------- A
@query(
    "a1_game_total",
    "SELECT game_id, team_id, sum(pts) OVER (PARTITION BY game_id) AS total_points, sum(pts) OVER (PARTITION BY game_id) - total_line AS diff_from_total_line FROM team_games",
    "team_games",
)
def a1(spark, sf_dir):
    out = A.group_total(standin(spark, sf_dir, "team_games"), "game_id", "pts", ["total_line"])
    return out.select("game_id", "team_id", "total_points", "diff_from_total_line")


@query(
    "a2_last_season_playoffs",
    """SELECT game_id, t.team_id, coalesce(n, 0) AS playoff_games FROM team_games t LEFT JOIN (SELECT season + 1 AS season, team_id, count(DISTINCT game_id) AS n FROM team_games
        WHERE season_kind = '4' GROUP BY 1, 2) p ON p.season = t.season AND p.team_id = t.team_id""",
    "team_games",
)
def a2(spark, sf_dir):
    out = A.last_season_count(standin(spark, sf_dir, "team_games"), "season", "team_id", "game_id", F.col("season_kind") == "4", "playoff_games")
    return out.select("game_id", "team_id", "playoff_games")


@query(
    "a3_mode_and_mean",
    """WITH m AS (SELECT l_orderkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, round(avg(l_quantity), 6) AS average_l_quantity, (SELECT l_quantity FROM m WHERE m.l_orderkey = l.l_orderkey ORDER BY n DESC, l_quantity LIMIT 1) AS most_common_l_quantity
        FROM lineitem l GROUP BY 1""",
)
def a3(spark, sf_dir):
    return rounded(A.modes_and_means(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_quantity"]))


_LINES = """SELECT l_orderkey, (l_linenumber * 100000 + l_partkey) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS place, 90 + l_quantity AS total_line, l_discount AS moneyline_home, l_tax AS moneyline_away,
    l_quantity - 25 AS spread_home, 25 - l_quantity AS spread_away, l_quantity * 6 - 150 AS over_money, 140 - l_quantity * 7 AS under_money FROM {lineitem}"""
_CLEAN = {
    "total_line": "CASE WHEN total_line > 100 THEN total_line END",
    **{c: f"CASE WHEN abs({c}) >= 0.05 THEN {c} END" for c in ("moneyline_home", "moneyline_away", "spread_home", "spread_away")},
    **{c: f"CASE WHEN total_line > 100 AND abs({c}) > 10 THEN CASE WHEN {c} > 0 THEN 1 + {c} / 100 ELSE 1 + 100 / abs({c}) END END" for c in ("over_money", "under_money")},
}


@query(
    "a4_line_summary",
    f"""WITH c AS (SELECT l_orderkey, place, {', '.join(f'{e} AS {c}' for c, e in _CLEAN.items())} FROM ({_LINES.format(lineitem='lineitem')})),
        {', '.join(f"m_{c} AS (SELECT l_orderkey, {c} AS v FROM (SELECT l_orderkey, {c}, count(*) AS n, min(place) AS p FROM c WHERE {c} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, p, {c}) = 1)" for c in _CLEAN)}
        SELECT l_orderkey, {', '.join(f'round(a_{c}, 6) AS average_{c}, round(m_{c}.v, 6) AS most_common_{c}' for c in _CLEAN)}
        FROM (SELECT l_orderkey, {', '.join(f'avg({c}) AS a_{c}' for c in _CLEAN)} FROM c GROUP BY 1) g {' '.join(f'LEFT JOIN m_{c} USING (l_orderkey)' for c in _CLEAN)}""",
)
def a4(spark, sf_dir):
    lines = spark.sql(_LINES, lineitem=table(spark, sf_dir, "lineitem"))
    return rounded(A.line_summary(lines, ["l_orderkey"], "place"))


def _first(condition, value):
    return f"(list({value} ORDER BY row_index) FILTER ({condition}))[1]"


@query(
    "a5_totals_pivot",
    f"""SELECT event_id, any_value(game_date) AS game_date, {_first('row_index = 0', 'team_name')} AS team_name_away, {_first('row_index = 1', 'team_name')} AS team_name_home,
        {_first('row_index = 0', 'score')} AS score_away, {_first('row_index = 1', 'score')} AS score_home, CASE WHEN count(score) > 0 THEN sum(score) END AS total_points,
        {', '.join(f"{_first(f'upper(side) = {q}', c)} AS {c}_{s}" for s, q in (('over', "'O'"), ('under', "'U'")) for c in ('consensus_pct', 'alpha_line', 'alpha_price'))}
        FROM market_rows GROUP BY 1""",
    "market_rows",
)
def a5(spark, sf_dir):
    return A.totals_pivot(standin(spark, sf_dir, "market_rows"), "event_id", "row_index", "side", ["game_date"], ["alpha"])


@query(
    "a6_spreads_pivot",
    f"""SELECT event_id, any_value(season) AS season, {', '.join(f"{_first(f'row_index = {i}', c)} AS {c}_{s}" for s, i in (('away', 0), ('home', 1)) for c in ('team_name', 'score', 'consensus_pct', 'bravo_line', 'bravo_price'))}
        FROM market_rows GROUP BY 1""",
    "market_rows",
)
def a6(spark, sf_dir):
    return A.spreads_pivot(standin(spark, sf_dir, "market_rows"), "event_id", "row_index", ["season"], ["bravo"])


@query(
    "a7_moneylines_pivot",
    f"""SELECT event_id, any_value(season) AS season, {', '.join(f"{_first(f'row_index = {i}', c)} AS {n}_{s}" for s, i in (('away', 0), ('home', 1)) for n, c in (('team_name', 'team_name'), ('bravo_price', 'nullif(bravo_price, -10000)')))}
        FROM market_rows GROUP BY 1""",
    "market_rows",
)
def a7(spark, sf_dir):
    return A.moneylines_pivot(standin(spark, sf_dir, "market_rows"), "event_id", "row_index", ["season"], ["bravo"])


@query(
    "a8_public_pivot",
    f"""WITH r AS (SELECT *, concat(matchup, ' #', CAST(event_id AS VARCHAR)) AS mk, team_name = split_part(matchup, ' @ ', 1) AS a, team_name = split_part(matchup, ' @ ', 2) AS h FROM market_rows)
        SELECT season, game_date, event_id, any_value(matchup) AS matchup,
          {', '.join(f"CASE WHEN bool_or(a) AND bool_or(h) THEN (list({c} ORDER BY row_index) FILTER ({f}))[1] ELSE (list({c} ORDER BY row_index))[{i}] END AS {c}_{s}" for s, f, i in (('away', 'a', 1), ('home', 'h', 2)) for c in ('bravo_line', 'bravo_price'))},
          {_first("upper(side) = 'O'", 'alpha_line')} AS alpha_line_over, {_first("upper(side) = 'U'", 'alpha_line')} AS alpha_line_under
        FROM r GROUP BY 1, 2, 3""",
    "market_rows",
)
def a8(spark, sf_dir):
    return A.public_pivot(
        standin(spark, sf_dir, "market_rows"), ["season", "game_date", "event_id"], "team_name", "matchup", "row_index", ["bravo_line", "bravo_price"], ["matchup"], "side", "alpha_line"
    )


_NULL_COLUMNS = ["total_line_alpha", "total_line_bravo", "total_line_delta", "ml_bravo_price_home"]


@query(
    "a9_null_shares",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_pct FROM book_odds" for c in _NULL_COLUMNS),
    "book_odds",
)
def a9(spark, sf_dir):
    return rounded(A.null_shares(standin(spark, sf_dir, "book_odds").select(*_NULL_COLUMNS)))


@query(
    "a10_duplicate_report",
    """WITH f AS (SELECT count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING n > 1),
        w AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem))
        SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem) - (SELECT n FROM w) AS n_repeated_rows,
          (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM k) AS n_rows_in_repeated_keys, (SELECT count(*) FROM k) AS n_repeated_keys""",
)
def a10(spark, sf_dir):
    return A.duplicate_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a10_top_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING n > 1 ORDER BY n DESC, 1, 2 LIMIT 20")
def a10_top(spark, sf_dir):
    return A.top_duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a11_season_summary", "SELECT season, count(*) AS n, min(game_date) AS first_date, max(game_date) AS last_date FROM games GROUP BY 1", "games")
def a11(spark, sf_dir):
    return A.season_summary(standin(spark, sf_dir, "games"), "season", "game_date")


@query("a12_dates_of_ids", "SELECT DISTINCT game_date FROM games WHERE total_line IS NULL", "games")
def a12(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    return A.distinct_dates(games, games.filter("total_line IS NULL"), "game_id", "game_date")


@query(
    "a13_book_presence",
    "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_events, round(count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders), 8) AS share FROM lineitem GROUP BY 1",
)
def a13(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return rounded(A.book_presence(table(spark, sf_dir, "lineitem"), events, "l_orderkey", "l_suppkey"), 8)


@query(
    "a15_crew_slots",
    """WITH n AS (SELECT DISTINCT game_id, trim(regexp_replace(replace(regexp_replace(raw_name, '\\(#\\d+\\)', '', 'g'), '.', ' '), '\\s+', ' ', 'g')) AS nm FROM officials),
        s AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY nm) AS k FROM n)
        SELECT game_id, max(CASE WHEN k = 1 THEN nm END) AS ref_1, max(CASE WHEN k = 2 THEN nm END) AS ref_2, max(CASE WHEN k = 3 THEN nm END) AS ref_3 FROM s GROUP BY 1""",
    "officials",
)
def a15(spark, sf_dir):
    from priorline.functions.text import canonical_name
    from priorline.operators.effects import crews

    return crews(standin(spark, sf_dir, "officials"), "game_id", canonical_name(F.col("raw_name")))


@query(
    "a16_no_history",
    """SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01' GROUP BY 1 HAVING count(*) >= 40)""",
)
def a16(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return A.no_history(rows, rows.filter("l_shipdate < '1995-06-01'"), "l_suppkey", 40)


# ---------------------------------------------------------------- U
@query(
    "u1_stack_rows",
    "SELECT game_id, total_line, NULL AS open_line FROM games WHERE season < 1998 UNION ALL SELECT game_id, NULL, open_line FROM games WHERE season >= 1998",
    "games",
)
def u1(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    return U.stack_rows(games.filter("season < 1998").select("game_id", "total_line"), games.filter("season >= 1998").select("game_id", "open_line"))


@query("u2_team_rows", "SELECT game_id, team_id AS team, pts, home AS is_home FROM team_games", "team_games")
def u2(spark, sf_dir):
    games = standin(spark, sf_dir, "games").withColumnsRenamed({"home_team": "team_home", "away_team": "team_away", "home_pts": "pts_home", "away_pts": "pts_away"})
    return G.team_rows(games, ["game_id"], ["team", "pts"])


@query("u3_keep_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def u3(spark, sf_dir):
    return U.keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("u4_ids_to_fetch", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def u4(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    have = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return U.ids_to_fetch(orders, have, orders.filter("o_orderstatus = 'P'"), "o_orderkey")


@query("u5_ids_in_both", "SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def u5(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return U.ids_in_both(table(spark, sf_dir, "orders"), have, "o_orderkey")


@query(
    "u6_merge_absences",
    """WITH a AS (SELECT game_id, player_id, season FROM appearances WHERE listed), b AS (SELECT game_id, player_id, season FROM appearances WHERE minutes = 0),
        s AS (SELECT DISTINCT game_id, player_id, season FROM appearances WHERE season = 2001 AND player_id % 4 = 0)
        SELECT * FROM (SELECT * FROM a UNION SELECT * FROM b) WHERE game_id NOT IN (SELECT game_id FROM s) UNION ALL SELECT * FROM s""",
    "appearances",
)
def u6(spark, sf_dir):
    rows = standin(spark, sf_dir, "appearances").select("game_id", "player_id", "season", "listed", "minutes")
    keep = ["game_id", "player_id", "season"]
    scheduled = rows.filter("season = 2001 AND player_id % 4 = 0").select(*keep)
    return U.merge_absences(rows.filter("listed").select(*keep), rows.filter("minutes = 0").select(*keep), scheduled, "game_id")


@query(
    "u7_normal_ids",
    "SELECT t AS props, min(event_id) AS event_id FROM (SELECT event_id, trim(CASE WHEN event_type = 'error' THEN '  ' ELSE concat(' ', event_type, CAST(user_id % 20 AS VARCHAR), ' ') END) AS t FROM events) WHERE t <> '' GROUP BY 1",
)
def u7(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type", (F.col("user_id") % 20).cast("string"), F.lit(" ")))
    return U.normal_ids(table(spark, sf_dir, "events").select("event_id", text.alias("props")), "props", "event_id")


# ---------------------------------------------------------------- R4, C2-C6, C13
_PRICE_COLUMNS = [f"{m}_{b}_price_{s}" for m, sides in (("total", ("over", "under")), ("ml", ("home", "away"))) for b in ("alpha", "bravo") for s in sides] + [
    f"total_consensus_opener_price_{s}" for s in ("over", "under")
]
_DEC = "CASE WHEN {0} > 0 THEN 1 + {0} / 100.0 WHEN {0} < 0 THEN 1 + 100.0 / abs({0}) END"


def _two(market, b, s1, s2):
    p, q = (f"(1 / {market}_{b}_price_{s})" for s in (s1, s2))
    return p, q


def _block_sql():
    x = {}
    for b in ("alpha", "bravo"):
        p, q = _two("total", b, "over", "under")
        x |= {f"lr_{b}": f"ln(total_{b}_price_over / total_{b}_price_under)", f"pd_{b}": f"({p} - {q}) / ({p} + {q})", f"vg_{b}": f"{p} + {q} - 1"}
        p, q = _two("ml", b, "home", "away")
        x |= {f"mh_{b}": f"{p} / ({p} + {q})", f"mv_{b}": f"{p} + {q} - 1"}
        x[f"fa_{b}"] = f"CASE WHEN spread_{b}_line_home IS NOT NULL THEN abs(least(spread_{b}_line_home, spread_{b}_line_away)) END"
        x[f"hf_{b}"] = f"CAST(coalesce(spread_{b}_line_home < spread_{b}_line_away, FALSE) AS DOUBLE)"
    p, q = _two("total", "consensus_opener", "over", "under")
    x |= {"cpo": f"{p} / ({p} + {q})", "cvig": f"{p} + {q} - 1", "cpd": f"({p} - {q}) / ({p} + {q})"}
    fam = {
        "l": "[total_line_alpha, total_line_bravo, total_line_delta]", "d": "[pd_alpha, pd_bravo]", "v": "[vg_alpha, vg_bravo]", "r": "[lr_alpha, lr_bravo]",
        "h": "[spread_alpha_line_home, spread_bravo_line_home]", "f": "[fa_alpha, fa_bravo]", "m": "[mh_alpha, mh_bravo]", "w": "[mv_alpha, mv_bravo]", "z": "[hf_alpha, hf_bravo]",
    }
    fam = {k: f"list_filter({v}, lambda e: e IS NOT NULL)" for k, v in fam.items()}

    def stat(k, s):
        return {
            "mean": f"list_avg({k})", "median": f"list_median({k})", "std": f"list_stddev_pop({k})", "range": f"list_max({k}) - list_min({k})",
            "iqr": f"list_aggregate({k}, 'quantile_cont', 0.75) - list_aggregate({k}, 'quantile_cont', 0.25)",
            "mad": f"list_median(list_transform({k}, lambda e: abs(e - {k}med)))",
        }[s]

    out = {
        "consensus_total_ref_line_mid": "total_line_consensus_opener", "consensus_total_ref_prob_over_novig": "cpo", "consensus_total_ref_vig": "cvig",
        "consensus_total_ref_prob_diff_novig": "cpd", "book_total_vig_bravo": "vg_bravo", "spread_fav_abs_bravo": "fa_bravo", "spread_home_is_fav_bravo": "hf_bravo",
        "ml_home_prob_novig_alpha": "mh_alpha", "n_books_total_line_present": "CAST(len(l) AS DOUBLE)", "n_books_total_line_present_ratio": "len(l) / 3",
        "n_books_total_price_present": "CAST(len(d) AS DOUBLE)", "n_books_total_price_present_ratio": "len(d) / 2",
        "spread_consensus_ref_fav_line": "least(spread_consensus_opener_line_home, spread_consensus_opener_line_away)",
    }
    for name, k, stats in (
        ("total_line_books", "l", "mean median std range iqr mad"), ("total_prob_diff_books", "d", "mean std range iqr mad"), ("total_vig_books", "v", "mean median std iqr mad"),
        ("total_price_log_ratio_books", "r", "mean std range iqr mad"), ("spread_home_books", "h", "mean std"), ("spread_fav_abs_books", "f", "mean std range"),
        ("spread_home_is_fav_books", "z", "mean"), ("ml_vig_books", "w", "mean"),
    ):
        out |= {f"{name}_{s}": stat(k, s) for s in stats.split()}
    out |= {
        "ml_favorite_prob": "greatest(list_avg(m), 1 - list_avg(m))", "ml_win_prob_gap": "abs(2 * list_avg(m) - 1)", "total_line_x_prob_diff": "list_avg(l) * list_avg(d)",
        "total_line_x_spread_fav_abs": "list_avg(l) * list_avg(f)", "line_std_x_vig": "list_stddev_pop(l) * list_avg(v)",
        "implied_home_points": "list_avg(l) / 2 - list_avg(h) / 2", "implied_away_points": "list_avg(l) / 2 + list_avg(h) / 2",
        "implied_points_ratio": "(list_avg(l) / 2 - list_avg(h) / 2) / (list_avg(l) - (list_avg(l) / 2 - list_avg(h) / 2))",
        "implied_points_gap": "abs(list_avg(h)) + 0 * list_avg(l)",
    }
    names = list(out)
    sql = f"""WITH o AS (SELECT * REPLACE ({', '.join(f'{_DEC.format(c)} AS {c}' for c in _PRICE_COLUMNS)}) FROM book_odds),
        x AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in x.items())} FROM o),
        y AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in fam.items())} FROM x),
        t AS (SELECT *, {', '.join(f'list_median({k}) AS {k}med' for k in 'ldvr')} FROM y)
        SELECT game_id, {', '.join(f'round({e}, 7) AS odds_{n}' for n, e in out.items())}, round(list_median(l), 7) AS close_total_consensus FROM t"""
    return sql, names


_BLOCK_SQL, _BLOCK_NAMES = _block_sql()


@query("r4_odds_block", _BLOCK_SQL, "book_odds")
def r4(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds")
    odds = odds.withColumns({c: O.american_to_decimal(F.col(c)) for c in _PRICE_COLUMNS})
    out = M.odds_block(odds)
    return rounded(out.select("game_id", *[f"odds_{n}" for n in _BLOCK_NAMES], "close_total_consensus"), 7)


def _formed(spark, sf_dir):
    """Paired games with windowed line and score columns on both sides."""
    from priorline.operators import windows as W

    keys = W.SeriesKeys("team_id", "season", "home", ("game_date", "game_id"))
    rows = standin(spark, sf_dir, "team_games").select("game_id", "game_date", "season", "home", "team_id", "pts", "total_line", "minutes")
    rows = rows.withColumnRenamed("total_line", "total_line_alpha")
    rows = W.prior_means(rows, keys, ["pts", "total_line_alpha"], [5])
    rows = W.rest_days(rows, ["team_id", "season"], keys.order, "game_date")
    return G.pair_sides(rows, ["game_id", "game_date", "season"], "home", check=False)


_FORMED_SQL = """f AS (SELECT game_id, home, team_id, avg(pts) OVER w AS p5, avg(total_line) OVER w AS l5,
      coalesce(date_diff('day', lag(game_date) OVER (PARTITION BY team_id, season ORDER BY game_date, game_id), game_date), 0) AS rest
      FROM team_games WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    p AS (SELECT h.game_id, h.p5 AS hp, a.p5 AS ap, h.l5 AS hl, a.l5 AS al, h.rest AS hr, a.rest AS ar, h.team_id AS ht, a.team_id AS at FROM f h JOIN f a ON h.game_id = a.game_id AND h.home AND NOT a.home)"""


@query("c2_betting_differences", f"WITH {_FORMED_SQL} SELECT game_id, round(hl - al, 6) AS total_line_alpha_last_all_5_diff_before FROM p", "team_games")
def c2(spark, sf_dir):
    out = C.betting_differences(_formed(spark, sf_dir))
    return rounded(out.select("game_id", "total_line_alpha_last_all_5_diff_before"))


@query(
    "c3_same_conference",
    """WITH d AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS conf FROM nation)
        SELECT game_id, CAST(coalesce(h.conf = a.conf, FALSE) AS INTEGER) AS same_conference_before, CAST(coalesce(h.n_name = a.n_name, FALSE) AS INTEGER) AS same_division_before
        FROM games LEFT JOIN d h ON h.n_nationkey = home_team % 25 LEFT JOIN d a ON a.n_nationkey = away_team % 25""",
    "games",
)
def c3(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS team_key", "CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS conference", "n_name AS division")
    games = standin(spark, sf_dir, "games").selectExpr("game_id", "CAST(home_team % 25 AS INT) AS home_key", "CAST(away_team % 25 AS INT) AS away_key")
    return composites.same_group_flags(games, dim, "team_key", "home_key", "away_key", ["conference", "division"]).drop("home_key", "away_key")


@query(
    "c4_sums_and_back_to_back",
    f"WITH {_FORMED_SQL} SELECT game_id, round(hp + ap, 6) AS pts_last_all_5_sum_before, CAST(hr <= 1 AND ar <= 1 AS INTEGER) AS back_to_back_before, round(hp - al, 6) AS home_off_minus_away_def_before, round(ap - hl, 6) AS away_off_minus_home_def_before FROM p",
    "team_games",
)
def c4(spark, sf_dir):
    out = composites.form_sums(_formed(spark, sf_dir), sums=["pts_last_all_5_before"], rest="rest_days_before", offence="pts_last_all_5_before", defence="total_line_alpha_last_all_5_before")
    return rounded(out.select("game_id", "pts_last_all_5_sum_before", "back_to_back_before", "home_off_minus_away_def_before", "away_off_minus_home_def_before"))


@query(
    "c5_high_value",
    f"""WITH {_FORMED_SQL}, s AS (SELECT game_id, home, stddev_pop(pts) OVER (PARTITION BY team_id, season, home ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd FROM team_games)
        SELECT game_id, round(total_line / 2 - spread_home / 2, 6) AS implied_pts_home_before, round(total_line / 2 + spread_home / 2, 6) AS implied_pts_away_before,
          round((hp - hl) / nullif(ap, 0), 6) AS pts_form_z_home_before, CAST(hr - ar AS INTEGER) AS rest_days_diff_before, round(hp * hl, 4) AS efficiency_home_before FROM p JOIN games USING (game_id)""",
    "team_games",
)
def c5(spark, sf_dir):
    games = standin(spark, sf_dir, "games").select("game_id", "total_line", "spread_home")
    wide = _formed(spark, sf_dir).join(games, "game_id").withColumnsRenamed({"pts_last_all_5_before_home": "recent_home", "total_line_alpha_last_all_5_before_home": "season_home", "pts_last_all_5_before_away": "std_home"})
    out = composites.high_value_block(
        wide, line="total_line", spread="spread_home", form={"home": ("recent_home", "season_home", "std_home"), "away": ("recent_away", "x", "y")},
        rest=("rest_days_before_home", "rest_days_before_away"), products={"efficiency_home": ("recent_home", "season_home")},
    )
    out = out.withColumn("efficiency_home_before", F.round("efficiency_home_before", 4))
    return rounded(out.select("game_id", "implied_pts_home_before", "implied_pts_away_before", "pts_form_z_home_before", "rest_days_diff_before", "efficiency_home_before"))


@query(
    "c6_star_ratio_and_gap",
    """SELECT game_id, round(home_pts / nullif(home_pts + away_pts, 0), 6) AS star_share_home_before, round(away_pts / nullif(home_pts + away_pts, 0), 6) AS star_share_away_before,
        round(total_line / 2 - home_pts, 6) AS conceded_gap_home_before, CAST(season_kind = '4' AS INTEGER) AS is_playoff, home_pts + away_pts AS total_points FROM games""",
    "games",
)
def c6(spark, sf_dir):
    games = standin(spark, sf_dir, "games").withColumn("team_pts", F.col("home_pts") + F.col("away_pts")).withColumn("expected", F.col("total_line") / 2)
    out = composites.star_and_gap(games, stars={"home": ("home_pts", "team_pts"), "away": ("away_pts", "team_pts")}, gaps={"home": ("expected", "home_pts")}, kind="season_kind", playoff="4", points=("home_pts", "away_pts"))
    return rounded(out.select("game_id", "star_share_home_before", "star_share_away_before", "conceded_gap_home_before", "is_playoff", "total_points"))


@query(
    "c13_standard_odds",
    """SELECT game_date, home_team, away_team, total_line, spread_home, -spread_home AS spread_away, home_pts AS moneyline_home, away_pts AS moneyline_away FROM games
        QUALIFY row_number() OVER (PARTITION BY game_date, home_team, away_team ORDER BY game_id) = 1""",
    "games",
)
def c13(spark, sf_dir):
    odds = standin(spark, sf_dir, "games").selectExpr(
        "game_id", "game_date", "home_team", "away_team", "total_line AS average_total_line", "home_pts AS average_moneyline_home", "away_pts AS average_moneyline_away", "spread_home AS average_spread_home"
    )
    return M.standard_odds(odds, "average", "game_date", "home_team", "away_team", [F.col("game_id").asc()])
