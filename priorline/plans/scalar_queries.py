"""X and R: scalar functions and cross-column statistics."""

from pyspark.sql import functions as F

from priorline.functions import dates as D
from priorline.functions import odds as O
from priorline.functions import reports
from priorline.functions import rowstats as R
from priorline.functions import text as T
from priorline.operators import market
from priorline.operators.travel import haversine_km
from priorline.plans.registry import query
from priorline.plans.standins import rounded, standin, table

_DEC = "CASE WHEN {0} > 0 THEN 1 + {0} / 100.0 WHEN {0} < 0 THEN 1 + 100.0 / abs({0}) END"
_OVER, _UNDER = _DEC.format("total_alpha_price_over"), _DEC.format("total_alpha_price_under")


@query("x1_american_to_decimal", f"SELECT game_id, round({_DEC.format('(cents % 401 - 200)')}, 6) AS price FROM games", "games")
def x1(spark, sf_dir):
    odds = (F.col("cents") % 401 - 200).cast("double")
    return rounded(standin(spark, sf_dir, "games").select("game_id", O.american_to_decimal(odds).alias("price")))


@query(
    "x2_mixed_to_decimal",
    f"""SELECT game_id, round(CASE WHEN d > 1 THEN d END, 6) AS price FROM (SELECT game_id, CASE WHEN abs(o) >= 100 THEN {_DEC.format('o')} ELSE o END AS d
        FROM (SELECT game_id, CAST(cents % 401 - 200 AS DOUBLE) / (1 + cents % 2 * 99) AS o FROM games))""",
    "games",
)
def x2(spark, sf_dir):
    odds = (F.col("cents") % 401 - 200).cast("double") / (1 + F.col("cents") % 2 * 99)
    return rounded(standin(spark, sf_dir, "games").select("game_id", O.mixed_to_decimal(odds).alias("price")))


def _prices(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds").select("game_id", "total_alpha_price_over", "total_alpha_price_under")
    return odds.select(
        "game_id",
        O.american_to_decimal(F.col("total_alpha_price_over")).alias("a"),
        O.american_to_decimal(F.col("total_alpha_price_under")).alias("b"),
    )


@query("x3_implied_probability", f"SELECT game_id, round(1 / ({_OVER}), 6) AS p_over FROM book_odds", "book_odds")
def x3(spark, sf_dir):
    return rounded(_prices(spark, sf_dir).select("game_id", O.implied_probability(F.col("a")).alias("p_over")))


@query(
    "x4_no_vig",
    f"""SELECT game_id, round(p / (p + q), 6) AS p_over, round(p + q - 1, 6) AS vig, round((p - q) / (p + q), 6) AS prob_diff
        FROM (SELECT game_id, 1 / ({_OVER}) AS p, 1 / ({_UNDER}) AS q FROM book_odds)""",
    "book_odds",
)
def x4(spark, sf_dir):
    p, q = O.implied_probability(F.col("a")), O.implied_probability(F.col("b"))
    return rounded(
        _prices(spark, sf_dir).select(
            "game_id", O.no_vig(p, q).alias("p_over"), O.vig(p, q).alias("vig"), (O.no_vig(p, q) - O.no_vig(q, p)).alias("prob_diff")
        )
    )


@query("x5_log_price_ratio", f"SELECT game_id, round(ln(({_OVER}) / ({_UNDER})), 6) AS ratio FROM book_odds", "book_odds")
def x5(spark, sf_dir):
    return rounded(_prices(spark, sf_dir).select("game_id", O.log_price_ratio(F.col("a"), F.col("b")).alias("ratio")))


@query(
    "x6_haversine",
    """SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(power(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b))
        * power(sin(radians(d - c) / 2), 2))), 3) AS km FROM (SELECT c_custkey, CAST(c_custkey % 60 AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b,
        CAST(c_custkey % 170 AS DOUBLE) AS c, CAST(-c_nationkey * 3 AS DOUBLE) AS d FROM customer)""",
)
def x6(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    km = haversine_km((key % 60).cast("double"), (key % 170).cast("double"), nation.cast("double"), (-nation * 3).cast("double"))
    return rounded(c.select("c_custkey", km.alias("km")), 3)


@query("x7_log1p", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS scaled FROM customer")
def x7(spark, sf_dir):
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", F.log1p(F.greatest("c_acctbal", F.lit(0.0))).alias("scaled")))


@query(
    "x8_overtime_scaling",
    """SELECT game_id, team_id, CAST(minutes >= 259 AS INTEGER) AS is_overtime, CAST(round_even(CASE WHEN minutes >= 260 THEN pts * 240 / minutes ELSE pts END, 0) AS BIGINT) AS pts
        FROM team_games""",
    "team_games",
)
def x8(spark, sf_dir):
    rows = standin(spark, sf_dir, "team_games").withColumn("pts", F.col("pts").cast("long"))
    return market.adjust_overtime(rows, "minutes", ["pts"]).select("game_id", "team_id", "is_overtime", "pts")


_CLOCK = "CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN CAST(CAST(l_quantity AS INTEGER) AS {t}) WHEN 4 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS {t}), ':x') ELSE concat(CAST(CAST(l_quantity AS INTEGER) AS {t}), ':', CAST(l_partkey % 60 AS {t})) END"


@query(
    "x9_minutes",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate AS shipped, round(CASE WHEN t LIKE '%:%' THEN coalesce(TRY_CAST(split_part(t, ':', 1) AS DOUBLE) + TRY_CAST(split_part(t, ':', 2) AS INTEGER) / 60.0, 0)
        ELSE coalesce(TRY_CAST(t AS DOUBLE), 0) END, 6) AS minutes FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, {_CLOCK.format(t='VARCHAR')} AS t FROM lineitem)""",
)
def x9(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS shipped", f"{_CLOCK.format(t='string')} AS t"
    )
    return rounded(rows.select("l_orderkey", "l_partkey", "l_linenumber", "shipped", T.minutes(F.col("t")).alias("minutes")))


_TYPE_SQL = "CASE substr(g, 1, 3) WHEN '001' THEN 'Preseason' WHEN '002' THEN 'Regular Season' WHEN '003' THEN 'All Star' WHEN '004' THEN 'Playoffs' WHEN '005' THEN '{}' WHEN '006' THEN 'In-Season Final Game' ELSE 'Unknown' END"


@query(
    "x10_season_type",
    f"SELECT o_orderkey, {_TYPE_SQL.format('Playoffs')} AS kind, {_TYPE_SQL.format('Play-In Tournament')} AS kind_play_in FROM (SELECT o_orderkey, concat('00', CAST(o_orderkey % 8 AS VARCHAR), CAST(o_orderkey AS VARCHAR)) AS g FROM orders)",
)
def x10(spark, sf_dir):
    key = F.col("o_orderkey")
    game = F.concat(F.lit("00"), (key % 8).cast("string"), key.cast("string"))
    return table(spark, sf_dir, "orders").select(key, D.season_type(game).alias("kind"), D.season_type(game, play_in=True).alias("kind_play_in"))


def _season_sql(last):
    return f"CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= {last} THEN 1 ELSE 0 END AS INTEGER)"


@query(
    "x11_season_year",
    f"""SELECT o_orderkey, {_season_sql(7)} AS july, {_season_sql(6)} AS june, {_season_sql(8)} AS august,
        {_season_sql('CASE WHEN year(o_orderdate) = 2020 THEN 10 ELSE 7 END')} AS july_2020_october FROM (SELECT o_orderkey, o_orderdate + INTERVAL 22 YEAR AS o_orderdate FROM orders)""",
)
def x11(spark, sf_dir):
    date = F.add_months(F.to_date("o_orderdate"), 22 * 12)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[D.season_year(date, r).alias(r) for r in ("july", "june", "august", "july_2020_october")])


_JUNE = "(year({0}) - CASE WHEN month({0}) <= 6 THEN 1 ELSE 0 END)"


@query(
    "x12_season_labels",
    f"""SELECT o_orderkey, list_aggregate(list_transform(range({_JUNE.format('d')}, {_JUNE.format('e')} + 1), lambda y: printf('%d-%02d', y, (y + 1) % 100)), 'string_agg', ',') AS labels,
        make_date(CAST({_JUNE.format('d')} - 1 AS INTEGER), 10, 1) AS start_two_back FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate + INTERVAL 900 DAY AS DATE) AS e FROM orders)""",
)
def x12(spark, sf_dir):
    date = F.to_date("o_orderdate")
    labels = F.array_join(D.seasons_between(date, F.date_add(date, 900)), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.alias("labels"), D.season_start(date, 2).alias("start_two_back"))


@query(
    "x13_season_ids",
    """SELECT o_orderkey, concat('2', CAST(year(o_orderdate) AS VARCHAR)) AS season_id, CAST(year(o_orderdate) AS INTEGER) AS back,
        CAST(CASE WHEN length(regexp_replace(o_orderpriority, '\\D', '', 'g')) >= 4 THEN 1 END AS INTEGER) AS from_text FROM orders""",
)
def x13(spark, sf_dir):
    made = D.season_id("2", F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", made.alias("season_id"), D.year_of_season_id(made).alias("back"), D.year_of_season_id(F.col("o_orderpriority")).alias("from_text")
    )


_NTH = "make_date(CAST(y AS INTEGER), {m}, 1) + CAST((({wd} - (isodow(make_date(CAST(y AS INTEGER), {m}, 1)) - 1)) % 7 + 7) % 7 + {off} AS INTEGER)"


def _fixed_day(m, d):
    date = f"make_date(CAST(y AS INTEGER), {m}, {d})"
    return f"{date} + CASE isodow({date}) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END"


_HOLIDAYS = [
    _fixed_day(1, 1),
    f"CASE WHEN y >= 1986 THEN {_NTH.format(m=1, wd=0, off=14)} END",
    _NTH.format(m=2, wd=0, off=14),
    "make_date(CAST(y AS INTEGER), 5, 31) - CAST(isodow(make_date(CAST(y AS INTEGER), 5, 31)) - 1 AS INTEGER)",
    f"CASE WHEN y >= 2021 THEN {_fixed_day(6, 19)} END",
    _fixed_day(7, 4),
    _NTH.format(m=9, wd=0, off=0),
    _NTH.format(m=10, wd=0, off=7),
    _fixed_day(11, 11),
    _NTH.format(m=11, wd=3, off=21),
    _fixed_day(12, 25),
]


@query(
    "x14_date_features",
    f"""WITH h AS (SELECT DISTINCT UNNEST([{', '.join(_HOLIDAYS)}]) AS hd FROM (SELECT UNNEST(range(1990, 2010)) AS y))
        SELECT game_id, CAST(isodow(game_date) >= 6 AS INTEGER) AS is_weekend_before, CAST(month(game_date) AS INTEGER) AS month_before,
          CAST(hd IS NOT NULL AS INTEGER) AS is_us_holiday_before FROM games LEFT JOIN h ON hd = game_date""",
    "games",
)
def x14(spark, sf_dir):
    games = standin(spark, sf_dir, "games").select("game_id", "game_date")
    return D.date_features(games, "game_date").drop("game_date")


@query(
    "x15_local_day",
    """SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS local_day,
        strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid', '%Y-%m-%d %H:%M') AS madrid,
        CAST(ts AS DATE) - CASE WHEN hour(ts) < 6 THEN 1 ELSE 0 END AS betting_day FROM events""",
)
def x15(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", D.local_day(ts).alias("local_day"), D.local_text(ts, "Europe/Madrid", "yyyy-MM-dd HH:mm").alias("madrid"), D.betting_day(ts).alias("betting_day")
    )


@query(
    "x15_eastern_start",
    """SELECT o_orderkey, strftime(((CAST(o_orderdate AS DATE) + to_hours(CASE WHEN h = 12 THEN 12 ELSE h + 12 END) + to_minutes(30)) AT TIME ZONE 'US/Eastern') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS start_utc
        FROM (SELECT o_orderkey, o_orderdate, 1 + o_orderkey % 12 AS h FROM orders)""",
)
def x15_start(spark, sf_dir):
    text = F.concat((1 + F.col("o_orderkey") % 12).cast("string"), F.lit(":30 pm ET"))
    start = D.eastern_start(F.to_date("o_orderdate"), text)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(start, "yyyy-MM-dd HH:mm").alias("start_utc"))


@query(
    "x16_minutes_to_start",
    """SELECT event_id, coalesce(CAST(round_even((epoch(date_trunc('second', nxt)) - epoch(date_trunc('second', ts))) / 60, 0) AS BIGINT), 0) AS minutes
        FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)""",
)
def x16(spark, sf_dir):
    from priorline.skew import bounded_frames

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumns({"back": -F.unix_micros("ts"), "back_id": -F.col("event_id")})
    nxt = bounded_frames(rows, ["user_id"], ["back", "back_id"], 1, lambda w: [F.lag("ts").over(w).alias("nxt")])
    return nxt.select("event_id", D.minutes_to_start(F.col("ts"), F.col("nxt")).alias("minutes"))


@query(
    "x17_canonical_name",
    "SELECT game_id, official_id, trim(regexp_replace(replace(regexp_replace(raw_name, '\\(#\\d+\\)', '', 'g'), '.', ' '), '\\s+', ' ', 'g')) AS name FROM officials",
    "officials",
)
def x17(spark, sf_dir):
    rows = standin(spark, sf_dir, "officials")
    return rows.select("game_id", "official_id", T.canonical_name(F.col("raw_name")).alias("name"))


@query(
    "x18_names",
    """SELECT p_partkey, concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) AS first_last, split_part(p_name, ' ', 1) AS away, split_part(p_name, ' ', 2) AS home FROM part""",
)
def x18(spark, sf_dir):
    away, home = T.matchup_sides(F.regexp_replace("p_name", " ", " @ "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.first_last(F.regexp_replace("p_name", " ", ", ")).alias("first_last"), away.alias("away"), home.alias("home")
    )


@query(
    "x19_slug_and_pick",
    """SELECT o_orderkey, nullif(trim(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '_'), '') AS slug,
        CASE o_orderstatus WHEN 'O' THEN 'OVER' END AS pick, CASE WHEN o_orderkey % 3 = 1 THEN 'OVER' WHEN o_orderkey % 3 = 0 THEN 'UNDER' END AS pick_number FROM orders""",
)
def x19(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.slug(F.col("o_orderpriority")).alias("slug"),
        T.normal_pick(F.lower("o_orderstatus")).alias("pick"),
        T.normal_pick((F.col("o_orderkey") % 3).cast("string")).alias("pick_number"),
    )


@query(
    "x20_coerce_number",
    "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS lead_number, TRY_CAST(o_orderpriority AS DOUBLE) AS whole FROM orders",
)
def x20(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", O.number(F.split("o_orderpriority", "-")[0]).alias("lead_number"), O.number(F.col("o_orderpriority")).alias("whole")
    )


@query(
    "x21_safe_divide",
    """SELECT game_id, round(home_pts / nullif(spread_home, 0), 6) AS ratio, round((home_pts - away_pts) / nullif(spread_home, 0), 6) AS z FROM games""",
    "games",
)
def x21(spark, sf_dir):
    h, a, s = F.col("home_pts"), F.col("away_pts"), F.col("spread_home")
    return rounded(standin(spark, sf_dir, "games").select("game_id", O.safe_divide(h, s).alias("ratio"), O.z_score(h, a, s).alias("z")))


@query(
    "x22_json_lines",
    """SELECT event_id, CAST(abs(v) AS DOUBLE) AS total_line, concat('home_', CAST(user_id AS VARCHAR)) AS team_home, concat('away_', CAST(user_id AS VARCHAR)) AS team_away
        FROM (SELECT event_id, user_id, 60 + CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events) WHERE v >= 100""",
)
def x22(spark, sf_dir):
    from priorline.sources.landed import parse_events

    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    body = F.expr(
        """to_json(named_struct('teams', array(
            named_struct('name', concat('home_', user_id), 'is_home', true, 'is_away', false),
            named_struct('name', concat('away_', user_id), 'is_home', false, 'is_away', true)),
          'lines', map('22', named_struct('total', named_struct('total_over_delta', -(60.0D + k))))))"""
    )
    parsed = parse_events(rows.select("event_id", body.alias("body")), "body", book="22")
    return parsed.select("event_id", "total_line", "team_home", "team_away")


@query(
    "x23_contributions",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'a:b' ELSE 'disc' END AS feature, round(l_discount, 2) AS value FROM lineitem
        UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, 'tax', -round(l_tax, 2) FROM lineitem""",
)
def x23(spark, sf_dir):
    # One part lacks a colon and one has no number: both must be skipped.
    text = F.format_string(
        "%s:%+.2f,broken,tax:%+.2f,none:x", F.when(F.col("l_linenumber") % 2 == 0, "a:b").otherwise("disc"), F.col("l_discount"), -F.col("l_tax")
    )
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.explode(T.contribution_pairs(text)).alias("p"))
    return rounded(pairs.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "p.feature", "p.value"), 2)


# Report blocks built from orders: a full first row per document, then rows that lean on it ('~' is a line break).
_BLOCKS = """SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE o_orderpriority
    WHEN '1-URGENT' THEN concat(date_format(o_orderdate, 'MM/dd/yyyy'), '~07:30 (ET)~ABC@XYZ~New Yorkers~Doe, John~Out~Injury/Illness')
    WHEN '2-HIGH' THEN concat('Roe, Jane~', CASE o_orderstatus WHEN 'F' THEN 'Out' ELSE 'Questionable' END, '~Rest')
    WHEN '3-MEDIUM' THEN 'Foe, Jim~Probable'
    WHEN '4-NOT SPECIFIED' THEN 'South Town~NOT YET SUBMITTED'
    ELSE 'Injury - left~knee' END AS body FROM {orders}"""


@query("x24_report_rows")
def x24(spark, sf_dir):
    blocks = spark.sql(_BLOCKS, orders=table(spark, sf_dir, "orders")).withColumn("body", F.translate("body", "~", "\n"))
    return reports.report_rows(blocks, "doc_id", "line_no", "body")


@query(
    "x25_merge_metadata",
    """SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size > 40 THEN p_brand END), ''), nullif(trim(CASE WHEN p_size > 10 THEN p_type END), ''), 'unknown') AS source,
        concat_ws('|', p_brand, CASE WHEN p_size > 20 THEN p_type END, CAST(p_partkey AS VARCHAR)) AS run_id FROM part""",
)
def x25(spark, sf_dir):
    brand, kind = F.when(F.col("p_size") > 40, F.col("p_brand")), F.when(F.col("p_size") > 10, F.col("p_type"))
    label = T.run_label(F.col("p_brand"), F.when(F.col("p_size") > 20, F.col("p_type")), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.first_known(brand, kind).alias("source"), label.alias("run_id"))


@query(
    "x26_history_cutoff",
    "SELECT game_id FROM games WHERE game_date <= (SELECT max(game_date) - 1 FROM games WHERE season_kind = '4')",
    "games",
)
def x26(spark, sf_dir):
    games = standin(spark, sf_dir, "games")
    cutoff = D.history_cutoff(games.filter("season_kind = '4'"), "game_date", F.current_date())
    return games.filter(F.col("game_date") <= cutoff).select("game_id")


@query(
    "x27_game_date_utc",
    """SELECT game_id, strftime((CAST(game_date AS TIMESTAMP) AT TIME ZONE 'US/Pacific') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS game_utc, season FROM games""",
    "games",
)
def x27(spark, sf_dir):
    utc = D.midnight_utc(F.col("game_date"), "US/Pacific")
    return standin(spark, sf_dir, "games").select("game_id", F.date_format(utc, "yyyy-MM-dd HH:mm").alias("game_utc"), "season")


@query(
    "w28_fill_forward",
    "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM events",
)
def w28(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("value")).alias("mark"))
    return reports.fill_forward(rows, ["user_id"], ["ts", "event_id"], ["mark"]).select("event_id", "mark")


BOOKS = ["total_line_alpha", "total_line_bravo", "total_line_delta", "total_line_consensus_opener"]
_LIST = f"list_filter([{', '.join(BOOKS)}], lambda x: x IS NOT NULL)"


@query(
    "r1_mean_std_range",
    f"SELECT game_id, round(list_avg(x), 6) AS mean, round(list_stddev_pop(x), 5) AS std, list_max(x) - list_min(x) AS spread FROM (SELECT game_id, {_LIST} AS x FROM book_odds)",
    "book_odds",
)
def r1(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds")
    return rounded(odds.select("game_id", R.row_mean(BOOKS).alias("mean"), F.round(R.row_std(BOOKS), 5).alias("std"), R.row_range(BOOKS).alias("spread")))


@query(
    "r2_iqr",
    f"SELECT game_id, round(list_aggregate(x, 'quantile_cont', 0.75) - list_aggregate(x, 'quantile_cont', 0.25), 6) AS iqr FROM (SELECT game_id, {_LIST} AS x FROM book_odds)",
    "book_odds",
)
def r2(spark, sf_dir):
    return rounded(standin(spark, sf_dir, "book_odds").select("game_id", R.row_iqr(BOOKS).alias("iqr")))


@query(
    "r3_mad",
    f"SELECT game_id, round(list_median(list_transform(x, lambda v: abs(v - m))), 6) AS mad FROM (SELECT game_id, x, list_median(x) AS m FROM (SELECT game_id, {_LIST} AS x FROM book_odds))",
    "book_odds",
)
def r3(spark, sf_dir):
    return rounded(standin(spark, sf_dir, "book_odds").select("game_id", R.row_mad(BOOKS).alias("mad")))


@query(
    "r5_crossbook",
    f"SELECT game_id, round(list_stddev_pop({_LIST}), 5) AS crossbook_std, list_max({_LIST}) - list_min({_LIST}) AS crossbook_range FROM book_odds",
    "book_odds",
)
def r5(spark, sf_dir):
    return rounded(standin(spark, sf_dir, "book_odds").select("game_id", R.row_std(BOOKS).alias("crossbook_std"), R.row_range(BOOKS).alias("crossbook_range")), 5)


@query(
    "r6_mean_max_abs",
    f"SELECT game_id, round(list_avg(x), 6) AS mean, list_max(list_transform(x, lambda v: abs(v))) AS max_abs FROM (SELECT game_id, {_LIST.replace('total_line_alpha', 'spread_home_neg')} AS x FROM (SELECT *, spread_alpha_line_home * 30 AS spread_home_neg FROM book_odds))",
    "book_odds",
)
def r6(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds").withColumn("s", F.col("spread_alpha_line_home") * 30)
    family = ["s", *BOOKS[1:]]
    return rounded(odds.select("game_id", R.row_mean(family).alias("mean"), R.row_max_abs(family).alias("max_abs")))


@query(
    "r7_row_votes",
    f"""SELECT game_id, CAST(4 - len({_LIST}) AS INTEGER) AS n_null, len({_LIST}) = 4 AS all_present, len(list_distinct({_LIST})) = 1 AS agree,
        CASE WHEN list_max(a) = a[1] THEN 'total_line_alpha' WHEN list_max(a) = a[2] THEN 'total_line_bravo' WHEN list_max(a) = a[3] THEN 'total_line_delta'
          WHEN list_max(a) = a[4] THEN 'total_line_consensus_opener' END AS boldest,
        CAST(len(list_filter(p, lambda x: x = 'OVER')) AS INTEGER) AS n_over
        FROM (SELECT *, [abs(total_line_alpha), abs(total_line_bravo), abs(total_line_delta), abs(total_line_consensus_opener)] AS a,
          [CASE WHEN total_line_alpha > total_points THEN 'OVER' END, CASE WHEN total_line_bravo > total_points THEN 'OVER' END] AS p FROM book_odds)""",
    "book_odds",
)
def r7(spark, sf_dir):
    odds = standin(spark, sf_dir, "book_odds")
    odds = odds.withColumns({f"p{i}": F.when(F.col(b) > F.col("total_points"), "OVER") for i, b in enumerate(BOOKS[:2])})
    return odds.select(
        "game_id",
        R.row_nulls(BOOKS).alias("n_null"),
        R.all_present(BOOKS).alias("all_present"),
        R.all_agree(BOOKS).alias("agree"),
        R.largest_abs_column(BOOKS).alias("boldest"),
        R.votes(["p0", "p1"], "OVER").alias("n_over"),
    )
