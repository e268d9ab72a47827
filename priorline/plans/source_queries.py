"""S and Z: scans, file sources, sinks and the streaming ingest.

Queries that need files first write them from the given tables to the job's shared folder.
"""

from functools import reduce

from pyspark.sql import functions as F

from priorline.functions import dates as D
from priorline.plans.registry import query
from priorline.plans.standins import rounded, standin, table
from priorline.session import cut_lineage, work_folder
from priorline.sources import files, landed, scans, sinks
from priorline.sources.versions import VersionedTable
from priorline.streaming import ingest


def _games(spark, sf_dir):
    return standin(spark, sf_dir, "games")


@query("s1_season_or_ids", "SELECT game_id, season FROM games WHERE season IN (1997, 1999) OR game_id IN (5, 6, 7)", "games")
def s1(spark, sf_dir):
    return scans.newest_first(scans.season_or_ids(_games(spark, sf_dir), "season", [1997, 1999], "game_id", [5, 6, 7]), "game_date", "game_id").select("game_id", "season")


@query("s2_player_scan", "SELECT game_id, player_id FROM appearances WHERE season = 1998 OR game_id IN (5, 6, 7)", "appearances")
def s2(spark, sf_dir):
    return scans.season_or_ids(standin(spark, sf_dir, "appearances"), "season", [1998], "game_id", [5, 6, 7]).select("game_id", "player_id")


@query(
    "s3_absence_scan",
    'SELECT DISTINCT CAST(game_id AS VARCHAR) AS "GAME_ID", CAST(player_id AS VARCHAR) AS "PLAYER_ID", season AS "SEASON" FROM appearances WHERE listed AND season IN (1998, 2000)',
    "appearances",
)
def s3(spark, sf_dir):
    rows = standin(spark, sf_dir, "appearances").filter("listed").select("game_id", "player_id", "season")
    return scans.upper_names(scans.season_or_ids(rows, "season", [1998, 2000], "game_id"), ["game_id", "player_id"], ["game_id", "player_id"])


@query("s4_referee_scan", "SELECT DISTINCT o.game_id, official_id FROM officials o JOIN games USING (game_id) WHERE season = 1996 OR game_id IN (9, 10)", "officials games")
def s4(spark, sf_dir):
    rows = standin(spark, sf_dir, "officials").join(_games(spark, sf_dir).select("game_id", "season"), "game_id")
    return scans.season_or_ids(rows, "season", [1996], "game_id", [9, 10]).select("game_id", "official_id").distinct()


@query("s5_odds_scan", "SELECT game_id, total_line_alpha FROM book_odds WHERE season = 1999", "book_odds")
def s5(spark, sf_dir):
    return scans.season_or_ids(standin(spark, sf_dir, "book_odds"), "season", [1999], "game_id").select("game_id", "total_line_alpha")


@query(
    "s6_aggregate_odds_scan",
    "SELECT game_id, TRY_CAST(CASE WHEN cents % 5 = 0 THEN 'n/a' ELSE CAST(total_line AS VARCHAR) END AS DOUBLE) AS average_total_line FROM games WHERE season = 2000",
    "games",
)
def s6(spark, sf_dir):
    text = F.when(F.col("cents") % 5 == 0, "n/a").otherwise(F.col("total_line").cast("string"))
    rows = _games(spark, sf_dir).withColumn("average_total_line", text)
    return scans.coerce_numbers(scans.season_or_ids(rows, "season", [2000], "game_id"), ["average_total_line"]).select("game_id", "average_total_line")


@query("s7_seasons_scan", "SELECT game_id FROM games WHERE season IN (1995, 1996, 1997)", "games")
def s7(spark, sf_dir):
    return scans.season_or_ids(_games(spark, sf_dir), "season", [1995, 1996, 1997], "game_id").select("game_id")


@query(
    "s8_season_csvs",
    "SELECT CAST(game_id AS VARCHAR) AS \"GAME_ID\", CAST(CAST(home_pts AS BIGINT) AS VARCHAR) AS \"TOV\", CASE WHEN season >= 1999 THEN CAST(CAST(away_pts AS BIGINT) AS VARCHAR) END AS \"PACE\", season AS \"SEASON_YEAR\" FROM games",
    "games",
)
def s8(spark, sf_dir):
    root = work_folder(spark, "season-csvs")
    games = _games(spark, sf_dir).select(
        F.col("game_id").alias("GAME_ID"), F.col("home_pts").cast("long").alias("TO"), F.col("away_pts").cast("long").alias("PACE"), "season", F.lit("x").alias("teamName")
    )
    # One folder of parts per season, named as the files are; early seasons lack a column, as older files do.
    label = F.concat(F.lit("team_games_"), "season", F.lit("_"), F.lpad((F.col("season") + 1) % 100, 2, "0"), F.lit(".csv"))
    games = games.withColumn("file", label)
    for rows, columns in ((games.filter("season < 1999"), ["GAME_ID", "TO", "teamName"]), (games.filter("season >= 1999"), ["GAME_ID", "TO", "PACE", "teamName"])):
        rows.select(*columns, "file").write.mode("append").partitionBy("file").csv(root, header=True)  # a season's parts come from every task
    return files.read_season_csvs(spark, root, "team_games", {"TO": "TOV"}, drop_lower_case=True)


@query(
    "s9_daily_markets",
    "SELECT CAST(date_trunc('month', game_date) AS DATE) AS file_day, game_id, total_line, spread_home, home_pts AS price FROM games WHERE month(game_date) NOT IN (3, 8)",
    "games",
)
def s9(spark, sf_dir):
    root = work_folder(spark, "daily-markets")
    # One file per market and month start, holding every game of the month; two months lack the third market.
    games = _games(spark, sf_dir).withColumn("file_day", F.trunc("game_date", "month"))
    for folder, column in (("csv", "total_line"), ("csv_spread", "spread_home"), ("csv_moneyline", "home_pts")):
        rows = games if folder != "csv_moneyline" else games.filter("month(game_date) NOT IN (3, 8)")
        rows.select("file_day", "game_id", column).repartition("file_day").write.partitionBy("file_day").csv(f"{root}/{folder}", header=True)
    markets = {
        "csv": "game_id bigint, total_line double",
        "csv_spread": "game_id bigint, spread_home double",
        "csv_moneyline": "game_id bigint, price double",
    }
    return files.read_daily_markets(spark, root, markets, ["game_id"])


@query(
    "s10_csv_tree",
    "SELECT game_id, season, total_line FROM games WHERE total_line IS NOT NULL AND priority <> '5-LOW'",
    "games",
)
def s10(spark, sf_dir):
    root = work_folder(spark, "csv-tree")
    games = _games(spark, sf_dir).select("game_id", "season", "total_line", "priority", F.col("season").alias("folder"))
    games.unionByName(games.filter("game_id % 3 = 0")).write.partitionBy("folder").csv(root, header=True)
    rows = files.read_csv_tree(spark, root, "game_id bigint, season int, total_line double, priority string", ["total_line"], {"priority": "low"})
    return rows.drop("priority")


@query(
    "s11_event_files",
    "SELECT concat('home_', user_id) AS team_home, concat('away_', user_id) AS team_away, CAST(60 + CAST(json_extract(props, '$.k') AS BIGINT) AS DOUBLE) AS total_line, strftime(ts, '%Y-%m-%d') AS event_date FROM events WHERE 60 + CAST(json_extract(props, '$.k') AS BIGINT) >= 100",
)
def s11(spark, sf_dir):
    root = work_folder(spark, "event-files")
    body = """named_struct('event_date', date_format(ts, 'yyyy-MM-dd'),
        'teams', array(named_struct('name', concat('home_', user_id), 'is_home', true, 'is_away', false), named_struct('name', concat('away_', user_id), 'is_home', false, 'is_away', true)),
        'lines', map('22', named_struct('total', named_struct('total_over_delta', -(60.0D + CAST(get_json_object(props, '$.k') AS BIGINT))))))"""
    events = table(spark, sf_dir, "events").selectExpr("event_id div 500 AS chunk", f"{body} AS event")
    # One document per 500 events: a bare list in even ones, an object with "events" in odd ones.
    listed = events.groupBy("chunk").agg(F.to_json(F.collect_list("event")).alias("body"))
    wrapped = F.concat(F.lit('{"events":'), F.col("body"), F.lit("}"))
    text = listed.select(F.when(F.col("chunk") % 2 == 0, F.col("body")).otherwise(wrapped).alias("value"), "chunk")
    text.repartition("chunk").write.partitionBy("chunk").text(root)
    parsed = landed.parse_events(landed.read_event_files(spark, f"{root}/chunk=*/*.txt"), "body", "22")
    return parsed.select("team_home", "team_away", "total_line", "event_date")


@query("s12_parquet_frame", "SELECT game_id, season, total_line FROM games", "games")
def s12(spark, sf_dir):
    path = work_folder(spark, "frame")
    files.write_parquet(_games(spark, sf_dir).select("game_id", "season", "total_line"), path, ["season"])
    return scans.read_table(spark, path)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("s13_export", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _TABLES))
def s13(spark, sf_dir):
    root = work_folder(spark, "export")
    files.export_tables({n: table(spark, sf_dir, n) for n in _TABLES}, root, rows_per_file=5000)
    counts = [spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in _TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("s14_csv_sink", "SELECT p_partkey, p_name, p_retailprice FROM part")
def s14(spark, sf_dir):
    path = work_folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return spark.read.csv(path, header=True, schema="p_partkey bigint, p_name string, p_retailprice double")


@query(
    "s15_insert_if_absent",
    """SELECT game_id, season, 'first' AS source FROM games WHERE season <= 1998 UNION ALL SELECT game_id, season, 'second' FROM games WHERE season > 1998""",
    "games",
)
def s15(spark, sf_dir):
    path = work_folder(spark, "insert")
    games = _games(spark, sf_dir).select("game_id", "season")
    first = games.filter("season <= 1998").withColumn("source", F.lit("first"))
    second = games.filter("season >= 1997").withColumn("source", F.lit("second"))
    for batch in (first, second, second):
        sinks.insert_if_absent(batch.unionByName(batch), path, ["game_id"], [F.col("source").asc()], partition="season")
    return spark.read.parquet(path).select("game_id", "season", "source")


@query(
    "s16_upsert",
    "SELECT game_id, CASE WHEN season >= 1998 THEN total_line + 1 ELSE total_line END AS total_line FROM games WHERE season <= 1999 OR season >= 1998",
    "games",
)
def s16(spark, sf_dir):
    games = _games(spark, sf_dir).select("game_id", "season", "total_line")
    held = VersionedTable(spark, work_folder(spark, "odds"), ["game_id"])
    held.upsert(games.filter("season <= 1999"), [F.desc("total_line")], "first")
    second = games.filter("season >= 1998").withColumn("total_line", F.col("total_line") + 1)
    for _ in range(2):  # the second time is a replay
        held.upsert(second, [F.desc("total_line")], "second")
    return held.read().select("game_id", "total_line")


@query("s17_update_results", "SELECT game_id, CASE WHEN season = 2000 THEN home_pts + 1 ELSE home_pts END AS home_pts, away_pts FROM games", "games")
def s17(spark, sf_dir):
    games = _games(spark, sf_dir).select("game_id", "season", "home_pts", "away_pts")
    held = VersionedTable(spark, work_folder(spark, "results"), ["game_id"])
    held.upsert(games, [F.asc("season")])
    updates = games.filter("season = 2000").select("game_id", (F.col("home_pts") + 1).alias("home_pts"), F.lit(None).cast("double").alias("away_pts"))
    held.update(updates.unionByName(updates.withColumn("game_id", -F.col("game_id") - 1)), ["home_pts", "away_pts"], [F.asc("home_pts")])
    return held.read().drop("season")


@query(
    "s18_delete_keys",
    """WITH d AS (SELECT game_id FROM appearances GROUP BY 1 HAVING sum(coalesce(minutes, 0)) < 60)
        SELECT game_id, player_id, (SELECT count(*) FROM appearances WHERE game_id IN (SELECT game_id FROM d)) AS n_deleted FROM appearances WHERE game_id NOT IN (SELECT game_id FROM d)""",
    "appearances",
)
def s18(spark, sf_dir):
    rows = standin(spark, sf_dir, "appearances").select("game_id", "player_id", "minutes")
    held = VersionedTable(spark, work_folder(spark, "appearances"), ["game_id", "player_id"])
    held.upsert(rows, [F.asc("minutes")])
    stored = held.read()  # the appearances, which need not be worked out again
    low = stored.groupBy("game_id").agg(F.sum(F.coalesce("minutes", F.lit(0.0))).alias("m")).filter("m < 60")
    doomed = cut_lineage(stored.join(low, "game_id", "left_semi").select("game_id", "player_id"))
    preview = held.delete_preview(doomed)
    held.delete(doomed)
    return held.read().select("game_id", "player_id", F.lit(preview).cast("long").alias("n_deleted"))


@query("s19_recent", "SELECT game_id, game_date FROM games ORDER BY game_date DESC, game_id DESC LIMIT 25", "games")
def s19(spark, sf_dir):
    return scans.recent(_games(spark, sf_dir), 25, [F.desc("game_date"), F.desc("game_id")]).select("game_id", "game_date")


@query("s19_point", "SELECT game_id, total_line FROM games WHERE game_date = DATE '1998-03-02' AND season_kind = '4'", "games")
def s19_point(spark, sf_dir):
    import datetime

    return scans.point(_games(spark, sf_dir), {"game_date": datetime.date(1998, 3, 2), "season_kind": "4"}).select("game_id", "total_line")


@query("s20_prediction_scan", "SELECT game_id FROM games WHERE game_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND total_line IS NULL", "games")
def s20(spark, sf_dir):
    return scans.prediction_rows(_games(spark, sf_dir), "game_date", "1998-01-01", "1998-12-31", "total_line", False).select("game_id")


@query("s21_distinct_tags", "SELECT DISTINCT trim(o_orderpriority) AS tag FROM orders")
def s21(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(F.concat(F.lit(" "), "o_orderpriority"), F.lit("  "))).alias("tag"))
    return scans.distinct_tags(rows, "tag")


@query(
    "s22_fact_folder",
    "SELECT CAST(game_id AS VARCHAR) AS game_id, CAST(player_id AS VARCHAR) AS player_id, game_date, CAST(year(game_date) - CASE WHEN month(game_date) <= 7 THEN 1 ELSE 0 END AS INTEGER) AS season_year FROM appearances WHERE listed",
    "appearances",
)
def s22(spark, sf_dir):
    root = work_folder(spark, "facts")
    rows = standin(spark, sf_dir, "appearances").filter("listed").selectExpr("game_id AS GAME_ID", "concat(' ', player_id, ' ') AS PLAYER_ID", "game_date AS GAME_DATE", "concat('absences_', season, '.csv') AS file")
    rows.unionByName(rows.filter("GAME_ID % 2 = 0")).repartition("file").write.partitionBy("file").csv(root, header=True)
    out = files.read_fact_folder(spark, root, "absences", ["game_id", "player_id"], ["game_id", "player_id"], "game_date")
    return out.select("game_id", "player_id", "game_date", "season_year")


@query("s23_existing_ids", "SELECT DISTINCT game_id FROM scored WHERE season IN (1997, 1998)", "scored")
def s23(spark, sf_dir):
    return scans.existing_ids(standin(spark, sf_dir, "scored"), "game_id", "season", [1997, 1998])


_LANDED = "SELECT home_team, away_team, game_date, max(total_line) AS line FROM games GROUP BY 1, 2, 3"


def _landed(spark, sf_dir):
    return _games(spark, sf_dir).groupBy("home_team", "away_team", "game_date").agg(F.max("total_line").alias("line"))


@query("s24_build_and_load", f"SELECT g.game_id, l.line FROM ({_LANDED}) l JOIN games g USING (home_team, away_team, game_date)", "games")
def s24(spark, sf_dir):
    path = work_folder(spark, "load")
    games = _games(spark, sf_dir)
    sinks.build_and_load(_landed(spark, sf_dir), games, path, "game_date", "game_id", [F.col("line").asc()])
    return spark.read.parquet(path).select("game_id", "line")


@query(
    "s25_gap_fill",
    f"SELECT g.game_id, l.line FROM ({_LANDED}) l JOIN games g USING (home_team, away_team, game_date) WHERE g.season = 1997 OR g.game_id IN (SELECT game_id FROM games ORDER BY game_date DESC, game_id DESC LIMIT 3000)",
    "games",
)
def s25(spark, sf_dir):
    path = work_folder(spark, "gap")
    games, rows = _games(spark, sf_dir), _landed(spark, sf_dir)
    sinks.build_and_load(rows, games.filter("season = 1997"), path, "game_date", "game_id", [F.col("line").asc()])
    sinks.gap_fill(games, rows, path, game="game_id", date="game_date", last_n=3000, names=None, ordering=[F.col("line").asc()])
    return spark.read.parquet(path).select("game_id", "line")


@query("z1_stream_ingest", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def z1(spark, sf_dir):
    root = work_folder(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    keys = ["user_id", "event_type", "day"]
    running = ingest.insert_stream(rows, f"{root}/table", keys, [F.col("event_id").asc()], f"{root}/state", partition="day")
    running.awaitTermination()
    return spark.read.parquet(f"{root}/table").select(*keys)


@query(
    "z1_stream_upsert",
    "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
)
def z1_upsert(spark, sf_dir):
    root = work_folder(spark, "stream-log")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    running = ingest.upsert_stream(stream.select("user_id", "event_type", "value", "event_id"), f"{root}/log", f"{root}/state")
    running.awaitTermination()
    view = sinks.latest_view(spark.read.parquet(f"{root}/log"), ["user_id", "event_type"], ["event_id"])
    return view.select("user_id", "event_type", "value")
