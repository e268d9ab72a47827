"""Small hand-computed cases for the rules that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from priorline.functions import dates, odds, reports, rowstats, text
from priorline.operators import columns, evaluate, filters, games, players, quality, splits
from priorline.operators import windows as W
from priorline.sources import sinks

KEYS = W.SeriesKeys("e", "s", "h", ("t",))


def series(spark, values, season=1):
    rows = [("a", season, True, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "e string, s int, h boolean, t int, x double")


def column(df, name, order="t"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_weighted_mean_gives_the_empty_place_weight_one(spark):
    out = W.weighted_means(series(spark, [10.0, 20.0, 30.0]), KEYS, ["x"], 5)
    assert column(out, "x_wma_5_before") == [None, 10.0, pytest.approx((2 * 10 + 3 * 20) / 5)]


def test_weighted_mean_nulls_keep_their_place(spark):
    out = W.weighted_means(series(spark, [10.0, None, 30.0, 0.0]), KEYS, ["x"], 3)
    assert column(out, "x_wma_3_before")[3] == pytest.approx((1 * 10 + 3 * 30) / 4)


def test_slope_needs_two_points_and_skips_nulls(spark):
    out = W.trend_slopes(series(spark, [1.0, None, 4.0, 0.0]), KEYS, ["x"], 5)
    assert column(out, "x_trend_slope_last_5_before") == [None, None, None, pytest.approx(3.0)]


def test_season_std_population_then_sample_fallback(spark):
    df = series(spark, [1.0, 3.0], 1).unionByName(series(spark, [5.0, 7.0], 2).withColumn("t", F.col("t") + 10))
    out = column(W.season_std(df, KEYS, "x"), "x_season_before_std")
    assert out == [None, 0.0, pytest.approx(math.sqrt(2)), 0.0]


def test_season_mean_fallback_order(spark):
    df = series(spark, [1.0, 3.0], 1).unionByName(series(spark, [5.0, 7.0], 2).withColumn("t", F.col("t") + 10))
    assert column(W.season_mean(df, KEYS, "x"), "x_season_before_avg") == [None, 1.0, 2.0, 5.0]


def test_records_start_at_zero_in_every_group(spark):
    rows = [("a", 1, i, r) for i, r in enumerate("WWL")] + [("b", 1, i, r) for i, r in enumerate("LW")]
    df = spark.createDataFrame(rows, "e string, s int, t int, r string")
    out = W.records(df, ["e", "s"], ["t"], "r").orderBy("e", "t").collect()
    assert [r["wins_before"] for r in out] == [0, 1, 2, 0, 0]
    assert [r["record_before"] for r in out] == [0.0, 1.0, 1.0, 0.0, 0.0]


def test_recency_mean_matches_the_recursion(spark):
    values = [5.0, None, 12.0, 7.0, 30.0] + [float(i % 9) for i in range(1400)]
    rows = [("a", i, v, 0.0 if v is None else 10.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "e string, t int, x double, m double")
    got = column(players.recency_mean(df, ["e"], ["t"], "x", "m"), "x_cum_avg")
    alpha, mean, want = 1 - math.exp(-math.log(2) / 10), None, []
    for v in values:
        want.append(0.0 if mean is None else mean)
        if v is not None:
            mean = v if mean is None else (1 - alpha) * mean + alpha * v
    assert got == pytest.approx(want, rel=1e-9)


def test_trailing_days_are_left_closed(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(d), k) for d, k in ((0, 10.0), (1, 20.0), (1, 5.0), (3, 1.0))]
    df = spark.createDataFrame(rows, "e string, d date, k double")
    out = W.trailing_days(df, ["e"], "d", "k", [1, 2], "last_{n}").orderBy("d", "k").collect()
    assert [(r["last_1"], r["last_2"]) for r in out] == [(0.0, 0.0), (10.0, 10.0), (10.0, 10.0), (0.0, 25.0)]


def test_pairing_matches_null_keys_and_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, None, True, 5.0), (1, None, False, 6.0)], "g int, s string, h boolean, x double")
    assert games.pair_sides(df, ["g", "s"], "h").collect()[0]["x_away"] == 6.0
    with pytest.raises(ValueError):
        games.pair_sides(df.unionByName(df), ["g", "s"], "h")


def test_row_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, None), (None, None, None, None), (-9.0, 9.0, 1.0, 1.0)], "a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    out = df.select(
        rowstats.row_mean(cols).alias("m"), rowstats.row_median(cols).alias("q"), rowstats.row_iqr(cols).alias("i"),
        rowstats.row_mad(cols).alias("d"), rowstats.largest_abs_column(cols).alias("w"), rowstats.row_std(["a"]).alias("one"),
    ).collect()
    assert out[0]["m"] == pytest.approx(7 / 3) and out[0]["q"] == 2.0 and out[0]["i"] == pytest.approx(1.5) and out[0]["d"] == 1.0
    assert out[1]["m"] is None and out[1]["q"] is None and out[1]["w"] is None
    assert out[2]["w"] == "a" and out[2]["one"] is None


def test_push_returns_zero(spark):
    df = spark.createDataFrame([(200.0, 200.0, 210.0, "over", -110.0, -110.0), (200.0, 205.0, 210.0, "under", 150.0, None)],
                               "line double, actual double, pred double, side string, o double, u double")
    out = evaluate.betting_outcome(df, "line", "actual", "pred", "side", "o", "u").collect()
    assert out[0]["regressor_profit"] == 0.0 and out[0]["classifier_profit"] == 0.0
    assert out[1]["regressor_profit"] == 0.0  # an odds value is missing


def test_profit_of_a_win_and_a_loss(spark):
    df = spark.createDataFrame([(200.0, 205.0, 210.0, "under", 150.0, 1.8)], "line double, actual double, pred double, side string, o double, u double")
    out = evaluate.betting_outcome(df, "line", "actual", "pred", "side", "o", "u").collect()[0]
    assert out["regressor_profit"] == pytest.approx(1.5) and out["classifier_profit"] == -1.0 and out["both_profit"] == 0.0


def test_mixed_odds_and_coercion(spark):
    df = spark.createDataFrame([("150",), ("-200",), ("0",), ("1.9",), ("0.5",), ("x",), ("NaN",)], "o string")
    n = odds.number(F.col("o"))
    got = [r[0] for r in df.select(odds.mixed_to_decimal(n)).collect()]
    assert got == [2.5, 1.5, None, 1.9, None, None, None]


def test_minutes_text(spark):
    df = spark.createDataFrame([("12:30",), ("7",), ("",), (None,), ("a:10",), ("5:x",)], "m string")
    assert [r[0] for r in df.select(text.minutes(F.col("m"))).collect()] == [12.5, 7.0, 0.0, 0.0, 0.0, 0.0]


def test_season_rules(spark):
    df = spark.createDataFrame([(dt.date(2020, 9, 1),), (dt.date(2021, 7, 1),), (dt.date(2021, 8, 5),)], "d date")
    rules = ["july", "june", "august", "july_2020_october"]
    got = [tuple(r) for r in df.select(*[dates.season_year(F.col("d"), x) for x in rules]).collect()]
    assert got == [(2020, 2020, 2020, 2019), (2020, 2021, 2020, 2020), (2021, 2021, 2020, 2021)]


def test_holidays(spark):
    days = {r[0] for r in dates.us_holidays(spark, 2021, 2021).collect()}
    known = {dt.date(2021, 1, 1), dt.date(2021, 1, 18), dt.date(2021, 2, 15), dt.date(2021, 5, 31), dt.date(2021, 6, 18), dt.date(2021, 7, 5),
             dt.date(2021, 9, 6), dt.date(2021, 10, 11), dt.date(2021, 11, 11), dt.date(2021, 11, 25), dt.date(2021, 12, 24), dt.date(2021, 12, 31)}
    assert known <= days


def test_contribution_text_splits_on_the_last_colon(spark):
    df = spark.createDataFrame([("a:b:+0.5,bad,c:x,d:-1",)], "t string")
    pairs = df.select(text.contribution_pairs(F.col("t")).alias("p")).collect()[0]["p"]
    assert [(p["feature"], p["value"]) for p in pairs] == [("a:b", 0.5), ("d", -1.0)]


def test_report_rows(spark):
    blocks = [
        (1, 0, "Game Date\nGame Time"),
        (1, 1, "03/11/2025\n07:00 (ET)\nBKN@CLE\nBrooklyn Nets\nThomas, Cam\nOut\nInjury/Illness"),
        (1, 2, "Claxton, Nic\nQuestionable"),
        (1, 3, "Rest"),
        (1, 4, "Cleveland Cavaliers\nNOT YET SUBMITTED"),
        (1, 5, "Mobley, Evan\nOut\nInjury - Left\nCalf"),
    ]
    df = spark.createDataFrame(blocks, "doc int, line int, body string")
    out = {r["line"]: r for r in reports.report_rows(df, "doc", "line", "body").collect()}
    assert set(out) == {1, 3, 4, 5}
    assert (out[3]["player"], out[3]["status"], out[3]["reason"], out[3]["matchup"]) == ("Claxton, Nic", "Questionable", "Rest", "BKN@CLE")
    assert out[4]["team"] == "Cleveland Cavaliers" and out[4]["reason"] == "NOT YET SUBMITTED"
    assert out[5]["reason"] == "Injury - Left Calf" and out[5]["team"] == "Cleveland Cavaliers"


def test_whole_game_rejection(spark):
    df = spark.createDataFrame([(1, "W", 100.0, 240.0), (1, None, 90.0, 240.0), (2, "W", 99.0, 240.0), (2, "L", 98.0, 240.0)], "g int, wl string, p double, m double")
    assert {r["g"] for r in filters.reject_groups(df, ["g"], filters.bad_team_row("wl", "p", "m")).collect()} == {2}


def test_leaking_columns_raise(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "g int, pts double, pts_before double")
    assert columns.training_columns(df, ["g"], raw=["pts"]).columns == ["g", "pts_before"]
    with pytest.raises(ValueError):
        columns.training_columns(df, ["g"], prefixes=["pts"], raw=["pts"])


def test_scheduled_player_rows_keep_keys_and_type(spark):
    box = spark.createDataFrame(
        [("0022500900", dt.date(2026, 3, 15), "22025", 2025, "1610612747", "201939", "S. Curry", 35.0, 25)],
        "game_id string, game_date date, season_id string, season int, team_id string, player_id string, name string, minutes double, pts int",
    )
    schedule = spark.createDataFrame(
        [("0022500999", dt.date(2026, 3, 17), 2025, "1610612747", "1610612744")], "game_id string, game_date date, season int, home_team string, away_team string"
    )
    rows = games.schedule_players(
        schedule, box, game="game_id", team="team_id", player="player_id", date="game_date", season="season", order=["game_date", "game_id"],
        keep=["name", "season_id"], blank=["minutes", "pts"],
    )
    assert dict(rows.dtypes)["season"] == "int"
    both = box.unionByName(rows)
    out = players.recency_mean(both, ["season", "player_id"], ["game_date", "game_id"], "pts", "minutes").filter("minutes IS NULL").collect()
    assert len(out) == 1 and out[0]["season_id"] == "22025" and out[0]["pts_cum_avg"] == 25.0


def test_column_cleaning(spark):
    rows = [(i, float(i % 7), float(i % 7), -float(i % 5), float(i % 5), 2.0 * (i % 11) + 1, float(i % 11), 3.0, None if i % 10 else 1.0, "t") for i in range(60)]
    names = "key int, a double, a2 double, m double, m2 double, c double, c2 double, k double, n double, s string"
    df = spark.createDataFrame(rows, names)
    assert set(quality.useless_columns(df, protected=["key"])) == {"k", "n", "s"}
    assert quality.duplicate_columns(df, "key") == ["a2"]
    assert quality.absolute_twins(df, "key") == ["m2"]
    assert quality.correlated_columns(df.select("key", "c", "c2"), "key") == ["c"]


def test_frame_difference(spark):
    left = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 1.0, "c")], "k int, x double, s string")
    right = spark.createDataFrame([(1, 1.00001, "a"), (2, 5.0, "z")], "k int, x double, s string")
    got = {(r["k"], r["column_name"], r["only_in"]) for r in quality.frame_difference(left, right, ["k"]).collect()}
    assert got == {(2, "x", None), (2, "s", None), (3, "x", "left"), (3, "s", "left")}


def brute_folds(days, test_games, step, train_seasons, min_train, excluded):
    """Walk-forward by rows, written the slow way."""
    out, start = [], 0
    while start < len(days):
        first, _, season0 = days[start]
        past = [d for d in days if d[0] < first]
        seasons = []
        for _, _, s in past:
            if s not in seasons:
                seasons.append(s)
        train = [d for d in past if d[2] in seasons[-train_seasons:]]
        test, n, ok = [], 0, len(seasons) >= train_seasons and sum(d[1] for d in train) >= min_train
        for d in days[start:]:
            if not ok or n >= test_games or d[2] != season0:
                break
            if d[0].month in excluded:
                ok = False
                break
            test.append(d)
            n += d[1]
        if not ok or n < test_games:
            start += 1
            continue
        out.append((sum(d[1] for d in train), n, test[0][0], test[-1][0]))
        seen, nxt = 0, start
        while nxt < len(days) and seen < step:
            seen += days[nxt][1]
            nxt += 1
        start = max(start + 1, nxt)
    return out


@pytest.fixture(scope="module")
def calendar(spark):
    rows, key = [], 0
    for season in (2020, 2021, 2022):
        for month in (10, 11, 12, 3, 5):
            for d in (1, 8, 15):
                year = season if month > 8 else season + 1
                for _ in range(3 + (d + month) % 4):
                    rows.append((key, dt.date(year, month, d), season))
                    key += 1
    return spark.createDataFrame(rows, "id int, day date, season int").cache(), rows


def by_fold(ranges):
    out = {}
    for r in ranges.collect():
        out.setdefault(r["fold"], {}).setdefault(r["role"], []).append(r)
    return [out[f] for f in sorted(out)]


def test_season_folds_match_brute_force(calendar):
    df, rows = calendar
    days = sorted({(d, sum(1 for r in rows if r[1] == d), s) for _, d, s in rows})
    ranges = splits.season_folds(df, "day", "season", "id", train_seasons=1, test_games=10, step_games=8, min_train=20)
    got = by_fold(ranges)
    assert [(sum(r["n_rows"] for r in f["train"]), f["test"][0]["n_rows"], f["test"][0]["first_date"], f["test"][0]["last_date"]) for f in got] == brute_folds(days, 10, 8, 1, 20, (5, 6))
    table = splits.fold_rows(df, ranges, "day", "season", "id")
    counts = {(r["fold"], r["role"]): r["n"] for r in splits.split_summary(table, "day").collect()}
    assert counts == {(i, role): sum(r["n_rows"] for r in f[role]) for i, f in enumerate(got, start=1) for role in f}
    splits.require_valid(table, "day", "id")


def test_anchored_folds_take_exactly_the_last_rows(calendar):
    df, rows = calendar
    ranges = splits.anchored_folds(df, "day", "season", "id", test_games=10, train_games=25, min_train=20)
    table = splits.fold_rows(df, ranges, "day", "season", "id").collect()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, f in enumerate(by_fold(ranges), start=1):
        test = f["test"][0]
        before = [r[0] for r in ordered if r[1] < test["first_date"]][-25:]
        assert sorted(r["id"] for r in table if r["fold"] == i and r["role"] == "train") == sorted(before)
        inside = [r[0] for r in ordered if test["first_date"] <= r[1] <= test["last_date"]]
        assert sorted(r["id"] for r in table if r["fold"] == i and r["role"] == "test") == sorted(inside)


def test_rows_train_in_their_own_season(spark):
    """Two seasons on one date, a null season, a row without a date: every row counts for its own season."""
    day = dt.date(2020, 1, 1)
    rows = [(i, day + dt.timedelta(i // 4), 2019 if i < 21 or i == 22 else 2020) for i in range(60)]
    rows += [(900, day, None), (901, None, 2019)]
    df = spark.createDataFrame(rows, "id int, day date, season int")
    ranges = splits.season_folds(df, "day", "season", "id", train_seasons=2, test_games=8, min_train=5)
    for f in by_fold(ranges):
        start = f["test"][0]["first_date"]
        assert {r["season"]: r["n_rows"] for r in f["train"]} == {s: sum(1 for r in rows if r[2] == s and r[1] and r[1] < start) for s in (2019, 2020)}
    with pytest.raises(TypeError):
        splits.season_folds(df.withColumn("day", F.col("day").cast("timestamp")), "day", "season", "id")
    with pytest.raises(ValueError):
        splits.anchored_folds(df.limit(0), "day", "season", "id")


def test_fold_choice(spark):
    base = spark.createDataFrame([(i, "test", 10 * i) for i in range(1, 8)], "fold int, role string, n long")
    kept = {s: [(r["fold"], r["n"]) for r in splits.choose_folds(base, 3, s).orderBy("fold").collect()] for s in ("latest", "earliest", "even")}
    assert kept == {"latest": [(1, 50), (2, 60), (3, 70)], "earliest": [(1, 10), (2, 20), (3, 30)], "even": [(1, 10), (2, 40), (3, 70)]}
    with pytest.raises(ValueError):
        splits.choose_folds(base, 3, "odd")


def test_load_and_gap_fill_report_what_they_wrote(spark, tmp_path):
    games = spark.createDataFrame([(i, dt.date(2020, 1, 1 + i), f"h{i}", f"a{i}") for i in range(6)], "game_id int, game_date date, home_team string, away_team string")
    landed = games.select("game_date", "home_team", "away_team", (F.col("game_id") * 10.0).alias("line"))
    unknown = spark.createDataFrame([(dt.date(2020, 1, 1), "nobody", "a0", 1.0)], landed.schema)
    path = str(tmp_path / "t")
    args = ("game_date", "game_id", [F.col("line").asc()])
    assert sinks.build_and_load(landed.filter("line < 20").unionByName(unknown), games, path, *args) == {"rows": 3, "resolved": 2, "inserted": 2}
    filled = [sinks.gap_fill(games, landed, path, game="game_id", date="game_date", last_n=5, names=None, ordering=args[2]) for _ in range(2)]
    assert filled == [{"targets": 5, "missing": 4, "inserted": 4}, {"targets": 5, "missing": 0, "inserted": 0}]
    assert sorted(r.game_id for r in spark.read.parquet(path).collect()) == list(range(6))


def test_insert_twice_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    path = str(tmp_path / "t")
    assert [sinks.insert_if_absent(df, path, ["k"], [F.col("v").asc()]) for _ in range(2)] == [2, 0]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "d")]
