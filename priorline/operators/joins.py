"""Joins between games, odds, players and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.functions.odds import american_to_decimal
from priorline.operators.games import assert_unique
from priorline.skew import attach, best_rows


def side_value(home: str, home_col: str, away_col: str) -> Column:
    return F.when(F.col(home), F.col(home_col)).otherwise(F.col(away_col))


def attach_lines(teams: DataFrame, odds: DataFrame, game: str, home: str, book: str, totals: str = "all", total_books: Sequence[str] = ()):
    """Left join of the book's spread and moneyline by side, with no, the selected or all total lines."""
    lines = {"none": [], "selected": [book], "all": list(total_books)}[totals]
    wanted = [f"spread_{book}_line_home", f"spread_{book}_line_away", f"ml_{book}_price_home", f"ml_{book}_price_away"]
    joined = attach(teams, odds.select(game, *wanted, *[f"total_line_{b}" for b in lines]), [game])
    out = joined.withColumns(
        {
            f"spread_{book}": side_value(home, wanted[0], wanted[1]),
            f"moneyline_{book}": side_value(home, wanted[2], wanted[3]),
        }
    )
    return out.drop(*wanted)


def attach_sides(teams: DataFrame, odds: DataFrame, game: str, home: str, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Left join of many (name, home column, away column) values, each row taking its own side's."""
    sources = list(dict.fromkeys(c for _, h, a in pairs for c in (h, a)))
    joined = attach(teams, odds.select(game, *sources), [game])
    return joined.select(*teams.columns, *[side_value(home, h, a).alias(n) for n, h, a in pairs])


def attach_remaining(df: DataFrame, odds: DataFrame, game: str, excluded_books: Sequence[str] = (), excluded: Sequence[str] = ()):
    """Left join of the odds columns the frame lacks, without excluded books and metadata."""
    have = {c.lower() for c in df.columns}
    picked = [
        c
        for c in odds.columns
        if c != game and c.lower() not in have and c not in excluded and not any(f"_{b}_" in c or c.endswith(f"_{b}") for b in excluded_books)
    ]
    return attach(df, odds.select(game, *picked), [game])


def merge_odds_sources(books: DataFrame, public: DataFrame, key: str, shared: Sequence[str], fills: dict[str, str], drop: Sequence[str] = ()):
    """Full outer join; shared columns and one book's gaps are filled from the other source, prices become decimal."""
    taken = [c for c in public.columns if c != key and c not in drop]
    other = public.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__p_{c}") for c in taken])
    both = books.drop(*drop).join(other, F.col(key) == F.col("__k"), "full")
    out = []
    for c in books.columns:
        if c in drop:
            continue
        if c == key:
            column = F.coalesce(F.col(key), F.col("__k"))
        elif c in shared:
            column = F.coalesce(F.col(c), F.col(f"__p_{c}"))
        elif c in fills:
            column = F.coalesce(F.col(c), F.col(f"__p_{fills[c]}"))
        else:
            column = F.col(c)
        out.append((american_to_decimal(column) if "_price" in c else column).alias(c))
    used = set(fills.values()) | set(shared)
    out += [F.col(f"__p_{c}").alias(c) for c in taken if c not in used and c not in books.columns]
    return both.select(*out)


def merge_markets(markets: Sequence[DataFrame], keys: Sequence[str], check: bool = True) -> DataFrame:
    """Outer join of per-market tables on their key, each unique on it."""
    if check:
        for m in markets:
            assert_unique(m, keys)
    out = markets[0]
    for m in markets[1:]:
        out = out.join(m, list(keys), "full")
    return out


def attach_dated_odds(teams: DataFrame, odds: DataFrame, *, date: str, original: str, team: str, home: str, values: Sequence[str], line: str):
    """Odds by (date, team, side); missing values by original date; a missing line by (date, team) of any side.

    ``odds`` has one row per (date, team, side); of several rows without regard to side the first by
    line value is taken, which replaces the order-dependent choice of a plain de-duplication.
    """
    keys = [date, team, home]
    first = best_rows(odds, keys, [F.col(v).asc_nulls_last() for v in values]).select(*keys, *[F.col(v).alias(f"__1_{v}") for v in values])
    moved = odds.drop(date).withColumnRenamed(original, date)
    second = best_rows(moved, keys, [F.col(v).asc_nulls_last() for v in values]).select(*keys, *[F.col(v).alias(f"__2_{v}") for v in values])
    anyside = odds.filter(F.col(line).isNotNull()).groupBy(date, team).agg(F.min(line).alias("__3"))
    out = attach(attach(attach(teams, first, keys), second, keys), anyside, [date, team])
    filled = {v: F.coalesce(f"__1_{v}", f"__2_{v}") for v in values}
    filled[line] = F.coalesce(filled[line], F.col("__3"))
    return out.select(*teams.columns, *[c.alias(v) for v, c in filled.items()])


def resolve_ids(rows: DataFrame, games: DataFrame, date: str, game: str) -> DataFrame:
    """Attach the game id by (date, home team, away team); unmatched rows keep a null id."""
    known = games.select(date, "home_team", "away_team", F.col(game).alias("__id"))
    return attach(rows, known, [date, "home_team", "away_team"]).withColumn(game, F.col("__id")).drop("__id")


def box_scores(basic: DataFrame, advanced: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Inner join without repeated columns; the last row per key is kept (``order`` puts it first)."""
    extra = [c for c in advanced.columns if c in keys or c not in basic.columns]
    return attach(best_rows(basic, keys, order), best_rows(advanced, keys, order).select(*extra), keys, "inner")


def add_game_dates(players: DataFrame, games: DataFrame, game: str, date: str) -> DataFrame:
    """Game date for player rows; rows of unknown games are dropped."""
    dates = games.groupBy(game).agg(F.max(date).alias(date))
    return attach(players.drop(date), dates, [game]).filter(F.col(date).isNotNull())


def assign_referees(assignments: DataFrame, schedule: DataFrame, names: DataFrame) -> DataFrame:
    """Assignments (home, away, official text) joined to the schedule on lower-cased mapped names."""
    mapped = names.select(F.lower("alias").alias("__a"), F.lower("canonical").alias("__c"))

    def canonical(df: DataFrame, column: str) -> DataFrame:
        low = F.lower(F.trim(F.col(column)))
        joined = df.join(mapped, low == F.col("__a"), "left")
        return joined.withColumn(f"__{column}", F.coalesce("__c", low)).drop("__a", "__c")

    left = canonical(canonical(assignments, "home"), "away")
    right = schedule.select("game_id", F.lower("home_name").alias("__h"), F.lower("away_name").alias("__w"))
    joined = left.join(right, (F.col("__home") == F.col("__h")) & (F.col("__away") == F.col("__w")))
    return joined.drop("__home", "__away", "__h", "__w")


def report_key(date: Column, matchup: Column) -> Column:
    return F.concat(F.date_format(date, "yyyyMMdd"), F.regexp_replace(matchup, "@", ""))


def attach_reports(reports: DataFrame, schedule: DataFrame, date: str, matchup: str, code: str, game: str) -> DataFrame:
    """Report rows with the game whose code, without slashes, equals yyyymmdd + matchup."""
    keyed = schedule.select(F.regexp_replace(F.col(code), "/", "").alias("__key"), F.col(game).alias("__id"))
    out = reports.withColumn("__key", report_key(F.col(date), F.col(matchup)))
    return attach(out, keyed, ["__key"]).withColumnRenamed("__id", game).drop("__key")


def out_players(reports: DataFrame, game: str, team: str, player: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Distinct (game, team, player) listed with one of the statuses."""
    hit = F.col(status).isin(list(statuses)) & F.col(game).isNotNull() & F.col(player).isNotNull()
    return reports.filter(hit).select(game, team, player).distinct()


def missing_dates(games: DataFrame, odds: DataFrame, game: str, date: str, since=None) -> DataFrame:
    """Dates of games without odds, and each day after, once."""
    wanted = games if since is None else games.filter(F.col(date) >= F.lit(since).cast("date"))
    lost = wanted.join(odds.select(game), game, "left_anti").select(date)
    return lost.select(F.explode(F.array(F.col(date), F.date_add(F.col(date), 1))).alias(date)).distinct()
