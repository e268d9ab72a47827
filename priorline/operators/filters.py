"""Row and group validity rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.functions.dates import season_type
from priorline.functions.rowstats import row_nulls
from priorline.skew import attach, best_rows, same_keys

MIN_TEAM_POINTS, MIN_TEAM_MINUTES = 50, 120  # fixed values
MIN_PLAYER_SUM, MIN_PLAYER_SUM_CLEANUP = 180, 235  # fixed values
MIN_TOTAL = 100  # fixed value


def clean_team_rows(df: DataFrame, keys: Sequence[str], points: str, minutes: str, order: Sequence[Column]) -> DataFrame:
    """Rows with points above 10 and minutes other than 0, one per key."""
    kept = df.filter(F.col(points).isNotNull() & (F.col(points) > 10) & (F.coalesce(F.col(minutes), F.lit(-1)) != 0))
    return best_rows(kept, keys, order)


def complete_games(df: DataFrame, game: str, kind: Column, excluded: Sequence[str] = ("Preseason", "All Star")) -> DataFrame:
    """Rows of games with exactly two rows, with their season type, without the excluded types."""
    pairs = df.groupBy(game).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == 2)
    kept = df.join(pairs, same_keys(df, pairs, [game]), "left_semi")
    return kept.withColumn("season_type", kind).filter(~F.col("season_type").isin(list(excluded)))


def reject_groups(df: DataFrame, group: Sequence[str], bad: Column) -> DataFrame:
    """Drop every row of a group that holds a bad row; null counts as not bad."""
    hit = df.filter(F.coalesce(bad, F.lit(False))).select(*group).distinct()
    return df.join(hit, same_keys(df, hit, group), "left_anti")


def bad_team_row(result: str, points: str, minutes: str) -> Column:
    missing = F.col(result).isNull() | (F.trim(F.col(result)) == "")
    return missing | (F.col(points) < MIN_TEAM_POINTS) | (F.col(minutes) < MIN_TEAM_MINUTES)


def reject_short_games(df: DataFrame, game: str, team: str, minutes: str, least: float = MIN_PLAYER_SUM, skip: Column | None = None):
    """Drop games where a team's minutes add up to less than ``least``; ``skip`` marks rows never judged."""
    judged = df if skip is None else df.filter(~skip)
    sums = judged.groupBy(game, team).agg(F.sum(F.coalesce(F.col(minutes), F.lit(0.0))).alias("__sum"))
    short = sums.filter(F.col("__sum") < least).select(game).distinct()
    return df.join(short, same_keys(df, short, [game]), "left_anti")


def between_dates(df: DataFrame, date: str, first=None, last=None) -> DataFrame:
    """Inclusive date range; either end may be open."""
    day = F.to_date(F.col(date))
    out = df
    if first is not None:
        out = out.filter(day >= F.lit(first).cast("date"))
    if last is not None:
        out = out.filter(day <= F.lit(last).cast("date"))
    return out


def seasons_or_ids(df: DataFrame, season: str, seasons: Sequence[int], date: str, until, game: str, extra_ids: Sequence) -> DataFrame:
    """Rows of the seasons up to a date, and rows of the extra ids whatever their season; distinct."""
    in_season = F.col(season).isin(list(seasons)) & (F.to_date(date) <= F.lit(until).cast("date"))
    extra = F.col(game).isin(list(extra_ids)) if extra_ids else F.lit(False)
    return df.filter(in_season | extra).distinct()


def valid_totals(df: DataFrame, lines: Sequence[str], least: float = MIN_TOTAL, strict: bool = False) -> DataFrame:
    """Rows whose lines are all known and at least (or above) ``least``."""
    out = df
    for c in lines:
        out = out.filter(F.col(c) > least if strict else F.col(c) >= least)
    return out


def few_nulls(df: DataFrame, columns: Sequence[str], most: int, strict: bool = False) -> DataFrame:
    """Rows with at most ``most`` null columns; strict mode raises when none is left."""
    kept = df.filter(row_nulls(columns) <= most)
    if strict and kept.isEmpty():
        raise ValueError("no row is complete enough")
    return kept


def not_started(df: DataFrame, start: str, zone: str, now_utc: Column) -> DataFrame:
    """Games whose local start, taken in ``zone``, lies after ``now_utc``."""
    return df.filter(F.to_utc_timestamp(F.col(start), zone) > now_utc)


def without_unsubmitted(games: DataFrame, reports: DataFrame, game: str, reason: str, marker: str = "NOT YET SUBMITTED") -> DataFrame:
    open_games = reports.filter(F.col(reason) == marker).select(game).distinct()
    return games.join(open_games, game, "left_anti")


def is_injury(reason: Column) -> Column:
    return F.coalesce(reason.rlike("(?i)injur|injry"), F.lit(False))


def latest_ids(df: DataFrame, game: str, date: str, n: int) -> DataFrame:
    """The n most recent distinct games by date, then id (a top-n report)."""
    days = df.groupBy(game).agg(F.max(date).alias(date))
    return days.orderBy(F.desc(date), F.desc(game)).limit(n)


def conform(new: DataFrame, history: DataFrame) -> DataFrame:
    """Columns of history in its order; a missing one is an error, an extra one is dropped."""
    missing = [c for c in history.columns if c not in new.columns]
    if missing:
        raise ValueError(f"columns missing from the new batch: {missing}")
    return new.select(*history.columns)


def _expected_home(matchup: str, abbreviation: str) -> Column:
    """Home side of "A vs. B" is A, of "A @ B" is B."""
    text = F.col(matchup)
    host = F.when(text.contains("@"), F.trim(F.get(F.split(text, "@"), F.lit(1)))).otherwise(F.trim(F.split(text, r"vs\.")[0]))
    return F.col(abbreviation) == host


def repair_home_flag(df: DataFrame, game: str, home: str, matchup: str, abbreviation: str) -> DataFrame:
    """Recompute the flag where both rows of a game claim the same side."""
    doubled = df.groupBy(game, home).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select(game, home, F.lit(True).alias("__dup"))
    out = attach(df, doubled, [game, home])
    fixed = F.when(F.col("__dup"), _expected_home(matchup, abbreviation)).otherwise(F.col(home))
    return out.withColumn(home, fixed).drop("__dup")


def diagnose_home_flag(df: DataFrame, game: str, home: str, matchup: str, abbreviation: str) -> DataFrame:
    """Per game: rows, rows flagged home, and rows whose flag disagrees with the matchup text."""
    expected = _expected_home(matchup, abbreviation)
    return df.groupBy(game).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col(home), 1)).alias("n_home"),
        F.count(F.when(F.col(home) != expected, 1)).alias("n_wrong"),
    )


def games_for_odds(df: DataFrame, game: str, game_text: Column, home: str, matchup: str, abbreviation: str, excluded=("Preseason", "All Star")):
    """Games of the wanted types with a repaired home flag, without repeats."""
    kept = df.filter(~season_type(game_text).isin(list(excluded)))
    return repair_home_flag(kept, game, home, matchup, abbreviation).distinct()
