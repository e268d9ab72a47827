"""Game-level shaping: home/away pairing, unpivoting, matchups, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.operators.windows import SeriesKeys, prior
from priorline.skew import attach, best_rows, bounded_frames


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when any key occurs twice (aggregates map-side, fetches one row)."""
    clash = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"duplicate keys {clash[0].asDict()}")


def pair_sides(df: DataFrame, keys: Sequence[str], home: str, check: bool = True) -> DataFrame:
    """One row per game from the two team rows; non-key columns get _home/_away, null keys match null."""
    rest = [c for c in df.columns if c not in (*keys, home)]
    if check:
        assert_unique(df, [*keys, home])
    left = df.filter(F.col(home)).select(*keys, *[F.col(c).alias(f"{c}_home") for c in rest])
    right = df.filter(~F.col(home)).select(*keys, *[F.col(c).alias(f"{c}_away") for c in rest])
    return attach(left, right, keys, "inner")


def collapse_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the home copy of game-level columns under the plain name and drop the pair."""
    shared = set(names)
    out = []
    for c in df.columns:
        if c.endswith("_home") and c[:-5] in shared:
            out.append(F.col(c).alias(c[:-5]))
        elif not (c.endswith("_away") and c[:-5] in shared):
            out.append(F.col(c))
    return df.select(*out)


def team_rows(df: DataFrame, keys: Sequence[str], paired: Sequence[str]) -> DataFrame:
    """Unpivot a game row into two team rows in one pass: x_home/x_away become x with an ``is_home`` flag."""
    sides = [
        F.struct(F.lit(flag).alias("is_home"), *[F.col(f"{c}_{side}").alias(c) for c in paired])
        for flag, side in ((True, "home"), (False, "away"))
    ]
    rows = df.select(*keys, F.explode(F.array(*sides)).alias("__side"))
    return rows.select(*keys, "__side.is_home", *[f"__side.{c}" for c in paired])


def pregame_form(df: DataFrame, keys: SeriesKeys, game: str, value: str, n: int) -> DataFrame:
    """Last-n means known before each game: home any/home, away any/away."""
    out = bounded_frames(df, [keys.entity], keys.order, n, lambda w: [F.avg(value).over(prior(w, n)).alias("__any")])
    out = bounded_frames(
        out, [keys.entity, keys.split], keys.order, n, lambda w: [F.avg(value).over(prior(w, n)).alias("__side")]
    )
    flag = F.col(keys.split)
    return out.groupBy(game).agg(
        F.max(F.when(flag, F.col("__any"))).alias(f"home_any_{n}"),
        F.max(F.when(flag, F.col("__side"))).alias(f"home_home_{n}"),
        F.max(F.when(~flag, F.col("__any"))).alias(f"away_any_{n}"),
        F.max(F.when(~flag, F.col("__side"))).alias(f"away_away_{n}"),
    )


def same_orientation_history(
    pairs: DataFrame, rows: DataFrame, *, game: str, team: str, home: str, date: str, value: str, until: Column, exclude=None
) -> DataFrame:
    """Earlier games between the requested (home, away) pairs in the same orientation, up to a date."""
    left = rows.filter(F.col(home)).select(game, date, F.col(team).alias("home_team"), F.col(value).alias("home_value"))
    right = rows.filter(~F.col(home)).select(F.col(game).alias("__g"), F.col(team).alias("away_team"), F.col(value).alias("away_value"))
    if exclude is not None:
        left = left.join(exclude, game, "left_anti")
    wanted = pairs.select("home_team", "away_team").distinct()
    met = left.filter(F.col(date) <= until).join(right, F.col(game) == F.col("__g")).drop("__g")
    met = met.join(wanted, ["home_team", "away_team"], "left_semi")
    return met.groupBy(game, "home_team", "away_team").agg(
        F.max(date).alias(date), F.max("home_value").alias("home_value"), F.max("away_value").alias("away_value")
    )


def schedule_rows(schedule: DataFrame, history: DataFrame, team: str, date: str, order: Sequence[str], carried: Sequence[str]):
    """Scheduled games as two team rows carrying the team's latest known metadata, added to history.

    A scheduled (team, date) that history already has is replaced by the scheduled row.
    """
    sides = F.array(
        F.struct(F.col("home_team").alias(team), F.lit(True).alias("home")),
        F.struct(F.col("away_team").alias(team), F.lit(False).alias("home")),
    )
    rows = schedule.select("game_id", date, F.explode(sides).alias("__s")).select("game_id", date, f"__s.{team}", "__s.home")
    latest = best_rows(history, [team], [F.desc(c) for c in order]).select(team, *carried)
    rows = rows.join(latest, team, "left").withColumn("scheduled", F.lit(True))
    kept = history.join(rows.select(team, date).distinct(), [team, date], "left_anti").withColumn("scheduled", F.lit(False))
    return kept.unionByName(rows, allowMissingColumns=True)


def schedule_players(schedule: DataFrame, players: DataFrame, *, game, team, player, date, season, order, keep, blank):
    """One placeholder row per scheduled (game, team) and player whose latest row is with that team.

    ``keep`` columns come from the player's latest row, ``blank`` ones are null.
    """
    latest = best_rows(players, [player], [F.desc(c) for c in order]).select(player, team, *keep)
    sides = F.explode(F.array("home_team", "away_team")).alias(team)
    wanted = schedule.select(game, date, season, sides)
    rows = wanted.join(latest, team)
    types = dict(players.dtypes)
    return rows.select(
        game, date, season, team, player, *keep, *[F.lit(None).cast(types[c]).alias(c) for c in blank if c not in keep]
    )
