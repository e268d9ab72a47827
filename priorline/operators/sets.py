"""Set operations on rows and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.skew import best_rows, same_keys


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, keys: Sequence[str], ordering) -> DataFrame:
    """First row per key under an explicit order."""
    return best_rows(df, keys, ordering)


def ids_to_fetch(wanted: DataFrame, existing: DataFrame, excluded: DataFrame | None, key: str) -> DataFrame:
    out = wanted.select(key).distinct().join(existing.select(key), key, "left_anti")
    return out if excluded is None else out.join(excluded.select(key), key, "left_anti")


def ids_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def merge_absences(listed: DataFrame, reported: DataFrame, scheduled: DataFrame | None, game: str) -> DataFrame:
    """Distinct union of two sources; games of the scheduled list take that list alone."""
    both = listed.unionByName(reported).distinct()
    if scheduled is None:
        return both
    games = scheduled.select(game).distinct()
    return both.join(games, same_keys(both, games, [game]), "left_anti").unionByName(scheduled.distinct())


def normal_ids(df: DataFrame, column: str, position: str) -> DataFrame:
    """Trimmed non-empty ids, each once, with the place it was first seen."""
    clean = F.trim(F.col(column).cast("string"))
    return df.select(clean.alias(column), position).filter(F.col(column) != "").groupBy(column).agg(F.min(position).alias(position))
