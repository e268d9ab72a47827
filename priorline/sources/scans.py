"""Scans of stored tables: seasons or ids, recent rows, points, tags, existing ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.skew import best_rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int, fetch: int = 50_000) -> DataFrame:
    """Partitioned read of a database table; each partition is one range of ``column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch)
    return reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()


def season_or_ids(df: DataFrame, season: str, seasons: Sequence[int] | None, game: str, extra_ids: Sequence = ()) -> DataFrame:
    """Rows of the seasons or of the extra ids in one pushed-down predicate; both empty means everything."""
    wanted: Column | None = None
    if seasons:
        wanted = F.col(season).isin(list(seasons))
    if extra_ids:
        by_id = F.col(game).isin(list(extra_ids))
        wanted = by_id if wanted is None else wanted | by_id
    return df if wanted is None else df.filter(wanted)


def newest_first(df: DataFrame, date: str, game: str) -> DataFrame:
    return df.orderBy(F.desc(date), F.desc(game))


def upper_names(df: DataFrame, text: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Upper-case column names, ids as text, one row per key (the smallest row of equals)."""
    named = df.toDF(*[c.upper() for c in df.columns])
    named = named.withColumns({c.upper(): F.col(c.upper()).cast("string") for c in text})
    order = [F.col(c).asc() for c in named.columns if c not in {k.upper() for k in keys}]
    return best_rows(named, [k.upper() for k in keys], order)


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def recent(df: DataFrame, n: int, ordering: Sequence[Column]) -> DataFrame:
    """The n most recent rows (a report)."""
    return df.orderBy(*ordering).limit(n)


def point(df: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    out = df
    for c, v in keys.items():
        out = out.filter(F.col(c) == F.lit(v))
    return out


def prediction_rows(df: DataFrame, date: str, first=None, last=None, result: str | None = None, resolved: bool | None = None) -> DataFrame:
    """Rows of a date range, optionally only those with or without a result."""
    out = df
    if first is not None:
        out = out.filter(F.col(date) >= F.lit(first).cast("date"))
    if last is not None:
        out = out.filter(F.col(date) <= F.lit(last).cast("date"))
    if result is not None and resolved is not None:
        out = out.filter(F.col(result).isNotNull() if resolved else F.col(result).isNull())
    return out


def distinct_tags(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(F.col(column)).alias(column)).filter(F.col(column) != "").distinct().orderBy(column)


def existing_ids(df: DataFrame, game: str, season: str | None = None, seasons: Sequence[int] = (), ids: Sequence = ()) -> DataFrame:
    return season_or_ids(df, season or game, seasons if season else None, game, ids).select(game).distinct()
