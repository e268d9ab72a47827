"""Sinks: insert if absent, upsert as a log with a latest view, result updates, deletes, gap filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from priorline.session import cut_lineage
from priorline.skew import attach, best_rows, same_keys


def _existing(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def absent_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str], ordering: Sequence[Column]) -> DataFrame:
    """New rows whose key is not stored, one per key; rows with a null key part are never stored."""
    clean = new.dropna(subset=list(keys))
    fresh = clean.join(existing.select(*keys), list(keys), "left_anti")
    return best_rows(fresh, keys, ordering).select(*new.columns)


def insert_if_absent(
    new: DataFrame, path: str, keys: Sequence[str], ordering: Sequence[Column], partition: str | None = None
) -> int:
    """Append the new rows whose key is absent and say how many; running the same batch again adds nothing.

    Only key columns of the stored table are read, and with a partition column only the partitions
    the batch touches.  The number is observed while the rows are written.
    """
    spark = new.sparkSession
    stored = _existing(spark, path, new.schema)
    if partition:
        touched = [r[0] for r in new.select(partition).distinct().collect()]
        stored = stored.filter(F.col(partition).isin(touched))
    written = Observation()
    writer = absent_rows(new, stored, keys, ordering).observe(written, F.count(F.lit(1)).alias("n")).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return written.get["n"]


def append_log(new: DataFrame, path: str, version: int) -> None:
    """Upsert, write side: append the batch with its version."""
    new.withColumn("load_version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def latest_view(log: DataFrame, keys: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Upsert, read side: the row of the highest version per key."""
    return best_rows(log, keys, [F.desc("load_version"), *[F.desc(t) for t in ties]]).drop("load_version")


def compact(log: DataFrame, keys: Sequence[str], path: str, ties: Sequence[str] = ()) -> None:
    """Write the current rows as a new table; readers switch to it."""
    latest_view(log, keys, ties).write.mode("errorifexists").parquet(path)


def update_columns(stored: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keyed update: new non-null values replace stored ones."""
    new = updates.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = attach(stored, new, keys)
    return joined.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def delete_keys(stored: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    marked = doomed.select(*keys)
    return stored.join(marked, same_keys(stored, marked, keys), "left_anti")


def delete_preview(stored: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> int:
    """How many rows a delete would remove."""
    marked = doomed.select(*keys)
    return stored.join(marked, same_keys(stored, marked, keys), "left_semi").count()


def build_and_load(rows: DataFrame, games: DataFrame, path: str, date: str, game: str, ordering: Sequence[Column]) -> dict[str, int]:
    """Resolve ids, drop unresolved rows, insert what is absent, report the counts.

    All counts are taken during the two writes; the stored table is never counted.
    """
    from priorline.operators.joins import resolve_ids

    seen = Observation()
    resolved = resolve_ids(rows.drop(game), games, date, game)
    resolved = cut_lineage(resolved.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(game).alias("resolved")))
    inserted = insert_if_absent(resolved.filter(F.col(game).isNotNull()), path, [game], ordering)
    return {"rows": seen.get["rows"], "resolved": seen.get["resolved"], "inserted": inserted}


def gap_fill(
    games: DataFrame, landed: DataFrame, path: str, *, game: str, date: str, last_n: int | None, names: Mapping[str, DataFrame] | None, ordering: Sequence[Column]
) -> dict[str, int]:
    """Fill missing games from landed rows: targets, missing ids, their dates, id resolution, insert.

    ``names`` maps a team column of the landed rows to a (name, canonical) table.  Missing ids come first, so only landed rows of
    their dates are resolved.
    """
    from priorline.operators.columns import lookup
    from priorline.operators.filters import latest_ids
    from priorline.operators.joins import resolve_ids
    from priorline.operators.sets import ids_to_fetch

    spark = games.sparkSession
    targets = games.select(game).distinct() if last_n is None else latest_ids(games, game, date, last_n).select(game)
    asked, lacking = Observation(), Observation()
    ids = games.select(game).schema
    missing = ids_to_fetch(targets.observe(asked, F.count(F.lit(1)).alias("n")), _existing(spark, path, ids), None, game)
    missing = cut_lineage(missing.observe(lacking, F.count(F.lit(1)).alias("n")))
    wanted = games.join(missing, game, "left_semi")
    rows = landed.join(wanted.select(date).distinct(), date, "left_semi").select(*landed.columns)
    for column, dim in (names or {}).items():
        rows = lookup(rows, dim, column, "name", "canonical", "__name", unknown="self").withColumn(column, F.col("__name")).drop("__name")
    resolved = resolve_ids(rows.drop(game), games, date, game).filter(F.col(game).isNotNull())
    fresh = resolved.join(missing, game, "left_semi").select(*resolved.columns)
    inserted = insert_if_absent(fresh, path, [game], ordering)
    return {"targets": asked.get["n"], "missing": lacking.get["n"], "inserted": inserted}
