"""File sources: season CSVs, daily market folders, CSV trees, folders with upper-case headers."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions.dates import season_year
from priorline.operators.columns import ensure
from priorline.operators.joins import merge_markets
from priorline.session import cut_lineage, work_folder
from priorline.skew import best_rows


def _file_label() -> Column:
    """A file's own name, or that of the folder a job wrote its parts into (``name.csv/part-...`` or ``key=name.csv/part-...``).

    Cut out at the separators: it is worked out for every row, and a pattern would be tried at every place of a long path.
    """
    path = F.col("_metadata.file_path")
    own, folder = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    value = F.substring_index(folder, "=", -1)
    name = F.when(own.startswith("part-") & (value != ""), value).otherwise(F.substring_index(own, "=", -1))
    return F.when(name.endswith(".csv") & (F.length(name) > 4), F.substring(name, F.lit(1), F.length(name) - 4)).otherwise(name)


def file_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, header): the first line of every file behind a glob, found where the files' first blocks are read."""
    lines = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    return lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "line").alias("header"))


def read_layouts(spark: SparkSession, pattern: str, *extra: Column) -> DataFrame:
    """All CSVs behind a glob as text columns, with ``extra`` columns of their metadata.

    Headers are read in one distributed pass; files with the same header are one read, whatever their number.  What comes
    to the driver is the file names by layout.  Columns that a layout lacks are null.
    """
    layouts = file_headers(spark, pattern).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    if not layouts:
        raise FileNotFoundError(f"no file for {pattern}")
    out = None
    for layout in layouts:
        columns = next(csv.reader([layout["header"].removeprefix("\ufeff")]))
        columns = [c or f"_c{i}" for i, c in enumerate(columns)]
        rows = spark.read.csv(layout["paths"], header=True, enforceSchema=True, schema=", ".join(f"`{c}` string" for c in columns))
        rows = rows.select(*[F.col(f"`{c}`") for c in columns], *extra)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_season_csvs(
    spark: SparkSession,
    folder: str,
    prefix: str,
    renames: Mapping[str, str] | None = None,
    drop_lower_case: bool = False,
    drop: Sequence[str] = (),
    season: str = "SEASON_YEAR",
) -> DataFrame:
    """Union of {prefix}_{year}_{yy}.csv files (or folders of parts) as text columns with the season taken from the name."""
    year = F.regexp_extract(_file_label(), r"_(\d{4})_[^_]*$", 1).try_cast("int")
    rows = read_layouts(spark, f"{folder}/*{prefix}_*.csv", year.alias(season)).withColumnsRenamed(dict(renames or {}))
    kept = [c for c in rows.columns if not (c.startswith("_c") or c.startswith("Unnamed:") or c in drop)]
    if drop_lower_case:
        kept = [c for c in kept if not c[0].islower()]
    return rows.select(*kept)


def read_daily_markets(spark: SparkSession, root: str, markets: Mapping[str, tuple[str, str]], keys: Sequence[str], strict: bool = True) -> DataFrame:
    """One row per game from per-day files in one folder per market.

    ``markets`` maps a folder to (CSV schema, day column name).  Strict mode keeps days present in
    every folder, otherwise any folder's day counts.
    """
    tables = []
    for folder, schema in markets.items():
        day = F.regexp_extract(_file_label(), r"(\d{4}-\d{2}-\d{2})$", 1).try_cast("date")
        rows = spark.read.csv(f"{root}/{folder}", header=True, schema=schema, recursiveFileLookup=True, pathGlobFilter="*.csv")
        # Read as text once: the look at the days, the check of the keys and the join all take the typed rows from here.
        tables.append(_typed_once(rows.select(day.alias("file_day"), *rows.columns), f"{folder}-typed"))
    if strict:
        days = tables[0].select("file_day").distinct()
        for t in tables[1:]:
            days = days.join(t.select("file_day").distinct(), "file_day", "left_semi")
        days = cut_lineage(days)
        tables = [t.join(days, "file_day", "left_semi") for t in tables]
    return merge_markets(tables, ["file_day", *keys])


def _typed_once(rows: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet on the job's shared storage."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_csv_tree(spark: SparkSession, root: str, schema: str, required: Sequence[str], dropped_words: Mapping[str, str] | None = None) -> DataFrame:
    """All CSVs below a folder without repeats, without rows lacking a required value or naming a dropped word."""
    rows = spark.read.csv(root, header=True, schema=schema, recursiveFileLookup=True, pathGlobFilter="*.csv").distinct()
    rows = rows.dropna(subset=list(required))
    for column, word in (dropped_words or {}).items():
        rows = rows.filter(~F.lower(F.col(column)).contains(word.lower()))
    return rows


def read_fact_folder(
    spark: SparkSession, folder: str, prefix: str, required: Sequence[str], keys: Sequence[str], date: str, rule: str = "july"
) -> DataFrame:
    """Folder of CSVs with upper-case headers: trimmed text, lower-case names, season from the date, one row per key."""
    rows = read_layouts(spark, f"{folder}/*{prefix}_*.csv")
    rows = rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.lower()) for c in rows.columns])
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    rows = rows.withColumn(date, F.col(date).try_cast("date"))
    rows = rows.withColumn("season_year", season_year(F.col(date), rule))
    order = [F.col(c).asc_nulls_last() for c in rows.columns if c not in keys]
    return best_rows(rows, keys, order)


def write_parquet(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Feature frame to Parquet; columns without a Parquet-friendly type become text."""
    odd = [c for c, t in df.dtypes if t.startswith(("void", "interval"))]
    out = df.withColumns({c: F.col(c).cast("string") for c in odd}) if odd else df
    writer = out.write.mode("errorifexists").option("compression", "snappy")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def export_tables(tables: Mapping[str, DataFrame], root: str, rows_per_file: int = 50_000) -> None:
    """Every table of a schema to its own Parquet folder in files of bounded size."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(f"{root}/{name}")


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast text columns, bad values to null, and add the missing ones."""
    return ensure(df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}), types)
