"""Landed event files: nested JSON to one row per event or per book line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEAM = "array<struct<name:string,is_home:boolean,is_away:boolean>>"
LINE = (
    "struct<total:struct<total_over_delta:double,total_under_delta:double,total_over_money_delta:double,total_under_money_delta:double>,"
    "moneyline:struct<moneyline_home_delta:double,moneyline_away_delta:double>,"
    "spread:struct<point_spread_home_delta:double,point_spread_away_delta:double>>"
)
EVENT = f"struct<event_id:string,event_date:string,teams:{TEAM},teams_normalized:{TEAM},lines:map<string,{LINE}>>"
MIN_LINE = 100.0  # fixed value: smaller totals are not real lines


def _side(teams: Column, flag: str) -> Column:
    return F.get(F.filter(teams, lambda t: F.coalesce(t[flag], F.lit(False))), F.lit(0))["name"]


def team_names(event: Column) -> tuple[Column, Column]:
    """(home, away) from the first of the two team arrays that names anyone."""
    both = [(_side(event[a], "is_home"), _side(event[a], "is_away")) for a in ("teams_normalized", "teams")]
    usable = both[0][0].isNotNull() | both[0][1].isNotNull()
    return (
        F.when(usable, both[0][0]).otherwise(both[1][0]),
        F.when(usable, both[0][1]).otherwise(both[1][1]),
    )


def parse_events(df: DataFrame, body: str, book: str) -> DataFrame:
    """One row per event with the lines of one book; events without a real total line are left out."""
    rows = df.withColumn("__e", F.from_json(F.col(body), EVENT))
    rows = rows.withColumn("__l", F.try_element_at(F.col("__e.lines"), F.lit(book)))
    home, away = team_names(F.col("__e"))
    total = F.coalesce(F.abs(F.col("__l.total.total_over_delta")), F.col("__l.total.total_under_delta"))
    return rows.select(
        *[c for c in df.columns if c != body],
        F.col("__e.event_date").alias("event_date"),
        home.alias("team_home"),
        away.alias("team_away"),
        total.alias("total_line"),
        F.col("__l.moneyline.moneyline_home_delta").alias("moneyline_home"),
        F.col("__l.moneyline.moneyline_away_delta").alias("moneyline_away"),
        F.col("__l.spread.point_spread_home_delta").alias("spread_home"),
        F.col("__l.spread.point_spread_away_delta").alias("spread_away"),
        F.col("__l.total.total_over_money_delta").alias("over_money"),
        F.col("__l.total.total_under_money_delta").alias("under_money"),
    ).filter(F.col("total_line") >= MIN_LINE)


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Event bodies of JSON files that hold a list of events or {"events": [...]}; one row per event.

    A file is one document, so files are the unit of parallelism.
    """
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{EVENT}>")
    wrapped = F.from_json("value", f"struct<events:array<{EVENT}>>")["events"]
    is_list = F.ltrim("value").startswith("[")
    return text.select(F.explode(F.when(is_list, listed).otherwise(wrapped)).alias("event")).select(F.to_json("event").alias("body"))


def book_lines(events: DataFrame, key: str, body: str) -> DataFrame:
    """Long form: one row per event and book."""
    parsed = events.select(key, F.from_json(F.col(body), EVENT).alias("__e"))
    lines = parsed.select(key, F.explode("__e.lines").alias("book", "line"))
    return lines.select(
        key,
        "book",
        F.abs(F.col("line.total.total_over_delta")).alias("total_line"),
        F.col("line.moneyline.moneyline_home_delta").alias("moneyline_home"),
        F.col("line.moneyline.moneyline_away_delta").alias("moneyline_away"),
        F.col("line.spread.point_spread_home_delta").alias("spread_home"),
        F.col("line.spread.point_spread_away_delta").alias("spread_away"),
        F.col("line.total.total_over_money_delta").alias("over_money"),
        F.col("line.total.total_under_money_delta").alias("under_money"),
    )
