"""Two-row events to one row, modes over book lines, ids and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.functions.odds import american_to_decimal
from priorline.functions.text import matchup_sides
from priorline.skew import attach, best_rows, deal_out

NO_PRICE = -10000.0  # fixed value: sentinel of a missing moneyline


def first_where(condition: Column, value: Column, order: Column) -> Column:
    """Value of the first row that meets the condition (null values included), with map-side partials."""
    return F.min_by(value, F.when(condition, order))


def two_rows_to_one(df: DataFrame, event: str, row: str, side: str | None, shared: Sequence[str], by_row: Sequence[str], by_side: Sequence[str]):
    """away = row 0, home = row 1; over/under by the side letter."""
    order = F.col(row)
    out = [first_where(F.lit(True), F.col(c), order).alias(c) for c in shared]
    for label, index in (("away", 0), ("home", 1)):
        out += [first_where(F.col(row) == index, F.col(c), order).alias(f"{c}_{label}") for c in by_row]
    if side:
        for label, letter in (("over", "O"), ("under", "U")):
            hit = F.upper(F.col(side)) == letter
            out += [first_where(hit, F.col(c), order).alias(f"{c}_{label}") for c in by_side]
    return df.groupBy(event).agg(*out)


def totals_pivot(df: DataFrame, event: str, row: str, side: str, shared: Sequence[str], books: Sequence[str]) -> DataFrame:
    """Total market: scores by row, lines and prices by over/under side, points of whichever scores are known."""
    values = ["consensus_pct", *[f"{b}_{k}" for b in books for k in ("line", "price")]]
    out = two_rows_to_one(df, event, row, side, shared, ["team_name", "score"], values)
    any_score = F.col("score_home").isNotNull() | F.col("score_away").isNotNull()
    points = F.coalesce("score_home", F.lit(0.0)) + F.coalesce("score_away", F.lit(0.0))
    return out.withColumn("total_points", F.when(any_score, points))


def spreads_pivot(df: DataFrame, event: str, row: str, shared: Sequence[str], books: Sequence[str]) -> DataFrame:
    values = ["team_name", "score", "consensus_pct", *[f"{b}_{k}" for b in books for k in ("line", "price")]]
    return two_rows_to_one(df, event, row, None, shared, values, [])


def moneylines_pivot(df: DataFrame, event: str, row: str, shared: Sequence[str], books: Sequence[str]) -> DataFrame:
    """Moneyline market; the sentinel price means no price."""
    clean = df.withColumns({f"{b}_price": F.nullif(F.col(f"{b}_price"), F.lit(NO_PRICE)) for b in books})
    return two_rows_to_one(clean, event, row, None, shared, ["team_name", *[f"{b}_price" for b in books]], [])


def public_pivot(df: DataFrame, keys: Sequence[str], team: str, matchup: str, row: str, by_team: Sequence[str], shared: Sequence[str], side: str, line: str):
    """Public odds keyed by matchup text "A @ B"; falls back to the first two rows when the names do not match."""
    away, home = matchup_sides(F.col(matchup))
    marked = df.withColumns({"__away": F.col(team) == away, "__home": F.col(team) == home})
    order = F.col(row)
    out = [(F.max(F.coalesce("__away", F.lit(False))) & F.max(F.coalesce("__home", F.lit(False)))).alias("__named")]
    out += [first_where(F.lit(True), F.col(c), order).alias(c) for c in shared]
    for label in ("away", "home"):
        out += [first_where(F.col(f"__{label}"), F.col(c), order).alias(f"__n_{c}_{label}") for c in by_team]
    for label, letter in (("over", "O"), ("under", "U")):
        out.append(first_where(F.upper(F.col(side)) == letter, F.col(line), order).alias(f"{line}_{label}"))
    named = marked.groupBy(*keys).agg(*out)
    two = best_rows(df.select(*keys, row, *by_team), keys, [order.asc()], 2, "__nth")
    placed = two.groupBy(*keys).agg(
        *[first_where(F.col("__nth") == n, F.col(c), order).alias(f"__o_{c}_{label}") for n, label in ((1, "away"), (2, "home")) for c in by_team]
    )
    grouped = attach(named, placed, keys)
    picks = [F.when(F.col("__named"), F.col(f"__n_{c}_{s}")).otherwise(F.col(f"__o_{c}_{s}")).alias(f"{c}_{s}") for s in ("away", "home") for c in by_team]
    return grouped.select(*keys, *[c for c in shared if c not in keys], *picks, f"{line}_over", f"{line}_under")


def common_values(df: DataFrame, keys: Sequence[str], values: Sequence[str], position: str | None = None) -> DataFrame:
    """Mean and most common value of each column per group; of equals the first by ``position``, else the smallest.

    Rows of ordinary groups are shuffled once, as they are, and counted per (group, column, value) where they arrive; those of
    hot groups are counted before the shuffle, so that they are combined map-side.  Columns of different types take one pass per type.
    """
    types = {v: df.schema[v].dataType.simpleString() for v in values}
    used = df.select(*keys, *[c for c in dict.fromkeys([*values, *([position] if position else [])]) if c not in keys])
    dealt, hot = deal_out(used, keys)
    out = None
    for t in dict.fromkeys(types.values()):
        same = [v for v in values if types[v] == t]
        parts = [_common_values(rows, keys, same, position) for rows in (dealt, hot) if rows is not None]
        part = reduce(DataFrame.unionByName, parts)
        out = part if out is None else attach(out, part, keys)
    return out.select(*keys, *[f"{kind}_{v}" for kind in ("average", "most_common") for v in values])


def _common_values(df: DataFrame, keys: Sequence[str], values: Sequence[str], position: str | None) -> DataFrame:
    place = F.col(position) if position else F.lit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(v).alias("v")) for i, v in enumerate(values)]))
    long = df.select(*keys, place.alias("__at"), pairs.alias("__p")).select(*keys, "__at", F.col("__p.c").alias("__c"), F.col("__p.v").alias("__v"))
    counts = long.groupBy(*keys, "__c", "__v").agg(F.count("__v").alias("__n"), F.min("__at").alias("__at"), F.sum("__v").alias("__s"))
    means, modes = [], []
    for i, v in enumerate(values):
        mine = (F.col("__c") == i) & (F.col("__n") > 0)
        n = F.sum(F.when(mine, F.col("__n")))
        means.append((F.sum(F.when(mine, F.col("__s"))) / n).alias(f"average_{v}"))
        modes.append(F.min_by("__v", F.when(mine, F.struct(-F.col("__n"), F.col("__at"), F.col("__v")))).alias(f"most_common_{v}"))
    return counts.groupBy(*keys).agg(*means, *modes)


def modes_and_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Most common value (smallest of equals) and mean of each column per group."""
    return common_values(df, keys, values)


LINE_RULES = {
    "total_line": 100.0,
    "moneyline_home": 0.05,
    "moneyline_away": 0.05,
    "spread_home": 0.05,
    "spread_away": 0.05,
}  # fixed values: a book's value counts when its size reaches the limit (totals must exceed it)
MONEY_LIMIT = 10.0  # fixed value


def line_summary(lines: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """First-seen mode and mean of each market over the books of an event."""
    ok_total = F.col("total_line") > LINE_RULES["total_line"]
    clean = {"total_line": F.when(ok_total, F.col("total_line"))}
    for c in ("moneyline_home", "moneyline_away", "spread_home", "spread_away"):
        clean[c] = F.when(F.abs(F.col(c)) >= LINE_RULES[c], F.col(c))
    for c in ("over_money", "under_money"):
        clean[c] = F.when(ok_total & (F.abs(F.col(c)) > MONEY_LIMIT), american_to_decimal(F.col(c)))
    return common_values(lines.withColumns(clean), keys, list(clean), position)


def null_shares(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column, largest first: one aggregate over the table, then a tiny unpivot."""
    counted = df.agg(F.count(F.lit(1)).alias("__all"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    long = counted.unpivot(["__all"], df.columns, "column_name", "n_null")
    share = F.when(F.col("__all") > 0, 100.0 * F.col("n_null") / F.col("__all")).otherwise(0.0)
    return long.select("column_name", "n_null", share.alias("null_pct")).orderBy(F.desc("null_pct"), "column_name")


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, full-row duplicates, rows in duplicated keys, duplicated keys."""
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    by_full = full.agg(F.sum("__n").alias("n_rows"), F.sum(F.col("__n") - 1).alias("n_repeated_rows"))
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    keyed = by_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows_in_repeated_keys"), F.count(F.lit(1)).alias("n_repeated_keys"))
    return by_full.join(F.broadcast(keyed))  # both sides are one row


def top_duplicate_keys(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.orderBy(F.desc("n"), *keys).limit(n)


def season_summary(df: DataFrame, season: str, date: str) -> DataFrame:
    return df.groupBy(season).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def distinct_dates(df: DataFrame, ids: DataFrame, game: str, date: str) -> DataFrame:
    return df.join(ids.select(game), game, "left_semi").select(F.to_date(date).alias(date)).distinct().orderBy(date)


def book_presence(lines: DataFrame, events: DataFrame, event: str, book: str) -> DataFrame:
    """Share of events in which a book appears, each event counted once."""
    total = events.select(event).distinct().agg(F.count(F.lit(1)).alias("__all"))
    seen = lines.select(event, book).distinct().groupBy(book).agg(F.count(F.lit(1)).alias("n_events"))
    return seen.join(F.broadcast(total)).select(book, "n_events", (F.col("n_events") / F.col("__all")).alias("share"))  # total: one row


def group_total(df: DataFrame, game: str, value: str, lines: Sequence[str], name: str = "total_points") -> DataFrame:
    """Game total on every row and its difference from each line; null while no value is known."""
    totals = df.groupBy(game).agg(F.sum(value).alias(name))
    out = attach(df, totals, [game])
    return out.withColumns({f"diff_from_{c}": F.col(name) - F.col(c) for c in lines})


def last_season_count(df: DataFrame, season: str, team: str, game: str, wanted: Column, name: str) -> DataFrame:
    """Distinct wanted games of the previous season, 0 when none."""
    counts = df.filter(wanted).groupBy(season, team).agg(F.count_distinct(game).alias(name))
    counts = counts.withColumn(season, (F.col(season) + 1).cast(df.schema[season].dataType))
    return attach(df, counts, [season, team]).fillna(0, [name])


def no_history(participants: DataFrame, history: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Participants with fewer than ``least`` earlier rows."""
    counts = history.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return participants.select(key).distinct().join(counts, key, "left_anti")


def require_history(participants: DataFrame, history: DataFrame, key: str, least: int = 1) -> None:
    lost = no_history(participants, history, key, least).limit(5).collect()
    if lost:
        raise ValueError(f"no history for {[r[0] for r in lost]}")
