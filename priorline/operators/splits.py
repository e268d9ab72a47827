"""Time splits: holdout, walk-forward folds, training windows.

Folds are ranges of dates.  They are worked out from the calendar's cumulative row counts by binary search
(one row per date and season, bounded by the number of days) and spelled out in rows only on demand.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorline.operators.league import date_index
from priorline.skew import attach, with_position

EXCLUDED_MONTHS = (5, 6)  # fixed values


def chronological(df: DataFrame, date: str, key: str) -> DataFrame:
    """Adds ``position`` over (date, key); a row without a date is an error."""
    if not df.filter(F.col(date).isNull()).isEmpty():
        raise ValueError(f"rows without a {date}")
    inside = with_position(df, [date], [key], "__in")
    placed = attach(inside, date_index(df, date), [date], "inner")
    return placed.withColumn("position", F.col("__start") + F.col("__in")).drop("__start", "__on", "__in")


def latest_holdout(df: DataFrame, date: str, fraction: float | None = None, games: int | None = None) -> DataFrame:
    """Adds ``role`` dev/test: the latest whole dates until the target number of rows is reached."""
    if (fraction is None) == (games is None):
        raise ValueError("give either a fraction or a number of games")
    index = date_index(df, date)
    total = df.count()
    target = games if games is not None else -(-int(round(total * fraction * 1e9)) // 10**9)
    # A date is in the test set while fewer than ``target`` rows come after it.
    after = index.withColumn("__after", F.lit(total) - F.col("__start") - F.col("__on"))
    roles = after.select(date, F.when(F.col("__after") < target, "test").otherwise("dev").alias("role"))
    return attach(df, roles, [date], "inner")


class _Calendar:
    """Dates in order with their rows, read once: one row per date and season, so its size is bounded by the days."""

    def __init__(self, df: DataFrame, date: str, season: str, key: str, excluded: Sequence[int], same_season: bool):
        if dict(df.dtypes)[date] != "date":
            raise TypeError(f"{date} must be a date, so that the calendar stays bounded by its days")
        counts = df.filter(F.col(date).isNotNull()).groupBy(date, season).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
        parts = counts.orderBy(date, "first").collect()
        self.dates = sorted({p[0] for p in parts})
        place = {d: i for i, d in enumerate(self.dates)}
        rows = np.zeros(len(self.dates), np.int64)
        opens: list = [None] * len(self.dates)  # the season of a date's first row
        self.seasons: dict = {}  # in order of first appearance: dates of the season and its rows before each, one more at the end
        for p in reversed(parts):
            opens[place[p[0]]] = p[1]
        for p in parts:
            rows[place[p[0]]] += p["n"]
            if p[1] is not None:
                at, before = self.seasons.setdefault(p[1], ([], [0]))
                at.append(place[p[0]])
                before.append(before[-1] + p["n"])
        self.before = np.concatenate([[0], np.cumsum(rows)])
        barred = np.array([d.month in excluded for d in self.dates], bool)
        turns = np.array([i > 0 and same_season and opens[i] != opens[i - 1] for i in range(len(opens))], bool)
        stops = np.flatnonzero(barred | turns)
        later = np.searchsorted(stops, np.arange(len(rows)), side="right")
        # where a window that opens on a date has to end at the latest
        self.limit = np.where(barred, -1, np.append(stops, len(rows))[later]) if len(rows) else np.zeros(0, np.int64)

    def ahead(self, start, rows: int):
        """The first place from which at least ``rows`` rows lie behind ``start`` (one past the last date and more if there are too few)."""
        return np.searchsorted(self.before, self.before[start] + rows, side="left")

    def windows(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of all test windows of whole dates with at least ``rows`` rows that cross no barrier."""
        start = np.arange(len(self.dates))
        end = self.ahead(start, rows)
        fits = end <= self.limit
        return start[fits], end[fits]

    def season_rows(self, season, start: int) -> tuple[int, int, int]:
        """Rows of a season before a place, and its first and last date there."""
        at, before = self.seasons[season]
        n = int(np.searchsorted(at, start))
        return before[n], at[0], at[n - 1]


def _walk(starts: np.ndarray, ends: np.ndarray, train, onward) -> list[tuple[int, int, list]]:
    """Accepted windows: from each the next candidate is found by binary search among the possible starts."""
    found, at = [], 0
    while at < len(starts):
        start, end = int(starts[at]), int(ends[at])
        ranges = train(start)
        if ranges is None:
            at += 1
            continue
        found.append((start, end, ranges))
        at = int(np.searchsorted(starts, max(start + 1, int(onward(start, end)))))
    if not found:
        raise ValueError("no valid folds")
    return found


def _ranges(df: DataFrame, days: _Calendar, date: str, season: str, folds: list[tuple[int, int, list]]) -> DataFrame:
    rows = []
    for fold, (start, end, train) in enumerate(folds, start=1):
        rows += [(fold, "train", s, days.dates[a], days.dates[b], part, int(n)) for s, a, b, part, n in train]
        rows.append((fold, "test", None, days.dates[start], days.dates[end - 1], None, int(days.before[end] - days.before[start])))
    schema = T.StructType(
        [
            T.StructField("fold", T.IntegerType()),
            T.StructField("role", T.StringType()),
            T.StructField("season", df.schema[season].dataType),
            T.StructField("first_date", T.DateType()),
            T.StructField("last_date", T.DateType()),
            T.StructField("boundary_rows", T.LongType()),
            T.StructField("n_rows", T.LongType()),
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)


def season_folds(
    df: DataFrame,
    date: str,
    season: str,
    key: str,
    train_seasons: int = 3,
    test_games: int = 30,
    step_games: int | None = None,
    min_train: int = 300,
    excluded: Sequence[int] = EXCLUDED_MONTHS,
) -> DataFrame:
    """Walk forward: train on the last N seasons seen before the first test date.

    One range per fold and training season and one per test window: fold, role, season (null: any), first_date, last_date,
    boundary_rows (null: all of the first date), n_rows.  Every row counts for its own season; a date's window
    season is that of its first row by key.  Rows without a date take no part, null seasons train nothing.
    """
    days = _Calendar(df, date, season, key, excluded, True)
    opened = [at[0] for at, _ in days.seasons.values()]

    def train(start: int):
        seen = list(days.seasons)[: int(np.searchsorted(opened, start))]
        if len(seen) < train_seasons:
            return None
        chosen = [(s, *days.season_rows(s, start)) for s in seen[-train_seasons:]]
        return [(s, a, b, None, n) for s, n, a, b in chosen] if sum(c[1] for c in chosen) >= min_train else None

    return _ranges(df, days, date, season, _walk(*days.windows(test_games), train, lambda start, _: days.ahead(start, step_games or test_games)))


def anchored_folds(
    df: DataFrame,
    date: str,
    season: str,
    key: str,
    test_games: int = 30,
    step_games: int | None = None,
    train_games: int | None = 1000,
    min_train: int = 300,
    excluded: Sequence[int] = EXCLUDED_MONTHS,
    same_season: bool = True,
) -> DataFrame:
    """Build test windows first; train on the last K rows before each, all of them where K is None.

    Ranges as ``season_folds`` gives them, one per fold and role; boundary_rows says how many of the last rows (by key) of
    the first training date belong to it.
    """
    days = _Calendar(df, date, season, key, excluded, same_season)

    def train(start: int):
        have = int(days.before[start])
        rows = have if train_games is None else min(train_games, have)
        if rows < min_train or not rows:
            return None
        first = int(np.searchsorted(days.before, have - rows, side="right")) - 1
        return [(None, first, start - 1, int(days.before[first + 1]) - (have - rows), rows)]

    # counting starts at the window's end; past the last date there is nothing left to find
    step = step_games or test_games
    return _ranges(df, days, date, season, _walk(*days.windows(test_games), train, lambda _, end: days.ahead(end, step)))


def choose_folds(ranges: DataFrame, most: int | None, strategy: str = "latest") -> DataFrame:
    """Keep ``most`` folds: latest, earliest or evenly spread; renumbered from 1."""
    if strategy not in ("latest", "earliest", "even"):
        raise ValueError(f"unknown strategy {strategy}")
    if most is None:
        return ranges
    n = ranges.agg(F.max("fold")).first()[0] or 0
    if most >= n:
        return ranges
    first = {"latest": n - most, "earliest": 0}.get(strategy, 0)
    keep = sorted({round(i * (n - 1) / max(most - 1, 1)) for i in range(most)}) if strategy == "even" else list(range(first, first + most))
    number = F.array_position(F.array(*[F.lit(k + 1) for k in keep]), F.col("fold")).cast("int")
    return ranges.filter(F.col("fold").isin([k + 1 for k in keep])).withColumn("fold", number)


def fold_rows(df: DataFrame, ranges: DataFrame, date: str, season: str, key: str) -> DataFrame:
    """(fold, role, key, date, season): the rows of each fold, for those who need them spelled out.

    A row appears once per fold it belongs to, so this grows with folds x window; ranges do not.  The calendar is
    matched against the ranges and rows join on the date and their own season.  Only the first date of a
    range with boundary_rows needs a rank inside the date.
    """
    calendar = df.select(F.col(date).alias("__date"), F.col(season).alias("__own")).distinct()
    inside = F.col("__date").between(F.col("first_date"), F.col("last_date")) & (F.col("season").isNull() | (F.col("season") == F.col("__own")))
    months = ranges.select("*", F.explode(F.sequence(F.trunc("first_date", "month"), F.col("last_date"), F.expr("INTERVAL 1 MONTH"))).alias("__month"))
    spans = months.join(calendar.withColumn("__month", F.trunc("__date", "month")), "__month").filter(inside)
    limit = F.when(F.col("__date") == F.col("first_date"), F.col("boundary_rows")).alias("__limit")
    spans = spans.select("fold", "role", F.col("__date").alias(date), F.col("__own").alias(season), limit)
    ranked = with_position(df.select(key, date, season), [date], [key], "__in")
    ranked = attach(ranked, df.groupBy(date).agg(F.count(F.lit(1)).alias("__n")), [date], "inner")
    rows = attach(ranked, spans, [date, season], "inner")
    kept = F.col("__limit").isNull() | (F.col("__n") - F.col("__in") <= F.col("__limit"))
    return rows.filter(kept).select("fold", "role", key, date, season)


def split_summary(rows: DataFrame, date: str) -> DataFrame:
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def split_problems(rows: DataFrame, date: str, key: str) -> DataFrame:
    """One row per broken rule: empty role, train/test overlap, train not before test, test windows going back or shared."""
    from pyspark.sql import Window

    shape = rows.groupBy("fold").agg(
        F.count(F.when(F.col("role") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("role") == "test", 1)).alias("n_test"),
        F.max(F.when(F.col("role") == "train", F.col(date))).alias("train_end"),
        F.min(F.when(F.col("role") == "test", F.col(date))).alias("test_start"),
        F.max(F.when(F.col("role") == "test", F.col(date))).alias("test_end"),
    )
    order = Window.orderBy("fold")  # one row per fold
    seen = shape.withColumns({"__ps": F.lag("test_start").over(order), "__pe": F.lag("test_end").over(order)})
    checks = {
        "empty train": F.col("n_train") == 0,
        "empty test": F.col("n_test") == 0,
        "time leakage": F.col("train_end") >= F.col("test_start"),
        "test window goes back": (F.col("test_start") < F.col("__ps")) | (F.col("test_end") < F.col("__pe")),
    }
    listed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    problems = seen.select("fold", F.explode(listed).alias("problem"))
    both = rows.groupBy("fold", key).agg(F.count_distinct("role").alias("__r")).filter("__r > 1")
    twice = rows.filter("role = 'test'").groupBy(key).agg(F.count(F.lit(1)).alias("__f"), F.max("fold").alias("fold")).filter("__f > 1")
    return (
        problems.unionByName(both.select("fold", F.lit("train/test overlap").alias("problem")).distinct())
        .unionByName(twice.select("fold", F.lit("test rows shared with an earlier fold").alias("problem")).distinct())
        .distinct()
    )


def require_valid(rows: DataFrame, date: str, key: str) -> None:
    found = split_problems(rows, date, key).filter(~F.col("problem").startswith("test rows shared")).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"fold {r['fold']}: {r['problem']}" for r in found))


def training_window(
    df: DataFrame, date: str, key: str, target: str, line: str | None, features: Sequence[str], games: int | None, min_line: float | None = None
) -> DataFrame:
    """Required columns with a known date and target, optional line floor, the last K rows by (date, key)."""
    wanted = list(dict.fromkeys([date, key, target, *([line] if line else []), *features]))
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}")
    number = {c: F.col(c).try_cast("double") for c in (target, line) if c}
    out = df.select(*wanted).withColumns(number).dropna(subset=[date, target])
    if line and min_line is not None:
        out = out.filter(F.col(line) > min_line)
    if games is None:
        return out
    return last_rows(out, date, key, games)


def last_rows(df: DataFrame, date: str, key: str, k: int) -> DataFrame:
    """The last k rows by (date, key): whole dates from the calendar, a rank only on the first one."""
    index = date_index(df, date)
    total = df.count()
    first = total - k
    placed = attach(with_position(df, [date], [key], "__in"), index, [date], "inner")
    return placed.filter(F.col("__start") + F.col("__in") >= first).drop("__in", "__start", "__on")


def window_metadata(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def merge_history(history: DataFrame, recent: DataFrame, key: str, season: str, seasons: int, features: Sequence[str]) -> DataFrame:
    """History and recent rows once per game, history first; the last seasons; numeric features in order."""
    fresh = recent.join(history.select(key), key, "left_anti")
    both = history.unionByName(fresh, allowMissingColumns=True)
    newest = both.agg(F.max(season)).first()[0]
    return both.filter(F.col(season) > newest - seasons).select(key, season, *[F.col(f).try_cast("double").alias(f) for f in features])


def entity_panel(games: DataFrame, keys: Sequence[str], paired: Sequence[str], target: Column, entity: str, order: Sequence[str], context: int):
    """Two rows per game and entity; the last N+1 per entity, marked context or final."""
    from priorline.operators.games import team_rows
    from priorline.skew import best_rows

    shaped = team_rows(games.withColumn("target", target), [*keys, "target"], paired).filter(F.col("target").isNotNull())
    kept = best_rows(shaped, [entity], [F.desc(c) for c in order], context + 1, "__back")
    return kept.withColumn("role", F.when(F.col("__back") == 1, "final").otherwise("context")).drop("__back")
