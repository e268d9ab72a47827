"""Per-entity windows that read only rows before the current one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from priorline.skew import CHECK, Total, attach, bounded_frames, find_hot_keys, narrower, running_totals, with_position


@dataclass(frozen=True)
class SeriesKeys:
    """Which columns name the entity, the season, the split (home/away) and the row order."""

    entity: str
    season: str
    split: str
    order: tuple[str, ...]


def prior(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-n, -1)


def prior_mean_name(value: str, n: int) -> str:
    return f"{value}_last_all_{n}_before"


def prior_means(df: DataFrame, keys: SeriesKeys, values: Sequence[str], sizes: Sequence[int], by_season: bool = False, hot=CHECK):
    """Mean of the last n earlier rows of the entity, one column per value and n, in one window."""
    partition = [keys.entity, keys.season] if by_season else [keys.entity]
    return bounded_frames(
        df,
        partition,
        keys.order,
        max(sizes),
        lambda w: [F.avg(v).over(prior(w, n)).alias(prior_mean_name(v, n)) for v in values for n in sizes],
        hot=hot,
    )


def look(df: DataFrame, keys: SeriesKeys, hot):
    """Look for hot entities once; the windows of one series share the answer."""
    return find_hot_keys(df, [keys.entity]) if isinstance(hot, str) else hot


def split_relative_means(df: DataFrame, keys: SeriesKeys, values: Sequence[str], n: int, by_season: bool = False, hot=CHECK) -> DataFrame:
    """Prior-n mean within the same split minus the prior-n mean over all rows; all values share one window."""
    hot = look(df, keys, hot)
    missing = [v for v in values if prior_mean_name(v, n) not in df.columns]
    out = prior_means(df, keys, missing, [n], by_season, narrower(hot)) if missing else df
    partition = [keys.entity, keys.season, keys.split] if by_season else [keys.entity, keys.split]
    same = bounded_frames(
        out, partition, keys.order, n, lambda w: [F.avg(v).over(prior(w, n)).alias(f"__same_{v}") for v in values], hot=narrower(hot)
    )
    made = {f"{v}_last_split_{n}_before": F.col(f"__same_{v}") - F.col(prior_mean_name(v, n)) for v in values}
    return same.withColumns(made).drop(*[f"__same_{v}" for v in values])


def split_relative_mean(df: DataFrame, keys: SeriesKeys, value: str, n: int, by_season: bool = False, hot=CHECK) -> DataFrame:
    return split_relative_means(df, keys, [value], n, by_season, hot)


def window_delta(df: DataFrame, keys: SeriesKeys, value: str, reference: int, n: int, by_season: bool = False):
    """Prior-``reference`` mean minus prior-``n`` mean."""
    missing = [s for s in (reference, n) if prior_mean_name(value, s) not in df.columns]
    out = prior_means(df, keys, [value], missing, by_season) if missing else df
    delta = F.col(prior_mean_name(value, reference)) - F.col(prior_mean_name(value, n))
    return out.withColumn(f"{value}_last_{reference}_minus_last_{n}_before", delta)


def season_means(df: DataFrame, keys: SeriesKeys, values: Sequence[str], fallback_rows: int = 5, hot=CHECK) -> DataFrame:
    """Season-to-date mean per split, else the previous season's mean, else the rolling mean.

    All values share one running pass, one aggregate and one join.
    """
    hot = look(df, keys, hot)
    missing = [v for v in values if prior_mean_name(v, fallback_rows) not in df.columns]
    out = prior_means(df, keys, missing, [fallback_rows], hot=hot) if missing else df
    shown = out.columns
    group = [keys.entity, keys.season, keys.split]
    totals = [Total(kind, F.col(v), f"__{kind}_{v}") for v in values for kind in ("sum", "count")]
    out = running_totals(out, group, keys.order, totals, hot=narrower(hot))
    before = previous_season(df, group, keys.season, [F.avg(v).alias(f"__prev_{v}") for v in values])
    out = attach(out, before, group, null_safe=False)

    def picked(v: str) -> Column:
        to_date = F.when(F.col(f"__count_{v}") > 0, F.col(f"__sum_{v}") / F.col(f"__count_{v}"))
        return F.coalesce(to_date, F.col(f"__prev_{v}"), F.col(prior_mean_name(v, fallback_rows)))

    return out.select(*shown, *[picked(v).alias(f"{v}_season_before_avg") for v in values])


def season_mean(df: DataFrame, keys: SeriesKeys, value: str, fallback_rows: int = 5, hot=CHECK) -> DataFrame:
    return season_means(df, keys, [value], fallback_rows, hot)


def season_stds(df: DataFrame, keys: SeriesKeys, values: Sequence[str], hot=CHECK) -> DataFrame:
    """Population std of the season so far, else the previous season's sample std.

    Running sums are taken of deviations from the season's first value, which keeps the difference
    of squares well conditioned.
    """
    group = [keys.entity, keys.season, keys.split]
    first = [F.min_by(v, F.when(F.col(v).isNotNull(), F.struct(*keys.order))).alias(f"__origin_{v}") for v in values]
    out = attach(df, df.groupBy(*group).agg(*first), group)
    totals = []
    for v in values:
        shifted = F.col(v) - F.col(f"__origin_{v}")
        totals += [
            Total("sum", shifted, f"__s_{v}"),
            Total("sum", shifted * shifted, f"__q_{v}"),
            Total("count", F.col(v), f"__n_{v}"),
        ]
    out = running_totals(out, group, keys.order, totals, hot=narrower(look(df, keys, hot)))
    before = previous_season(df, group, keys.season, [F.stddev_samp(v).alias(f"__prev_{v}") for v in values])
    out = attach(out, before, group, null_safe=False)

    def picked(v: str) -> Column:
        n, mean = F.col(f"__n_{v}"), F.col(f"__s_{v}") / F.col(f"__n_{v}")
        variance = F.greatest(F.col(f"__q_{v}") / n - mean * mean, F.lit(0.0))
        return F.coalesce(F.when(n > 0, F.sqrt(variance)), F.col(f"__prev_{v}"))

    return out.select(*df.columns, *[picked(v).alias(f"{v}_season_before_std") for v in values])


def season_std(df: DataFrame, keys: SeriesKeys, value: str, hot=CHECK) -> DataFrame:
    return season_stds(df, keys, [value], hot)


def previous_season(df: DataFrame, group: Sequence[str], season: str, stats: Sequence[Column]) -> DataFrame:
    """Group statistics keyed by the season that follows, ready to be joined as 'last season'."""
    totals = df.groupBy(*group).agg(*stats)
    return totals.withColumn(season, (F.col(season) + 1).cast(df.schema[season].dataType))


def weighted_mean_column(value: str, n: int, window: WindowSpec, row_index: Column) -> Column:
    """Linearly weighted mean of the last n earlier rows, newest heaviest.

    The series is shifted by one row first, so until the entity has n rows the empty leading place
    takes weight 1 and the oldest value weight 2; nulls keep their place.
    """
    frame = prior(window, n)
    start = F.greatest(row_index - F.lit(n - 1), F.lit(0))
    x = F.col(value)
    place = F.when(x.isNotNull(), row_index)
    total = F.sum(row_index * x).over(frame) + (2 - start) * F.sum(x).over(frame)
    weight = F.sum(place).over(frame) + (2 - start) * F.count(x).over(frame)
    return F.when(F.count(x).over(frame) > 0, total / weight)


def weighted_means(df: DataFrame, keys: SeriesKeys, values: Sequence[str], n: int, by_season: bool = False, hot=CHECK):
    hot = look(df, keys, hot)
    partition = [keys.entity, keys.season] if by_season else [keys.entity]
    known = narrower(hot) if by_season else hot
    out = with_position(df, partition, keys.order, "__row", hot=known)
    out = bounded_frames(
        out,
        partition,
        keys.order,
        n,
        lambda w: [weighted_mean_column(v, n, w, F.col("__row")).alias(f"{v}_wma_{n}_before") for v in values],
        hot=known,
    )
    return out.drop("__row")


def split_relative_weighted(df: DataFrame, keys: SeriesKeys, value: str, n: int, hot=CHECK) -> DataFrame:
    base = f"{value}_wma_{n}_before"
    hot = look(df, keys, hot)
    out = df if base in df.columns else weighted_means(df, keys, [value], n, hot=hot)
    partition = [keys.entity, keys.split]
    out = with_position(out, partition, keys.order, "__row", hot=narrower(hot))
    out = bounded_frames(
        out,
        partition,
        keys.order,
        n,
        lambda w: [weighted_mean_column(value, n, w, F.col("__row")).alias("__same")],
        hot=narrower(hot),
    )
    return out.withColumn(f"{value}_wma_split_{n}_before", F.col("__same") - F.col(base)).drop("__same", "__row")


def weighted_delta(df: DataFrame, keys: SeriesKeys, value: str, reference: int, n: int, hot=CHECK) -> DataFrame:
    out, hot = df, look(df, keys, hot)
    for size in (reference, n):
        if f"{value}_wma_{size}_before" not in out.columns:
            out = weighted_means(out, keys, [value], size, hot=hot)
    delta = F.col(f"{value}_wma_{reference}_before") - F.col(f"{value}_wma_{n}_before")
    return out.withColumn(f"{value}_wma_{reference}_minus_wma_{n}_before", delta)


def slope_name(value: str, n: int) -> str:
    return f"{value}_trend_slope_last_{n}_before"


def trend_slopes(
    df: DataFrame, keys: SeriesKeys, values: Sequence[str], n: int, shift_current: bool = True, by_split: bool = False, hot=CHECK
):
    """OLS slope over the non-null values among the last n rows of the season; null below two points.

    Points are numbered by a running count of non-null values, which differs from 1..m only by an
    offset and leaves the slope unchanged.  ``by_split`` reads only rows of the same split.
    """
    partition = [keys.entity, keys.season, *([keys.split] if by_split else [])]
    counts = [Total("count", F.col(v), f"__x_{v}") for v in values]
    known = narrower(look(df, keys, hot))
    out = running_totals(df, partition, keys.order, counts, include_current=True, hot=known)

    def slopes(w: WindowSpec) -> list[Column]:
        frame = prior(w, n) if shift_current else w.rowsBetween(-(n - 1), 0)
        return [
            F.when(F.count(v).over(frame) >= 2, F.regr_slope(F.col(v), F.col(f"__x_{v}").cast("double")).over(frame)).alias(
                slope_name(v, n)
            )
            for v in values
        ]

    return bounded_frames(out, partition, keys.order, n, slopes, hot=known).drop(*[f"__x_{v}" for v in values])


def split_relative_slopes(df: DataFrame, keys: SeriesKeys, values: Sequence[str], n: int, hot=CHECK) -> DataFrame:
    """Slope over the last n rows of the same split minus the slope over the last n rows."""
    hot = look(df, keys, hot)
    missing = [v for v in values if slope_name(v, n) not in df.columns]
    out = trend_slopes(df, keys, missing, n, hot=hot) if missing else df
    aside = {slope_name(v, n): f"__all_{v}" for v in values}
    same = trend_slopes(out.withColumnsRenamed(aside), keys, values, n, by_split=True, hot=hot)
    made = {f"{v}_trend_slope_split_{n}_before": F.col(slope_name(v, n)) - F.col(f"__all_{v}") for v in values}
    return same.withColumns(made).drop(*aside).withColumnsRenamed({a: name for name, a in aside.items()})


def slope_deltas(df: DataFrame, keys: SeriesKeys, values: Sequence[str], reference: int, n: int, hot=CHECK) -> DataFrame:
    """Slope over the last ``reference`` rows minus the slope over the last ``n``."""
    out, hot = df, look(df, keys, hot)
    for size in (reference, n):
        missing = [v for v in values if slope_name(v, size) not in out.columns]
        out = trend_slopes(out, keys, missing, size, hot=hot) if missing else out
    deltas = {f"{v}_trend_slope_last_{reference}_minus_last_{n}_before": F.col(slope_name(v, reference)) - F.col(slope_name(v, n)) for v in values}
    return out.withColumns(deltas)


def records(df: DataFrame, group: Sequence[str], order: Sequence[str], result: str) -> DataFrame:
    """Game number, wins and win ratio before each game; 0 before the first (the documented rule)."""
    win = F.when(F.col(result) == "W", 1).otherwise(0)
    loss = F.when(F.col(result) == "L", 1).otherwise(0)
    totals = [Total("count", F.lit(1), "__games"), Total("sum", win, "__w"), Total("sum", loss, "__l")]
    out = running_totals(df, group, order, totals)
    wins, losses = F.coalesce(F.col("__w"), F.lit(0)), F.coalesce(F.col("__l"), F.lit(0))
    return out.select(
        *df.columns,
        (F.col("__games") + 1).alias("game_number"),
        wins.alias("wins_before"),
        F.when(wins + losses > 0, wins / (wins + losses)).otherwise(0.0).alias("record_before"),
    )


def rest_days(df: DataFrame, group: Sequence[str], order: Sequence[str], date: str) -> DataFrame:
    """Days since the previous row of the group, 0 for the first."""
    return bounded_frames(
        df,
        group,
        order,
        1,
        lambda w: [F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)), F.lit(0)).alias("rest_days_before")],
    )


def season_running_mean(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, fill=None):
    """Mean of all earlier rows of the group."""
    out = running_totals(df, group, order, [Total("sum", F.col(value), "__s"), Total("count", F.col(value), "__n")])
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    return out.select(*df.columns, (mean if fill is None else F.coalesce(mean, F.lit(fill))).alias(name))


def expected_minus_conceded(df: DataFrame, group: Sequence[str], order: Sequence[str], expected: str, conceded: str):
    """Running mean of (expected - conceded) over earlier rows of the side, 0 before any."""
    out = df.withColumn("__gap", F.col(expected) - F.col(conceded))
    return season_running_mean(out, group, order, "__gap", "gap_mean_before", 0.0).drop("__gap")


def last_meetings(df: DataFrame, pair: Sequence[str], order: Sequence[str], value: str, n: int = 5) -> DataFrame:
    """The last n values of the same ordered pair, newest first, and their null-skipping mean."""
    lagged = [f"{value}_meeting_{i}_before" for i in range(1, n + 1)]
    out = bounded_frames(
        df, pair, order, n, lambda w: [F.lag(value, i).over(w).alias(c) for i, c in enumerate(lagged, start=1)]
    )
    present = F.filter(F.array(*lagged), lambda x: x.isNotNull())
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    return out.withColumn(f"{value}_meetings_mean_before", mean)


def fixed_weight_mean(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, weights, oldest_first=True):
    """Weighted mean of up to len(weights) earlier rows.

    ``oldest_first`` gives the first weight to the oldest row of the frame; otherwise the newest row
    gets it.
    """
    n = len(weights)
    out = bounded_frames(
        df,
        group,
        order,
        n,
        lambda w: [F.collect_list(F.struct(F.col(value).alias("x"))).over(prior(w, n)).alias("__seen")],
    )
    seen = F.transform("__seen", lambda s: s["x"])
    seen = seen if oldest_first else F.reverse(seen)
    pairs = F.arrays_zip(seen.alias("x"), F.slice(F.array(*[F.lit(float(x)) for x in weights]), 1, F.size(seen)).alias("w"))
    kept = F.filter(pairs, lambda p: p["x"].isNotNull())
    top = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["x"] * p["w"])
    bottom = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["w"])
    name = f"{value}_fixed_weight_{n}_before"
    return out.withColumn(name, F.when(F.size(kept) > 0, top / bottom)).drop("__seen")


def smooth(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """Mean of the current and up to n-1 earlier rows, for reports."""
    return bounded_frames(
        df, group, order, n, lambda w: [F.avg(value).over(w.rowsBetween(-(n - 1), 0)).alias(f"{value}_smooth_{n}")]
    )


def trailing_days(df: DataFrame, group: Sequence[str], date: str, value: str, days: Sequence[int], name: str):
    """Sum of ``value`` over the last n calendar days before the row's day, 0 when empty.

    Rows are first summed per day, so the range window sees one row per entity and day.
    """
    daily = df.groupBy(*group, date).agg(F.sum(value).alias("__day_total"))
    window = Window.partitionBy(*group).orderBy(F.unix_date(F.col(date)))
    sums = [
        F.coalesce(F.sum("__day_total").over(window.rangeBetween(-n, -1)), F.lit(0.0)).alias(name.format(n=n)) for n in days
    ]
    return attach(df, daily.select(*group, date, *sums), [*group, date])


def form_columns(
    df: DataFrame,
    keys: SeriesKeys,
    values: Sequence[str],
    means: Sequence[int] = (1, 2, 3, 5, 10),
    wma: int = 5,
    slope: int = 5,
    long_slope: int = 10,
    std: Sequence[str] = (),
    relative: bool = True,
) -> DataFrame:
    """All standard form columns of every value; values of one window kind share a single pass.

    With ``relative`` also the mean and slope within the split relative to all rows, and the
    differences between the middle and the longest mean and between both slopes.
    """
    hot = look(df, keys, CHECK)
    middle = 5 if 5 in means else max(means)
    out = prior_means(df, keys, values, list(means), hot=hot)
    out = weighted_means(out, keys, values, wma, hot=hot)
    out = trend_slopes(out, keys, values, slope, hot=hot)
    if relative:
        for v in values if max(means) > middle else []:
            out = window_delta(out, keys, v, middle, max(means))
        out = slope_deltas(out, keys, values, slope, long_slope, hot=hot)
        out = split_relative_means(out, keys, values, middle, hot=hot)
        out = split_relative_slopes(out, keys, values, slope, hot=hot)
    out = season_means(out, keys, values, middle, hot=hot)
    return season_stds(out, keys, std, hot=hot) if std else out


def form_families(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Columns of the dynamic families (name contains any pattern, case-insensitive), in table order."""
    lowered = [p.lower() for p in patterns]
    return [c for c in columns if any(p in c.lower() for p in lowered)]
