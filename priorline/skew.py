"""Windows that stay correct and parallel when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.  The helpers here keep
that plan for ordinary keys and give keys with more than ``hot_rows`` rows a second plan: their rows
are range-partitioned by (key, order), each slice is processed on its own, and what crosses a slice
border travels as a small carry row (running totals) or as a few copied rows (bounded frames).
Results are the same on both plans; ``order`` must identify a row uniquely within its key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from priorline.session import cut_lineage

HOT_ROWS_SETTING = "spark.priorline.hotKeyRows"
HOT_ROWS = 2_000_000
GROUP_LIMIT = 1000  # Spark pre-trims row_number() <= k before the shuffle up to this k


def hot_rows_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on every key, as grouping treats nulls."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = True) -> DataFrame:
    """Join columns of ``small`` to ``df``, keeping one copy of the keys.

    Null-safe keys match as grouping does, but Spark then hashes (coalesce(k), isnull(k)) and cannot
    reuse a partitioning by k.  Where a null key has no meaning (no team, no season), plain equality
    saves that shuffle of the large side.
    """
    renamed = small.select(*[F.col(c).alias(f"__r_{c}" if c in keys else c) for c in small.columns])
    pairs = [(df[k], renamed[f"__r_{k}"]) for k in keys]
    terms = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    return df.join(renamed, reduce(lambda a, b: a & b, terms), how).drop(*[f"__r_{k}" for k in keys])


@dataclass
class HotKeys:
    keys: DataFrame | None  # None: the window has no key, so the whole table counts as one
    rows: int


def find_hot_keys(df: DataFrame, keys: Sequence[str]) -> HotKeys | None:
    """Keys with more rows than one task should sort.

    One column-pruned count per key with map-side partials.  At most rows/limit keys come out, and
    they are joined without a broadcast hint, so Spark picks the strategy from their real size.
    """
    limit = hot_rows_limit(df)
    if not keys:  # one window over the whole table
        rows = df.count()
        return HotKeys(None, rows) if rows > limit else None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > limit)
    total = counts.agg(F.sum("__rows")).first()[0]
    if not total:
        return None
    return HotKeys(cut_lineage(counts.select(*keys)), int(total))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


CHECK = "check"  # look for hot keys; None says the caller knows there are none


def _resolve(df: DataFrame, keys: Sequence[str], hot) -> HotKeys | None:
    return find_hot_keys(df, keys) if isinstance(hot, str) else hot


def narrower(hot):
    """What is known for a finer key on the same rows: no hot key stays none, a hot one needs a new look."""
    return None if hot is None else CHECK


def dated(df: DataFrame, date: str):
    """Rows made unique per key and calendar day cannot pile up, so the look is only needed for finer clocks."""
    return None if dict(df.dtypes)[date] == "date" else CHECK


def _split(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> tuple[DataFrame | None, DataFrame]:
    if hot.keys is None:
        return None, df
    marked = hot.keys.select(*[F.col(k).alias(f"__h_{k}") for k in keys])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
    return df.join(marked, condition, "left_anti"), df.join(marked, condition, "left_semi")


def deal_out(df: DataFrame, keys: Sequence[str], hot=CHECK) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys dealt out by key, rows of hot keys as they lie); either may be None.

    Every later grouping by the keys and more columns finds the dealt rows in place, so they are shuffled once.
    """
    hot = _resolve(df, keys, hot)
    if hot is None:
        return df.repartition(*keys), None
    cold, warm = _split(df, keys, hot)
    return None if cold is None else cold.repartition(*keys), warm


def _both(cold: DataFrame | None, columns: Sequence[Column], warm: DataFrame) -> DataFrame:
    return warm if cold is None else cold.select("*", *columns).unionByName(warm)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: HotKeys) -> DataFrame:
    """Rows with ``__slice``, increasing along (keys, order); written once so every reader agrees."""
    slices = max(2, math.ceil(2 * hot.rows / hot_rows_limit(df)))
    ranged = df.repartitionByRange(slices, *keys, *order)
    return cut_lineage(ranged.withColumn("__slice", F.spark_partition_id()))


def _positions(sliced: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Zero-based row position per key from slice-local numbers plus the sizes of earlier slices."""
    sizes = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__slice", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    local = Window.partitionBy(*keys, "__slice").orderBy(*order)
    numbered = sliced.withColumn("__local", F.row_number().over(local))
    joined = attach(numbered, offsets, [*keys, "__slice"])
    return joined.withColumn(name, F.col("__offset") + F.col("__local") - 1).drop("__offset", "__local", "__slice")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", hot=CHECK) -> DataFrame:
    """Zero-based dense position of each row within its key."""
    plain = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long").alias(name)
    hot = _resolve(df, keys, hot)
    if hot is None:
        return df.select("*", plain)
    cold, warm = _split(df, keys, hot)
    numbered = _positions(_sliced(warm, keys, order, hot), keys, order, name)
    return _both(cold, [plain], numbered)


def bounded_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    project: Callable[[WindowSpec], Sequence[Column]],
    hot=CHECK,
) -> DataFrame:
    """Add columns whose frames reach at most ``lookback`` rows back from the current row.

    ``project`` receives the ordered window and returns aliased columns.  Slices of a hot key are
    ``slot`` rows long and start with a copy of the ``lookback`` rows before them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    hot = _resolve(df, keys, hot)
    if hot is None:
        return df.select("*", *project(window))
    cold, warm = _split(df, keys, hot)
    slot = max(hot_rows_limit(df) // 2, 4 * lookback, 1)
    placed = _positions(_sliced(warm, keys, order, hot), keys, order, "__pos")
    home = F.floor(F.col("__pos") / slot)
    reach = F.when(F.col("__pos") % slot >= slot - lookback, F.array(home, home + 1)).otherwise(F.array(home))
    copied = placed.select("*", F.explode(reach).alias("__slot"))
    slotted = Window.partitionBy(*keys, "__slot").orderBy("__pos")
    result = copied.select("*", *project(slotted)).filter(F.floor(F.col("__pos") / slot) == F.col("__slot"))
    return _both(cold, project(window), result.drop("__pos", "__slot"))


@dataclass(frozen=True)
class Total:
    """A running aggregate: sum, count, min, max, first or last (non-null)."""

    kind: str
    value: Column
    name: str

    def fold(self) -> Column:
        return {
            "sum": F.sum,
            "count": F.count,
            "min": F.min,
            "max": F.max,
            "first": lambda c: F.first(c, ignorenulls=True),
            "last": lambda c: F.last(c, ignorenulls=True),
        }[self.kind](self.value)

    def merge(self, earlier: Column, later: Column) -> Column:
        if self.kind in ("sum", "count"):
            both = F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
            return both if self.kind == "count" else F.when(earlier.isNotNull() | later.isNotNull(), both)
        if self.kind == "min":
            return F.least(earlier, later)
        if self.kind == "max":
            return F.greatest(earlier, later)
        return F.coalesce(earlier, later) if self.kind == "first" else F.coalesce(later, earlier)

    def combine(self, carried: str) -> Column:
        """Fold slice results in slice order; used only on the carry table."""
        column = F.col(carried)
        kind = "sum" if self.kind == "count" else self.kind
        return Total(kind, column, self.name).fold()


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Sequence[Total],
    include_current: bool = False,
    hot=CHECK,
) -> DataFrame:
    """Add totals over all earlier rows of the key (optionally with the current one)."""
    end = 0 if include_current else -1

    def framed(*partition: str) -> WindowSpec:
        return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)

    plain = [t.fold().over(framed(*keys)).alias(t.name) for t in totals]
    hot = _resolve(df, keys, hot)
    if hot is None:
        return df.select("*", *plain)
    cold, warm = _split(df, keys, hot)
    sliced = _sliced(warm, keys, order, hot)
    local = sliced.select("*", *[t.fold().over(framed(*keys, "__slice")).alias(t.name) for t in totals])
    carries = _slice_results(sliced, [*keys, "__slice"], order, totals)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = carries.select(
        *keys, "__slice", *[t.combine(f"__c_{t.name}").over(before).alias(f"__p_{t.name}") for t in totals]
    )
    joined = attach(local, carried, [*keys, "__slice"])
    result = joined.select(
        *df.columns, *[t.merge(F.col(f"__p_{t.name}"), F.col(t.name)).alias(t.name) for t in totals]
    )
    return _both(cold, plain, result)


def _slice_results(sliced: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Sequence[Total]) -> DataFrame:
    """Whole-slice value of each total, as ordinary aggregates with map-side partials."""
    rank = F.struct(*order)

    def whole(t: Total) -> Column:
        if t.kind == "first":
            return F.min_by(t.value, F.when(t.value.isNotNull(), rank))
        if t.kind == "last":
            return F.max_by(t.value, F.when(t.value.isNotNull(), rank))
        return t.fold()

    return sliced.groupBy(*keys).agg(*[whole(t).alias(f"__c_{t.name}") for t in totals])


def best_rows(
    df: DataFrame, keys: Sequence[str], ordering: Sequence[Column], k: int | None = 1, rank: str | None = None, salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of each key, or all of them where ``k`` is None.

    Spark trims row_number() <= k before the shuffle while k is small; beyond that a salted first
    round does the same, so a hot key never arrives whole in one task.
    """
    name = rank or "__rank"
    trimmed = df
    if k is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering))) if rank else df
    if k > GROUP_LIMIT:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        first = Window.partitionBy(*keys, "__salt").orderBy(*ordering)
        trimmed = salted.withColumn("__first", F.row_number().over(first)).filter(F.col("__first") <= k)
        trimmed = trimmed.drop("__salt", "__first")
    window = Window.partitionBy(*keys).orderBy(*ordering)
    kept = trimmed.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[Column]) -> DataFrame:
    """Broadcast-free replacement of ``agg over (partition by keys)``: aggregate, then join back.

    The aggregate combines map-side and the join is split by AQE when a key is hot.
    """
    return attach(df, df.groupBy(*keys).agg(*stats), keys, "inner")
