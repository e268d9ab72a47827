"""Statistics across a family of columns of one row; nulls are skipped, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A family is a short list of columns known when the plan is built, so everything below is plain
# arithmetic and sort_array, which stay in generated code; nulls sort to the front of the array.
# NaN is expected to have become null when the data was read (see functions.odds.number).


def _doubles(columns: Sequence[str | Column]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]


def _add(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


def row_count(columns: Sequence) -> Column:
    return _add([c.isNotNull().cast("int") for c in _doubles(columns)])


def row_sum(columns: Sequence) -> Column:
    return _add([F.coalesce(c, F.lit(0.0)) for c in _doubles(columns)])


def row_mean(columns: Sequence) -> Column:
    n = row_count(columns)
    return F.when(n > 0, row_sum(columns) / n)


def squared_deviations(columns: Sequence, mean: Column) -> Column:
    return _add([F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in _doubles(columns)])


def sorted_deviations(columns: Sequence, center: Column) -> Column:
    return F.sort_array(F.array(*[F.abs(c - center) for c in _doubles(columns)]))


def row_std(columns: Sequence) -> Column:
    """Population std; a family of one column has none."""
    if len(columns) < 2:
        return F.lit(None).cast("double")
    n = row_count(columns)
    return F.when(n > 0, F.sqrt(squared_deviations(columns, row_mean(columns)) / n))


def row_range(columns: Sequence) -> Column:
    values = _doubles(columns)
    if len(values) < 2:
        return values[0] - values[0]
    return F.greatest(*values) - F.least(*values)


def row_sorted(columns: Sequence) -> Column:
    return F.sort_array(F.array(*_doubles(columns)))


def sorted_quantile(ordered: Column, n: Column, q: float) -> Column:
    """Linear interpolation between neighbours of a sorted array whose last n entries are not null."""
    place = (n - 1) * F.lit(q)
    first = F.size(ordered) - n
    low = F.floor(place).cast("int")
    below = F.get(ordered, first + low)
    above = F.get(ordered, first + F.ceil(place).cast("int"))
    return F.when(n > 0, below + (above - below) * (place - low))


def _quantile(columns: Sequence, q: float) -> Column:
    return sorted_quantile(row_sorted(columns), row_count(columns), q)


def row_median(columns: Sequence) -> Column:
    return _quantile(columns, 0.5)


def row_iqr(columns: Sequence) -> Column:
    return _quantile(columns, 0.75) - _quantile(columns, 0.25)


def row_mad(columns: Sequence) -> Column:
    """Median absolute deviation from the row median."""
    return sorted_quantile(sorted_deviations(columns, row_median(columns)), row_count(columns), 0.5)


def row_max_abs(columns: Sequence) -> Column:
    sizes = [F.abs(c) for c in _doubles(columns)]
    return F.greatest(*sizes) if len(sizes) > 1 else sizes[0]


def row_nulls(columns: Sequence[str]) -> Column:
    """Number of null columns in the row."""
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def row_null_names(columns: Sequence[str]) -> Column:
    """Comma list of the null columns' names."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])


def all_present(columns: Sequence[str]) -> Column:
    return row_nulls(columns) == 0


def all_agree(columns: Sequence[str]) -> Column:
    """True when the non-null values of the row are one and the same."""
    return F.size(F.array_except(F.array(*columns), F.array(F.lit(None)))) == 1


def votes(columns: Sequence[str], choice: str) -> Column:
    return _add([F.coalesce((F.col(c) == choice).cast("int"), F.lit(0)) for c in columns])


def largest_abs_column(columns: Sequence[str]) -> Column:
    """Name of the column with the largest absolute value; the first one wins a tie."""
    top = F.greatest(*[F.abs(F.col(c)) for c in columns]) if len(columns) > 1 else F.abs(F.col(columns[0]))
    return F.coalesce(*[F.when(F.abs(F.col(c)) == top, F.lit(c)) for c in columns])
