"""Feature-table cleaning and missing-data policy."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.operators.columns import drop_matching
from priorline.operators.filters import few_nulls, valid_totals

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def useless_columns(df: DataFrame, null_pct: float = 50.0, protected: Sequence[str] = (), only_names: bool = False) -> list[str]:
    """String columns, _id and _name columns, mostly null ones and constants (null counts as a value).

    Nulls and extremes of every column come from one aggregate; a column is constant when its least
    and greatest value agree and nulls are all or nothing, so no distinct count is needed.
    """
    keep = set(protected)
    types = dict(df.dtypes)
    named = [c for c in df.columns if c not in keep and (types[c] == "string" or "_ID" in c.upper() or "_NAME" in c.upper())]
    rest = [c for c in df.columns if c not in keep and c not in named]
    if only_names or not rest:
        return named
    aggs = [F.count(F.lit(1)).alias("__all")]
    for i, c in enumerate(rest):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    total = row["__all"]
    out = list(named)
    for i, c in enumerate(rest):
        n = row[f"n{i}"]
        empty = total and 100.0 * (total - n) / total > null_pct
        constant = n == 0 or (n == total and row[f"a{i}"] == row[f"b{i}"])
        if empty or constant:
            out.append(c)
    return out


def _fingerprints(df: DataFrame, columns: Sequence[str], key: str, value) -> dict[str, tuple]:
    """Order-free content hash per column: xor of row hashes, with the non-null count; one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        x = value(F.col(c).cast("double"))
        aggs += [F.bit_xor(F.xxhash64(F.col(key), x)).alias(f"h{i}"), F.count(c).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"h{i}"], row[f"n{i}"]) for i, c in enumerate(columns)}


def _confirmed(df: DataFrame, pairs: Sequence[tuple[str, str]], value) -> set[tuple[str, str]]:
    """Pairs without a single differing row."""
    if not pairs:
        return set()
    aggs = [F.count(F.when(~value(F.col(a)).eqNullSafe(value(F.col(b))), 1)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    row = df.agg(*aggs).first()
    return {p for i, p in enumerate(pairs) if row[f"d{i}"] == 0}


def _same_content(df: DataFrame, key: str, columns: Sequence[str], value) -> list[tuple[str, str]]:
    prints = _fingerprints(df, columns, key, value)
    first: dict[tuple, str] = {}
    pairs = []
    for c in columns:
        if prints[c] in first:
            pairs.append((first[prints[c]], c))
        else:
            first[prints[c]] = c
    found = _confirmed(df, pairs, value)
    return [p for p in pairs if p in found]


def duplicate_columns(df: DataFrame, key: str, protected: Sequence[str] = ()) -> list[str]:
    """Numeric columns equal to an earlier one."""
    columns = [c for c in numeric_columns(df) if c != key]
    return [b for _, b in _same_content(df, key, columns, lambda x: x.cast("double")) if b not in protected]


def absolute_twins(df: DataFrame, key: str, protected: Sequence[str] = ()) -> list[str]:
    """Numeric columns whose absolute values equal an earlier column's, while the values do not."""
    columns = [c for c in numeric_columns(df) if c != key]
    exact = set(_same_content(df, key, columns, lambda x: x.cast("double")))
    pairs = _same_content(df, key, columns, lambda x: F.abs(x.cast("double")))
    return [b for a, b in pairs if (a, b) not in exact and b not in protected]


def correlated_columns(df: DataFrame, key: str, threshold: float = 0.99, protected: Sequence[str] = (), batch: int = 200) -> list[str]:
    """Columns whose |pearson| with a later column passes the threshold (the earlier one goes).

    Pairwise-complete correlations in batched aggregates: each batch is one pass with map-side partials.
    """
    columns = [c for c in numeric_columns(df) if c != key]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    hits = set()
    for at in range(0, len(pairs), batch):
        part = pairs[at : at + batch]
        aggs = []
        for i, (a, b) in enumerate(part):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs.append(F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))).alias(f"r{i}"))
        row = df.agg(*aggs).first()
        hits |= {a for i, (a, _) in enumerate(part) if row[f"r{i}"] is not None and abs(row[f"r{i}"]) > threshold}
    return [c for c in columns if c in hits and c not in protected]


@dataclass(frozen=True)
class MissingRules:
    """Name patterns (regular expressions, case-insensitive) of the policy's column sets."""

    required: tuple[str, ...] = ()
    keep_null: tuple[str, ...] = (r"_price_", r"^total_line_", r"^spread_", r"^ml_", r"pct_(bets|money)")
    zero_fill: tuple[str, ...] = (r"injured", r"absent", r"_effect")
    rolling: tuple[str, ...] = (r"_last_all_\d+_before", r"_last_split_\d+_before", r"_wma_\d+_before", r"_trend_slope_last_\d+_before")
    season: str = "_season_before_avg"


@dataclass(frozen=True)
class MissingPolicy:
    required: list[str] = field(default_factory=list)
    keep_null: list[str] = field(default_factory=list)
    zero_fill: list[str] = field(default_factory=list)
    infer: list[tuple[str, str]] = field(default_factory=list)
    flag: list[str] = field(default_factory=list)


def resolve_policy(columns: Sequence[str], rules: MissingRules, line: str | None = None, target: str | None = None) -> MissingPolicy:
    """Which columns are required, kept null, zero-filled, inferred from a season mean, or flagged."""

    def matching(patterns: Sequence[str]) -> list[str]:
        return [c for c in columns if any(re.search(p, c, re.IGNORECASE) for p in patterns)]

    required = [c for c in columns if c in rules.required or c in (line, target)]
    keep = [c for c in matching(rules.keep_null) if not any(re.search(p, c, re.IGNORECASE) for p in rules.rolling)]
    zero = [c for c in matching(rules.zero_fill) if c not in required]
    infer = []
    for c in columns:
        if c in required or c in keep or c in zero:
            continue
        for p in rules.rolling:
            if re.search(p, c, re.IGNORECASE):
                base = re.sub(p, rules.season, c, flags=re.IGNORECASE)
                if base in columns and base != c:
                    infer.append((c, base))
                break
    return MissingPolicy(sorted(required), sorted(set(keep) - set(required)), sorted(zero), infer, sorted(set(keep)))


def apply_policy(df: DataFrame, policy: MissingPolicy, flags: bool = False, keep_rows: bool = False) -> DataFrame:
    """Drop rows without required values, flag, infer rolling from season means, zero-fill."""
    out = df if keep_rows or not policy.required else df.dropna(subset=policy.required)
    numeric = set(numeric_columns(df))
    made: dict[str, Column] = {}
    if flags:
        made |= {f"{c}__is_missing": F.col(c).isNull().cast("tinyint") for c in policy.flag}
    made |= {c: F.coalesce(F.col(c), F.col(b)) for c, b in policy.infer if c in numeric and b in numeric}
    made |= {c: F.coalesce(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in policy.zero_fill if c in numeric}
    return out.withColumns(made) if made else out


def clean_for_training(
    df: DataFrame,
    key: str,
    line: str | None = None,
    least_line: float = 100.0,
    exclude: Sequence[str] = (),
    protected: Sequence[str] = (),
    null_pct: float = 50.0,
    correlation: float = 0.99,
    most_nulls: int | None = None,
    rules: MissingRules | None = None,
    keep_all: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Line filter, column cleaning, missing policy and row completeness in one go; protected columns always stay."""
    out = valid_totals(df, [line], least_line, strict=True) if line else df
    safe = [key, *protected, *([line] if line else [])]
    doomed = [c for c in drop_matching(out, exclude).columns] if exclude else out.columns
    out = out.select(*[c for c in out.columns if c in doomed or c in safe])
    out = out.drop(*useless_columns(out, null_pct, safe, only_names=keep_all))
    if not keep_all:
        out = out.drop(*duplicate_columns(out, key, safe))
        out = out.drop(*correlated_columns(out, key, correlation, safe))
        out = out.drop(*absolute_twins(out, key, safe))
    if rules is not None:
        out = apply_policy(out, resolve_policy(out.columns, rules, line))
    if most_nulls is not None:
        out = few_nulls(out, [c for c in out.columns if c != key], most_nulls, strict)
    return out


def frame_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Cells that differ between two frames: numbers beyond the tolerance, other values by equality, and lone rows.

    Both sides keep every row through a full join on null-safe keys.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    numeric = set(numeric_columns(left)) & set(numeric_columns(right))
    other = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__r_{c}") for c in shared], F.lit(True).alias("__right"))
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        condition = term if condition is None else condition & term
    both = left.withColumn("__left", F.lit(True)).join(other, condition, "full")
    entries = []
    for c in shared:
        a, b = F.col(c), F.col(f"__r_{c}")
        if c in numeric:
            differ = a.isNull() != b.isNull()
            differ = differ | F.coalesce(F.abs(a.cast("double") - b.cast("double")) > tolerance, F.lit(False))
        else:
            differ = ~a.eqNullSafe(b)
        entries.append(F.when(differ, F.struct(F.lit(c).alias("column_name"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))))
    lone = F.when(F.col("__right").isNull(), F.lit("left")).when(F.col("__left").isNull(), F.lit("right"))
    found = both.select(
        *[F.coalesce(F.col(k), F.col(f"__k_{k}")).alias(k) for k in keys],
        lone.alias("only_in"),
        F.explode(F.array_compact(F.array(*entries))).alias("d"),
    )
    return found.select(*keys, "only_in", "d.*")


def difference_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_differences"))
