"""Accuracy, profit, consensus and contribution reports over prediction logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions import rowstats as R
from priorline.functions.odds import mixed_to_decimal, pick_of
from priorline.functions.text import first_known, normal_pick, slug
from priorline.skew import attach, best_rows, with_position

SCORER_EDGES = tuple(range(11))  # fixed values: strict thresholds of the scorers
REPORT_EDGES = (0.0, 0.5, 1.0, 1.5, 2.0)  # fixed values: inclusive thresholds of the app


def _share(hit: Column, among: Column) -> Column:
    return F.avg(F.when(among, hit.cast("double")))


def side_accuracy(actual: Column, predicted: Column, line: Column, min_edge: float | None = None) -> Column:
    """Share of non-push rows whose predicted side is right; with an edge only |edge| above it counts."""
    true, edge = F.signum(actual - line), F.signum(predicted - line)
    among = (true != 0) & (edge != 0)
    if min_edge is not None:
        among = (true != 0) & (F.abs(predicted - line) > min_edge)
    return _share(true == edge, among)


def thresholds(spark: SparkSession, values: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], "threshold double")


def accuracy_by_threshold(
    df: DataFrame, actual: str, predicted: str, line: str, edges: Sequence[float] = SCORER_EDGES, inclusive: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    """Per threshold: rows beyond it, their share and the side accuracy.

    Every threshold is a conditional aggregate of one pass, so rows are not multiplied.
    """
    edge = F.abs(F.col(predicted) - F.col(line))
    true, side = F.signum(F.col(actual) - F.col(line)), F.signum(F.col(predicted) - F.col(line))
    scored = (true != 0) & (side != 0)
    aggs = [F.count(F.lit(1)).alias("__all")]
    for i, t in enumerate(edges):
        far = edge >= t if inclusive else edge > t
        aggs.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.count(F.when(far, 1)).alias("n_games"),
                _share(true == side, far & scored).alias("accuracy"),
            ).alias(f"__t{i}")
        )
    wide = df.groupBy(*keys).agg(*aggs)
    rows = wide.select(*keys, "__all", F.explode(F.array(*[F.col(f"__t{i}") for i in range(len(edges))])).alias("t"))
    share = F.when(F.col("__all") > 0, F.col("t.n_games") / F.col("__all"))
    return rows.select(*keys, "t.threshold", "t.n_games", share.alias("share"), "t.accuracy")


def fold_metrics(df: DataFrame, fold: str, actual: str, predicted: str, line: str, edges: Sequence[float] = (2, 3, 4)) -> DataFrame:
    """MAE, RMSE, R2 and side accuracies per fold."""
    a, p, ln = F.col(actual), F.col(predicted), F.col(line)
    error = p - a
    out = df.filter(a.isNotNull() & p.isNotNull()).groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.sum(error * error) / (F.var_pop(a) * F.count(F.lit(1)))).alias("r2"),
        F.coalesce(side_accuracy(a, p, ln), F.lit(0.0)).alias("accuracy"),
        *[F.coalesce(side_accuracy(a, p, ln, e), F.lit(0.0)).alias(f"accuracy_edge_{e}") for e in edges],
    )
    return out


def trial_table(trials: DataFrame) -> DataFrame:
    return trials.orderBy("mae", F.desc("accuracy"), "rmse", "trial")


def trial_candidates(trials: DataFrame, tolerance: float | None = 0.1, pct: float | None = None) -> DataFrame:
    """Trials within the tolerance of the best MAE."""
    best = trials.agg(F.min("mae")).first()[0]
    cutoff = best * (1 + pct) if pct is not None else best + (tolerance or 0.0)
    return trials.filter(F.col("mae") <= cutoff)


def best_trial(trials: DataFrame, tolerance: float | None = 0.1, pct: float | None = None) -> DataFrame:
    """Among the candidates: highest accuracy, then RMSE, MAE, number."""
    candidates = trial_candidates(trials, tolerance, pct)
    return candidates.orderBy(F.desc("accuracy"), "rmse", "mae", "trial").limit(1)


def assemble_predictions(df: DataFrame, value: str, kind: str, line: str) -> DataFrame:
    """Raw model output to total, line error and pick."""
    if kind not in ("TOTAL_POINTS", "LINE_ERROR"):
        raise ValueError(f"unknown prediction kind {kind}")
    total = F.col(value) if kind == "TOTAL_POINTS" else F.col(line) + F.col(value)
    error = F.col(value) - F.col(line) if kind == "TOTAL_POINTS" else F.col(value)
    return df.withColumns({"pred_total": total, "pred_line_error": error, "pred_pick": pick_of(error), "prediction_kind": F.lit(kind)})


def betting_side(value: Column, line: Column) -> Column:
    return F.when(value > line, "over").when(value < line, "under")


def bet_profit(pick: Column, actual: Column, over: Column, under: Column) -> Column:
    """Result of a one-unit bet; 0 without a pick, without odds or on a push (the documented rule)."""
    win = F.when(pick == "over", over).otherwise(under) - 1
    settled = pick.isNotNull() & actual.isNotNull() & over.isNotNull() & under.isNotNull()
    return F.when(settled, F.when(pick == actual, win).otherwise(-1.0)).otherwise(0.0)


def betting_outcome(df: DataFrame, line: str, actual: str, predicted: str, side: str, over_odds: str, under_odds: str) -> DataFrame:
    """Sides, correctness and profit of a regressor, a classifier and their agreement."""
    out = df.withColumns({over_odds: mixed_to_decimal(F.col(over_odds)), under_odds: mixed_to_decimal(F.col(under_odds))})
    pick = normal_pick(F.col(side))
    out = out.withColumns(
        {
            "actual_side": betting_side(F.col(actual), F.col(line)),
            "regressor_side": betting_side(F.col(predicted), F.col(line)),
            "classifier_side": F.when(pick != "PUSH", F.lower(pick)),
        }
    )
    out = out.withColumn("both_side", F.when(F.col("regressor_side") == F.col("classifier_side"), F.col("regressor_side")))
    made = {}
    for m in ("regressor", "classifier", "both"):
        made[f"{m}_correct"] = F.coalesce(F.col(f"{m}_side") == F.col("actual_side"), F.lit(False))
        made[f"{m}_profit"] = bet_profit(F.col(f"{m}_side"), F.col("actual_side"), F.col(over_odds), F.col(under_odds))
    return out.withColumns(made)


def betting_summary(df: DataFrame, date: str, predicted: str, actual: str) -> DataFrame:
    """One row: bets, accuracy, total and average profit, per-day profit and stake; two-level aggregate by day."""
    resolved = F.col("actual_side").isNotNull()
    error = F.col(predicted) - F.col(actual)
    masks = {"regressor": resolved, "classifier": resolved, "both": resolved & F.col("both_side").isNotNull()}
    daily = [
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(resolved, 1)).alias("resolved"),
        F.sum(error).alias("e"),
        F.sum(F.abs(error)).alias("ae"),
        F.count(error).alias("ne"),
    ]
    for m, mask in masks.items():
        profit = F.when(mask, F.col(f"{m}_profit"))
        daily += [
            F.sum(profit).alias(f"{m}_p"),
            F.count(F.when(profit != 0, 1)).alias(f"{m}_b"),
            F.count(F.when(mask, 1)).alias(f"{m}_m"),
            F.count(F.when(mask & F.col(f"{m}_correct"), 1)).alias(f"{m}_c"),
        ]
    days = df.groupBy(date).agg(*daily)
    out = [
        F.sum("n").alias("n_games"),
        F.sum("resolved").alias("n_resolved"),
        F.count(date).alias("n_days"),
        (F.sum("e") / F.sum("ne")).alias("mean_error"),
        (F.sum("ae") / F.sum("ne")).alias("mean_abs_error"),
    ]
    for m in masks:
        active = F.col(f"{m}_m") > 0
        out += [
            F.sum(f"{m}_b").alias(f"{m}_bets"),
            (F.sum(f"{m}_c") / F.nullif(F.sum(f"{m}_m"), F.lit(0))).alias(f"{m}_accuracy"),
            F.coalesce(F.sum(f"{m}_p"), F.lit(0.0)).alias(f"{m}_total_profit"),
            (F.sum(f"{m}_p") / F.nullif(F.sum(f"{m}_b"), F.lit(0))).alias(f"{m}_profit_per_bet"),
            F.avg(F.when(active, F.col(f"{m}_p"))).alias(f"{m}_profit_per_day"),
            F.avg(F.when(active, F.col(f"{m}_b"))).alias(f"{m}_stake_per_day"),
        ]
    return days.agg(*out)


def daily_errors(df: DataFrame, date: str, predicted: str, actual: str) -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    known = df.filter(error.isNotNull())
    return known.groupBy(date).agg(F.count(F.lit(1)).alias("n_games"), F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mean_abs_error"))


def daily_accuracy(df: DataFrame, date: str) -> DataFrame:
    resolved = df.filter(F.col("actual_side").isNotNull())
    return resolved.groupBy(date).agg(
        F.count(F.lit(1)).alias("n_games"),
        F.avg(F.col("regressor_correct").cast("double")).alias("regressor_accuracy"),
        F.avg(F.col("classifier_correct").cast("double")).alias("classifier_accuracy"),
        _share(F.col("both_correct"), F.col("both_side").isNotNull()).alias("both_accuracy"),
    )


def pending_results(predictions: DataFrame, rows: DataFrame, *, game: str, total: str, points: str, result: str, matchup: str, low=110, real=140):
    """New totals for games whose result is missing or too small, from complete two-row games."""
    wanted = predictions.filter(F.col(total).isNull() | (F.col(total) < low)).select(game).distinct()
    found = rows.join(wanted, game, "left_semi")
    home = F.col(matchup).contains("vs.")
    sums = found.groupBy(game).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(points).alias("total_points"),
        F.max(F.when(home & F.col(result).isNotNull(), F.col(points))).alias("home_pts"),
        F.max(F.when(~home & F.col(result).isNotNull(), F.col(points))).alias("away_pts"),
    )
    real_games = (F.col("__n") == 2) & (F.col("total_points") >= real)
    return sums.filter(real_games).dropna(subset=["home_pts", "away_pts"]).drop("__n")


def model_catalogue(df: DataFrame, kind: str, source: str, name: str, stamp: str, last_marker: str, tie: Sequence[str]) -> DataFrame:
    """Latest label per model key, marked models last, then by label."""
    key = slug(first_known(F.col(kind), F.col(source), F.col(name), default=""))
    label = first_known(F.col(name), F.col(kind), F.col(source), default="Unknown Model")
    rows = df.select(key.alias("model_key"), label.alias("label"), stamp, *tie).filter(F.col("model_key").isNotNull())
    latest = best_rows(rows, ["model_key"], [F.col(stamp).desc_nulls_first(), F.desc("label"), *[F.desc(t) for t in tie]])
    marked = F.lower("label").contains(last_marker).alias("marked_last")
    return latest.select("model_key", "label", marked).orderBy("marked_last", "label")


def _known_predictions(log: DataFrame, stamp: str, total: str, error: str, line: str, kind: str, tag: str | None, tag_value: str | None, cutoff) -> DataFrame:
    """Rows of a tag up to a cutoff, total and error each worked out from the other; total-points rows are marked __prefer."""
    rows = log if tag is None else log.filter(F.trim(tag) == tag_value)
    if cutoff is not None:
        rows = rows.filter(F.col(stamp) <= F.lit(cutoff))
    rows = rows.withColumns(
        {
            total: F.coalesce(F.col(total), F.col(line) + F.col(error)),
            error: F.coalesce(F.col(error), F.col(total) - F.col(line)),
            "__prefer": (F.upper(kind) == "TOTAL_POINTS").cast("int"),
        }
    )
    return rows


def game_level(
    log: DataFrame,
    *,
    game: str,
    model: str,
    stamp: str,
    total: str,
    error: str,
    line: str,
    pick: str,
    kind: str,
    models: Sequence[str],
    ties: Sequence[str],
    tag: str | None = None,
    tag_value: str | None = None,
    cutoff=None,
) -> DataFrame:
    """Latest prediction per game and model (a total-points row wins equal stamps), pivoted by model.

    A model in the kept rows that ``models`` does not name is an error, so none is left out unseen.
    """
    rows = _known_predictions(log, stamp, total, error, line, kind, tag, tag_value, cutoff)
    unknown = F.raise_error(F.concat(F.lit("model without a column: "), F.coalesce(F.col(model).cast("string"), F.lit("null"))))
    rows = rows.withColumn(model, F.when(F.col(model).isin(list(models)), F.col(model)).otherwise(unknown))
    latest = best_rows(rows, [game, model], [F.desc(stamp), F.desc("__prefer"), *[F.desc(t) for t in ties]])
    wide = latest.groupBy(game).pivot(model, list(models)).agg(F.max(total).alias("total"), F.max(normal_pick(F.col(pick))).alias("pick"))
    return wide.withColumnsRenamed({f"{m}_{c}": f"{c}_{m}" for m in models for c in ("total", "pick")})


def game_level_open(
    log: DataFrame,
    *,
    game: str,
    model: str,
    stamp: str,
    total: str,
    error: str,
    line: str,
    pick: str,
    kind: str,
    base: Sequence[str],
    ties: Sequence[str],
    tag: str | None = None,
    tag_value: str | None = None,
    cutoff=None,
) -> DataFrame:
    """One row per game: ``base`` columns and stamp (latest_stamp) of its latest prediction, and ``models``.

    ``models`` maps every model found in the kept rows, listed anywhere or not, to its latest prediction
    (total, error, pick, stamp; a total-points row wins equal stamps).  Rows without a model are left out,
    as are games that have no others.  Null stamps are older than any other.  A map has one entry per
    model of the game, whatever the number of predictions.
    """
    rows = _known_predictions(log, stamp, total, error, line, kind, tag, tag_value, cutoff).filter(F.col(model).isNotNull())
    latest = best_rows(rows, [game, model], [F.desc(stamp), F.desc("__prefer"), *[F.desc(t) for t in ties]])
    made = F.struct(F.col(total).alias("total"), F.col(error).alias("error"), normal_pick(F.col(pick)).alias("pick"), F.col(stamp).alias("stamp"))
    # the latest row of a game is the latest of one of its models
    newest = F.struct(stamp, "__prefer", *ties, model)
    kept = F.max_by(F.struct(F.col(stamp).alias("latest_stamp"), *base), newest).alias("__base")
    models = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(model), made)))).alias("models")
    return latest.groupBy(game).agg(kept, models).select(game, "__base.*", "models")


def score_open(df: DataFrame, line: str, actual: str, models: str = "models") -> DataFrame:
    """Each model of the map gains line_diff, miss (total less actual), pick (its own, else the side of line_diff) and correct."""
    side = pick_of(F.col(actual) - F.col(line))

    def scored(_: Column, m: Column) -> Column:
        diff = m["total"] - F.col(line)
        chosen = F.coalesce(m["pick"], pick_of(diff))
        return F.struct(
            *[m[c].alias(c) for c in ("total", "error", "stamp")],
            diff.alias("line_diff"),
            (m["total"] - F.col(actual)).alias("miss"),
            chosen.alias("pick"),
            correct_pick(chosen, side).alias("correct"),
        )

    return df.withColumn(models, F.transform_values(models, scored))


def model_rows(df: DataFrame, models: str = "models") -> DataFrame:
    """One row per game and model: the other columns, ``model`` and the fields of its entry."""
    others = [c for c in df.columns if c != models]
    return df.select(*others, F.explode(models).alias("model", "__m")).select(*others, "model", "__m.*")


def score_models(df: DataFrame, models: Sequence[str], line: str, actual: str, resolved_pick: bool = True) -> DataFrame:
    """line_diff, pick, error and correctness per model from total_<model> and pick_<model>."""
    out = df.withColumn("actual_pick", pick_of(F.col(actual) - F.col(line)))
    made = {}
    for m in models:
        diff = F.col(f"total_{m}") - F.col(line)
        pick = F.coalesce(F.col(f"pick_{m}"), pick_of(diff)) if resolved_pick else pick_of(diff)
        made |= {
            f"line_diff_{m}": diff,
            f"pick_{m}": pick,
            f"error_{m}": F.col(f"total_{m}") - F.col(actual),
            f"correct_{m}": correct_pick(pick, F.col("actual_pick")),
        }
    return out.withColumns(made)


def correct_pick(pick: Column, actual: Column) -> Column:
    return F.coalesce((pick == actual) & actual.isin("OVER", "UNDER"), F.lit(False))


def consensus(df: DataFrame, models: Sequence[str], line: str, actual: str, without: Sequence[str] = ()) -> DataFrame:
    """Mean difference, the same without some models, majority vote, boldest model, and agreement."""
    diffs = [f"line_diff_{m}" for m in models]
    some = [f"line_diff_{m}" for m in models if m not in without]
    picks = [f"pick_{m}" for m in models]
    none = F.lit(None).cast("double")
    boldest = R.largest_abs_column(diffs)
    bold = F.coalesce(*[F.when(boldest == d, F.col(d)) for d in diffs])
    over, under = R.votes(picks, "OVER"), R.votes(picks, "UNDER")
    out = df.withColumns(
        {
            "line_diff_consensus": R.row_mean(diffs),
            "line_diff_reduced": R.row_mean(some) if some else none,
            "line_diff_bold": bold,
            "votes_over": over,
            "votes_under": under,
            "all_available": R.all_present([f"total_{m}" for m in models]),
        }
    )
    made = {}
    for name in ("consensus", "reduced", "bold"):
        diff = F.col(f"line_diff_{name}")
        made |= {
            f"pick_{name}": pick_of(diff),
            f"error_{name}": F.col(line) + diff - F.col(actual),
            f"correct_{name}": correct_pick(pick_of(diff), F.col("actual_pick")),
        }
    vote = F.when(F.col("votes_over") > F.col("votes_under"), "OVER").when(F.col("votes_under") > F.col("votes_over"), "UNDER")
    made |= {"pick_vote": vote, "correct_vote": correct_pick(vote, F.col("actual_pick"))}
    made["all_agree"] = R.all_agree(picks) & F.col("all_available")
    return out.withColumns(made)


def strategy_rows(df: DataFrame, strategies: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form (strategy, pick, error, correct, line_diff) in one pass."""
    entries = F.array(
        *[
            F.struct(
                F.lit(s).alias("strategy"),
                F.col(f"pick_{s}").alias("pick"),
                F.col(f"error_{s}").alias("error"),
                F.col(f"correct_{s}").alias("correct"),
                F.col(f"line_diff_{s}").alias("line_diff"),
            )
            for s in strategies
        ]
    )
    return df.select(*keep, F.explode(entries).alias("s")).select(*keep, "s.*")


def performance(df: DataFrame, strategies: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Games, accuracy, mean error, MAE and mean distance from the line over resolved picks."""
    rows = strategy_rows(df, strategies, ["actual_pick", *keys])
    valid = rows.filter(F.col("actual_pick").isin("OVER", "UNDER") & F.col("pick").isin("OVER", "UNDER"))
    return valid.groupBy(*keys, "strategy").agg(
        F.count(F.lit(1)).alias("n_games"),
        (F.avg(F.col("correct").cast("double")) * 100).alias("accuracy_pct"),
        F.avg("error").alias("mean_error"),
        F.avg(F.abs("error")).alias("mae"),
        F.avg(F.abs("line_diff")).alias("mean_abs_line_diff"),
    )


def performance_by_threshold(df: DataFrame, strategies: Sequence[str], edges: Sequence[float] = REPORT_EDGES) -> DataFrame:
    """Games and accuracy per strategy for |line_diff| at or beyond each threshold."""
    rows = strategy_rows(df, strategies, ["actual_pick"])
    valid = rows.filter(F.col("actual_pick").isin("OVER", "UNDER") & F.col("pick").isin("OVER", "UNDER"))
    size = F.abs("line_diff")
    aggs = [
        F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(size >= t, 1)).alias("n_games"), (_share(F.col("correct"), size >= t) * 100).alias("accuracy_pct")).alias(f"__t{i}")
        for i, t in enumerate(edges)
    ]
    wide = valid.groupBy("strategy").agg(*aggs)
    return wide.select("strategy", F.explode(F.array(*[F.col(f"__t{i}") for i in range(len(edges))])).alias("t")).select("strategy", "t.*")


def daily_metrics(df: DataFrame, strategies: Sequence[str], date: str) -> DataFrame:
    """Long (date, strategy) table of games, accuracy and MAE."""
    return performance(df, strategies, [date]).select(date, "strategy", "n_games", (F.col("accuracy_pct") / 100).alias("accuracy"), "mae")


def daily_pivot(metrics: DataFrame, date: str, strategies: Sequence[str], value: str) -> DataFrame:
    return metrics.groupBy(date).pivot("strategy", list(strategies)).agg(F.max(value))


def display(df: DataFrame, numbers: Mapping[str, int], labels: Mapping[str, str], stamp: str | None = None, zone: str = "Europe/Madrid"):
    """Rounded numbers, label names and local time text for reports."""
    from priorline.functions.dates import local_text

    out = df.withColumns({c: F.round(c, d) for c, d in numbers.items()})
    if stamp:
        out = out.withColumn(stamp, local_text(F.col(stamp), zone, "yyyy-MM-dd HH:mm"))
    return out.withColumnsRenamed(dict(labels))


def season_accuracy(df: DataFrame, season: str, actual: str, predicted: str, line: str, min_edge: float | None = None) -> DataFrame:
    """Games and side accuracy per season, optionally beyond an edge."""
    rows = df if min_edge is None else df.filter(F.abs(F.col(predicted) - F.col(line)) > min_edge)
    return rows.groupBy(season).agg(F.count(F.lit(1)).alias("n_games"), side_accuracy(F.col(actual), F.col(predicted), F.col(line)).alias("accuracy"))


def weighted_squared_error(actual: Column, predicted: Column, same=0.9, flip=1.0, extra=0.4, scale=6.0, push=1.0) -> Column:
    """Mean of w(err)^2: near-push rows weigh 1, right-side rows ``same``, wrong-side rows grow with the true edge."""
    error = predicted - actual
    ramp = F.least(F.lit(1.0), F.abs(actual) / scale)
    weight = F.when(F.abs(actual) < push, 1.0).when(actual * predicted < 0, flip + extra * ramp).otherwise(same)
    return F.avg(weight * error * error)


def top_contributions(long: DataFrame, row: Sequence[str], feature: str, value: str, k: int, positive: bool, ties: Sequence[str] = ()) -> DataFrame:
    """The k strongest contributions of one sign per row, serialised "f:+0.000,..." in order."""
    sign = F.col(value) > 0 if positive else F.col(value) < 0
    order = F.col(value).desc() if positive else F.col(value).asc()
    top = best_rows(long.filter(sign), row, [order, F.col(feature).asc(), *[F.col(t).asc() for t in ties]], k, "__k")
    item = F.struct("__k", F.format_string("%s:%+.3f", F.col(feature), F.col(value)).alias("t"))
    # At most k items per row reach the list.
    return top.groupBy(*row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), ",").alias("reasons"))


def contribution_confidence(long: DataFrame, row: Sequence[str], feature: str, value: str, margin: str, k: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """Directional confidence, support ratio, top-k sign agreement and the weighted score per row."""
    v = F.col(value)
    sums = long.groupBy(*row).agg(
        F.max(margin).alias("__m"),
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("__up"),
        F.coalesce(-F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("__down"),
    )
    top = best_rows(long, row, [F.abs(v).desc(), F.col(feature).asc(), *[F.col(t).asc() for t in ties]], k)
    agree = top.groupBy(*row).agg(F.avg((F.signum(v) == F.signum(margin)).cast("double")).alias("__agree"))
    both = attach(sums, agree, row)
    up, down, m = F.col("__up"), F.col("__down"), F.col("__m")
    total = up + down
    directional = F.when(total > 0, F.abs(up - down) / total).otherwise(0.0)
    support = F.when(m > 0, up / (down + 1e-9)).when(m < 0, down / (up + 1e-9)).otherwise(0.0)
    agreement = F.when(m == 0, 0.0).otherwise(F.coalesce("__agree", F.lit(0.0)))
    score = 0.5 * F.least(F.abs(m) / 3.0, F.lit(1.0)) + 0.3 * directional + 0.2 * agreement  # fixed weights
    return both.select(
        *row,
        directional.alias("directional_confidence"),
        support.alias("support_ratio"),
        agreement.alias("top_agreement"),
        score.alias("confidence_score"),
    )


CONFIDENCE_SHARES = (0.05, 0.10, 0.20, 0.30, 0.50, 1.0)  # fixed values


def confidence_quantiles(df: DataFrame, actual: str, predicted: str, key: str, shares: Sequence[float] = CONFIDENCE_SHARES) -> DataFrame:
    """For the most confident fraction of rows: count, sign accuracy without pushes, least and mean size.

    Rows get their place by (-|prediction|, key) without a single-task sort; each fraction is a
    conditional aggregate.
    """
    sized = df.select(key, F.col(actual).alias("__a"), F.col(predicted).alias("__p"), (-F.abs(predicted)).alias("__order"))
    placed = with_position(sized, [], ["__order", key], "__at")
    total = df.count()
    aggs = []
    for i, q in enumerate(shares):
        k = -(-int(round(q * total * 1e9)) // 10**9)
        inside = F.col("__at") < k
        right = F.signum("__a") == F.signum("__p")
        aggs.append(
            F.struct(
                F.lit(float(q)).alias("fraction"),
                F.lit(k).cast("long").alias("n_games"),
                _share(right, inside & (F.col("__a") != 0)).alias("accuracy"),
                F.min(F.when(inside, -F.col("__order"))).alias("min_abs"),
                F.avg(F.when(inside, -F.col("__order"))).alias("mean_abs"),
            ).alias(f"__q{i}")
        )
    wide = placed.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(f"__q{i}") for i in range(len(shares))])).alias("q")).select("q.*")
