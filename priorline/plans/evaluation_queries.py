"""E, K5-K7, A14, Q: splits, evaluation, contributions, quality."""

from pyspark.sql import functions as F

from priorline.operators import evaluate as E
from priorline.operators import quality as Q
from priorline.operators import splits as S
from priorline.plans.registry import query
from priorline.plans.standins import rounded, standin, table

_ALL = {"0": "model_0", "1": "model_1", "2": "model_2"}
MODELS = list(_ALL.values())
TIES = ["line_no", "part_id", "run_id", "cents"]


def _games(spark, sf_dir):
    return standin(spark, sf_dir, "games")


def _scored(spark, sf_dir):
    return standin(spark, sf_dir, "scored")


# ---------------------------------------------------------------- E1-E7
@query(
    "e1_latest_holdout",
    """WITH d AS (SELECT game_date, count(*) AS n FROM games GROUP BY 1), a AS (SELECT game_date, coalesce(sum(n) OVER (ORDER BY game_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM d)
        SELECT game_id, CASE WHEN later < ceil(0.15 * (SELECT count(*) FROM games)) THEN 'test' ELSE 'dev' END AS role FROM games JOIN a USING (game_date)""",
    "games",
)
def e1(spark, sf_dir):
    return S.latest_holdout(_games(spark, sf_dir), "game_date", fraction=0.15).select("game_id", "role")


# Recursive walks over the calendar: a window that starts on day i ends on day e; succ leads to the next possible start.
_DAYS = """part AS (SELECT game_date AS d, season AS s, count(*) AS n, min(game_id) AS f FROM games GROUP BY 1, 2),
        day AS (SELECT d, sum(n) AS n, arg_min(s, f) AS s, month(d) IN (5, 6) AS barred, row_number() OVER (ORDER BY d) - 1 AS i, sum(sum(n)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS upto FROM part GROUP BY d),
        ends AS (SELECT a.i, a.s, a.d, a.upto - a.n AS before, min(b.i) AS e FROM day a JOIN day b ON b.upto >= a.upto - a.n + 30 GROUP BY ALL),
        fits AS (SELECT x.* FROM ends x JOIN day c ON c.i BETWEEN x.i AND x.e GROUP BY ALL HAVING count(*) FILTER (c.barred OR c.s <> x.s) = 0)"""
_WALK = """walk(i, fold) AS (SELECT min(i), 1 FROM cand UNION ALL SELECT succ.j, fold + 1 FROM walk JOIN succ ON succ.i = walk.i WHERE succ.j IS NOT NULL),
        test AS (SELECT fold, 'test' AS role, NULL::INTEGER AS season, a.d AS first_date, b.d AS last_date, NULL::BIGINT AS boundary_rows, (b.upto - a.upto + a.n)::BIGINT AS n_rows
          FROM walk JOIN fits ON fits.i = walk.i JOIN day a ON a.i = fits.i JOIN day b ON b.i = fits.e)"""
_SEASON_WALK = f"""WITH RECURSIVE {_DAYS},
        born AS (SELECT s, row_number() OVER (ORDER BY min(d), arg_min(f, d)) AS o, min(d) AS d0 FROM part WHERE s IS NOT NULL GROUP BY s),
        seen AS (SELECT x.i, x.d, x.before, born.s, row_number() OVER (PARTITION BY x.i ORDER BY o DESC) AS back FROM fits x JOIN born ON born.d0 < x.d),
        trained AS (SELECT seen.i, seen.s, min(part.d) AS first_date, max(part.d) AS last_date, sum(part.n)::BIGINT AS n_rows FROM seen JOIN part ON part.s = seen.s AND part.d < seen.d WHERE back <= 3 GROUP BY 1, 2),
        cand AS (SELECT i FROM trained GROUP BY i HAVING count(*) = 3 AND sum(n_rows) >= 300),
        onward AS (SELECT x.i, coalesce(min(b.i) + 1, (SELECT count(*) FROM day)) AS k FROM fits x LEFT JOIN day b ON b.upto >= x.before + 30 GROUP BY 1),
        succ AS (SELECT onward.i, min(cand.i) AS j FROM onward JOIN cand ON cand.i >= greatest(onward.i + 1, k) GROUP BY 1),
        {_WALK}
        SELECT fold, 'train' AS role, s AS season, first_date, last_date, NULL::BIGINT AS boundary_rows, n_rows FROM walk JOIN trained ON trained.i = walk.i UNION ALL SELECT * FROM test"""
_ANCHORED_WALK = f"""WITH RECURSIVE {_DAYS},
        cand AS (SELECT i FROM fits WHERE least(1000, before) >= 300),
        edge AS (SELECT x.i, x.before, least(1000, x.before) AS rows, min(b.i) AS first FROM fits x JOIN day b ON b.upto > x.before - least(1000, x.before) GROUP BY ALL),
        onward AS (SELECT x.i, coalesce(min(b.i) + 1, (SELECT count(*) FROM day)) AS k FROM fits x JOIN day z ON z.i = x.e LEFT JOIN day b ON b.upto >= z.upto + 30 GROUP BY 1),
        succ AS (SELECT onward.i, min(cand.i) AS j FROM onward JOIN cand ON cand.i >= greatest(onward.i + 1, k) GROUP BY 1),
        {_WALK},
        folds AS (SELECT fold, 'train' AS role, NULL::INTEGER AS season, b.d AS first_date, z.d AS last_date, (b.upto - before + rows)::BIGINT AS boundary_rows, rows::BIGINT AS n_rows
          FROM walk JOIN edge ON edge.i = walk.i JOIN day b ON b.i = edge.first JOIN day z ON z.i = walk.i - 1 UNION ALL SELECT * FROM test)"""


def _fold_games(spark, sf_dir):
    return _games(spark, sf_dir).select("game_id", "game_date", "season")


def _anchored(spark, sf_dir):
    return S.anchored_folds(_fold_games(spark, sf_dir), "game_date", "season", "game_id", test_games=30, train_games=1000)


@query("e2_season_folds", _SEASON_WALK, "games")
def e2(spark, sf_dir):
    return S.season_folds(_fold_games(spark, sf_dir), "game_date", "season", "game_id", train_seasons=3, test_games=30, min_train=300)


@query("e3_anchored_folds", f"{_ANCHORED_WALK} SELECT * FROM folds", "games")
def e3(spark, sf_dir):
    return _anchored(spark, sf_dir)


_EVEN = "SELECT fold AS old, row_number() OVER (ORDER BY fold) AS fold FROM (SELECT DISTINCT 1 + round_even(k * (n - 1) / 2, 0)::INTEGER AS fold FROM (SELECT max(fold) AS n FROM folds), range(3) t(k))"


@query("e4_chosen_folds", f"{_ANCHORED_WALK}, kept AS ({_EVEN}) SELECT kept.fold::INTEGER AS fold, folds.* EXCLUDE (fold) FROM folds JOIN kept ON folds.fold = kept.old", "games")
def e4(spark, sf_dir):
    return S.choose_folds(_anchored(spark, sf_dir), 3, "even")


@query(
    "e4_chosen_fold_rows",
    f"""{_ANCHORED_WALK}, kept AS ({_EVEN}), ranked AS (SELECT game_id, game_date, season, row_number() OVER (PARTITION BY game_date ORDER BY game_id DESC) AS back FROM games)
        SELECT kept.fold::INTEGER AS fold, role, game_id, game_date, ranked.season FROM folds JOIN kept ON folds.fold = kept.old
        JOIN ranked ON game_date BETWEEN first_date AND last_date AND (game_date > first_date OR boundary_rows IS NULL OR back <= boundary_rows)""",
    "games",
)
def e4_rows(spark, sf_dir):
    return S.fold_rows(_fold_games(spark, sf_dir), S.choose_folds(_anchored(spark, sf_dir), 3, "even"), "game_date", "season", "game_id")


_BY_YEAR = "SELECT f.season AS fold, CASE WHEN g.season = f.season THEN 'test' ELSE 'train' END AS role, g.game_id, g.game_date FROM (SELECT DISTINCT season FROM games WHERE season > 1996) f JOIN games g ON g.season BETWEEN f.season - 2 AND f.season"


@query("e5_split_summary", f"SELECT fold, role, count(*) AS n, min(game_date) AS first_date, max(game_date) AS last_date FROM ({_BY_YEAR}) GROUP BY 1, 2", "games")
def e5(spark, sf_dir):
    return S.split_summary(_year_folds(spark, sf_dir), "game_date")


def _year_folds(spark, sf_dir):
    return spark.sql(_BY_YEAR.replace("games", "{games}"), games=_games(spark, sf_dir))


@query(
    "e5_split_problems",
    f"""WITH r AS ({_BY_YEAR} UNION ALL SELECT 1999, 'train', game_id, game_date FROM games WHERE season = 1999 AND game_id % 2 = 0)
        SELECT fold, 'time leakage' AS problem FROM r GROUP BY 1 HAVING max(game_date) FILTER (role = 'train') >= min(game_date) FILTER (role = 'test')
        UNION ALL SELECT DISTINCT fold, 'train/test overlap' FROM (SELECT fold, game_id FROM r GROUP BY 1, 2 HAVING count(DISTINCT role) > 1)""",
    "games",
)
def e5_problems(spark, sf_dir):
    rows = _year_folds(spark, sf_dir)
    leak = rows.filter("fold = 1999 AND role = 'test' AND game_id % 2 = 0").withColumn("role", F.lit("train"))
    return S.split_problems(rows.unionByName(leak), "game_date", "game_id")


@query("e6_chronological", "SELECT game_id, row_number() OVER (ORDER BY game_date, game_id) - 1 AS position FROM games", "games")
def e6(spark, sf_dir):
    return S.chronological(_games(spark, sf_dir), "game_date", "game_id").select("game_id", "position")


@query(
    "e7_training_window",
    "SELECT game_id, game_date, total_line, home_pts + away_pts AS target FROM games WHERE total_line > 205 ORDER BY game_date DESC, game_id DESC LIMIT 1000",
    "games",
)
def e7(spark, sf_dir):
    games = _games(spark, sf_dir).withColumn("target", F.col("home_pts") + F.col("away_pts"))
    return S.training_window(games, "game_date", "game_id", "target", "total_line", [], 1000, 205.0).select("game_id", "game_date", "total_line", "target")


# ---------------------------------------------------------------- E8-E13
_TRUE, _EDGE = "sign(actual - line)", "sign(predicted_total - line)"
_HIT = f"avg(CASE WHEN {_TRUE} <> 0 AND {_EDGE} <> 0 THEN CAST({_TRUE} = {_EDGE} AS INTEGER) END)"


def _edge_hit(e):
    return f"avg(CASE WHEN {_TRUE} <> 0 AND abs(predicted_total - line) > {e} THEN CAST({_TRUE} = {_EDGE} AS INTEGER) END)"


@query("e8_side_accuracy", f"SELECT model, round({_HIT}, 8) AS accuracy, round({_edge_hit(3)}, 8) AS accuracy_edge_3 FROM scored GROUP BY 1", "scored")
def e8(spark, sf_dir):
    a, p, ln = F.col("actual"), F.col("predicted_total"), F.col("line")
    out = _scored(spark, sf_dir).groupBy("model").agg(E.side_accuracy(a, p, ln).alias("accuracy"), E.side_accuracy(a, p, ln, 3).alias("accuracy_edge_3"))
    return rounded(out, 8)


@query(
    "e9_accuracy_by_threshold",
    f"""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (abs(predicted_total - line) > t) AS n_games, round(count(*) FILTER (abs(predicted_total - line) > t) / count(*), 8) AS share,
        round(avg(CAST({_TRUE} = {_EDGE} AS INTEGER)) FILTER (abs(predicted_total - line) > t AND {_TRUE} <> 0 AND {_EDGE} <> 0), 8) AS accuracy
        FROM scored, (SELECT UNNEST(range(0, 11)) AS t) GROUP BY 1""",
    "scored",
)
def e9(spark, sf_dir):
    return rounded(E.accuracy_by_threshold(_scored(spark, sf_dir), "actual", "predicted_total", "line"), 8)


@query(
    "e10_fold_metrics",
    f"""SELECT season, count(*) AS n, round(avg(abs(predicted_total - actual)), 6) AS mae, round(sqrt(avg((predicted_total - actual) * (predicted_total - actual))), 6) AS rmse,
        round(1 - sum((predicted_total - actual) * (predicted_total - actual)) / (var_pop(actual) * count(*)), 6) AS r2, round(coalesce({_HIT}, 0), 8) AS accuracy,
        {', '.join(f'round(coalesce({_edge_hit(e)}, 0), 8) AS accuracy_edge_{e}' for e in (2, 3, 4))} FROM scored GROUP BY 1""",
    "scored",
)
def e10(spark, sf_dir):
    out = E.fold_metrics(_scored(spark, sf_dir), "season", "actual", "predicted_total", "line")
    return rounded(out.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "r2")}), 8)


def _trials(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS trial", "CAST(p_size AS DOUBLE) / 10 AS mae", "CAST(p_partkey % 97 AS DOUBLE) / 100 AS accuracy", "CAST(p_partkey % 89 AS DOUBLE) / 7 AS rmse"
    )


_TRIALS = "(SELECT p_partkey AS trial, CAST(p_size AS DOUBLE) / 10 AS mae, CAST(p_partkey % 97 AS DOUBLE) / 100 AS accuracy, CAST(p_partkey % 89 AS DOUBLE) / 7 AS rmse FROM part)"


@query("e11_trial_table", f"SELECT trial, round(mae, 6) AS mae, round(accuracy, 6) AS accuracy, round(rmse, 6) AS rmse FROM {_TRIALS}")
def e11(spark, sf_dir):
    return rounded(E.trial_table(_trials(spark, sf_dir)))


@query("k7_best_trial", f"SELECT trial, round(mae, 6) AS mae, round(accuracy, 6) AS accuracy, round(rmse, 6) AS rmse FROM {_TRIALS} WHERE mae <= (SELECT min(mae) FROM {_TRIALS}) + 0.1 ORDER BY accuracy DESC, rmse, mae, trial LIMIT 1")
def k7(spark, sf_dir):
    return rounded(E.best_trial(_trials(spark, sf_dir), 0.1))


@query("k7_trial_candidates", f"SELECT trial, round(mae, 6) AS mae FROM {_TRIALS} WHERE mae <= (SELECT min(mae) FROM {_TRIALS}) * 1.5")
def k7_candidates(spark, sf_dir):
    return rounded(E.trial_candidates(_trials(spark, sf_dir), None, 0.5).select("trial", "mae"))


_PICK = "CASE WHEN {0} > 0 THEN 'OVER' WHEN {0} < 0 THEN 'UNDER' WHEN {0} = 0 THEN 'PUSH' END"


@query(
    "e12_assemble",
    f"""SELECT game_id, line_no, part_id, run_id, cents, 'LINE_ERROR' AS prediction_kind, line + d AS pred_total, d AS pred_line_error, {_PICK.format('d')} AS pred_pick FROM (SELECT *, predicted_total - 215 AS d FROM scored)
        UNION ALL SELECT game_id, line_no, part_id, run_id, cents, 'TOTAL_POINTS', predicted_total, predicted_total - line, {_PICK.format('(predicted_total - line)')} FROM scored""",
    "scored",
)
def e12(spark, sf_dir):
    keep = ["game_id", *TIES, "prediction_kind", "pred_total", "pred_line_error", "pred_pick"]
    rows = _scored(spark, sf_dir).withColumn("raw", F.col("predicted_total") - 215)
    by_error = E.assemble_predictions(rows, "raw", "LINE_ERROR", "line").select(*keep)
    return by_error.unionByName(E.assemble_predictions(rows, "predicted_total", "TOTAL_POINTS", "line").select(*keep))


def _contributions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS row_id", "concat('f', CAST(l_partkey % 40 AS STRING)) AS feature", "CAST(CAST(round(l_quantity) AS INT) - 25 AS DOUBLE) / 8 AS value", "CAST(l_orderkey % 9 - 4 AS DOUBLE) AS margin",
        "l_partkey", "l_suppkey", "CAST(round(l_extendedprice * 100) AS BIGINT) AS price", "l_linenumber"
    )


_CONTRIBUTIONS = "c AS (SELECT l_orderkey AS row_id, concat('f', CAST(l_partkey % 40 AS VARCHAR)) AS feature, CAST(CAST(round(l_quantity) AS INTEGER) - 25 AS DOUBLE) / 8 AS value, CAST(l_orderkey % 9 - 4 AS DOUBLE) AS margin, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_linenumber FROM lineitem)"
_CTIES = ["l_partkey", "l_suppkey", "price", "l_linenumber"]


@query(
    "k5_top_contributions",
    f"""WITH {_CONTRIBUTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature, {', '.join(_CTIES)}) AS k FROM c WHERE value > 0)
        SELECT row_id, string_agg(printf('%s:%+.3f', feature, value), ',' ORDER BY k) AS reasons FROM r WHERE k <= 3 GROUP BY 1""",
)
def k5(spark, sf_dir):
    return E.top_contributions(_contributions(spark, sf_dir), ["row_id"], "feature", "value", 3, True, _CTIES)


@query(
    "e13_contribution_confidence",
    f"""WITH {_CONTRIBUTIONS}, s AS (SELECT row_id, max(margin) AS m, coalesce(sum(value) FILTER (value > 0), 0) AS u, coalesce(-sum(value) FILTER (value < 0), 0) AS d FROM c GROUP BY 1),
        t AS (SELECT row_id, avg(CAST(sign(value) = sign(margin) AS INTEGER)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature, {', '.join(_CTIES)}) AS k FROM c) WHERE k <= 10 GROUP BY 1),
        x AS (SELECT row_id, m, u, d, CASE WHEN u + d > 0 THEN abs(u - d) / (u + d) ELSE 0 END AS dc, CASE WHEN m = 0 THEN 0 ELSE g END AS ta FROM s JOIN t USING (row_id))
        SELECT row_id, round(dc, 6) AS directional_confidence, round(CASE WHEN m > 0 THEN u / (d + 1e-9) WHEN m < 0 THEN d / (u + 1e-9) ELSE 0 END, 2) AS support_ratio, round(ta, 6) AS top_agreement,
          round(0.5 * least(abs(m) / 3.0, 1.0) + 0.3 * dc + 0.2 * ta, 6) AS confidence_score FROM x""",
)
def e13(spark, sf_dir):
    out = E.contribution_confidence(_contributions(spark, sf_dir), ["row_id"], "feature", "value", "margin", 10, _CTIES)
    return rounded(out.withColumn("support_ratio", F.round("support_ratio", 2)))


@query(
    "k6_confidence_quantiles",
    f"""WITH p AS (SELECT actual - line AS a, abs(predicted_total - line) AS z, sign(predicted_total - line) AS s, row_number() OVER (ORDER BY abs(predicted_total - line) DESC, k) AS r, count(*) OVER () AS n
          FROM (SELECT *, game_id * 1000 + line_no * 10 + run_id % 10 AS k0, hash_key AS k FROM (SELECT *, {'concat(game_id, chr(45), line_no, chr(45), part_id, chr(45), run_id, chr(45), cents)'} AS hash_key FROM scored WHERE line IS NOT NULL)))
        SELECT q AS fraction, CAST(ceil(q * any_value(n)) AS BIGINT) AS n_games, round(avg(CAST(sign(a) = s AS INTEGER)) FILTER (r <= ceil(q * n) AND a <> 0), 8) AS accuracy,
          min(z) FILTER (r <= ceil(q * n)) AS min_abs, round(avg(z) FILTER (r <= ceil(q * n)), 8) AS mean_abs FROM p, (SELECT CAST(UNNEST([0.05, 0.1, 0.2, 0.3, 0.5, 1.0]) AS DOUBLE) AS q) GROUP BY 1""",
    "scored",
)
def k6(spark, sf_dir):
    rows = _scored(spark, sf_dir).filter("line IS NOT NULL")
    rows = rows.select(F.concat_ws("-", "game_id", *TIES).alias("k"), (F.col("actual") - F.col("line")).alias("a"), (F.col("predicted_total") - F.col("line")).alias("p"))
    return rounded(E.confidence_quantiles(rows, "a", "p", "k"), 8)


# ---------------------------------------------------------------- E14-E17
_SIDE = "CASE WHEN {0} > line THEN 'over' WHEN {0} < line THEN 'under' END"


def _profit(pick):
    return f"CASE WHEN {pick} IS NOT NULL AND a IS NOT NULL AND o IS NOT NULL AND u IS NOT NULL THEN CASE WHEN {pick} = a THEN CASE WHEN {pick} = 'over' THEN o ELSE u END - 1 ELSE -1.0 END ELSE 0.0 END"


_BETS = f"""b0 AS (SELECT *, {_SIDE.format('actual')} AS a, {_SIDE.format('predicted_total')} AS r, side_pick AS c, 1 + 100.0 / abs(over_odds) AS o, CASE WHEN under_odds > 1 THEN under_odds END AS u FROM scored),
    b1 AS (SELECT *, CASE WHEN r = c THEN r END AS b FROM b0),
    bets AS (SELECT *, coalesce(r = a, FALSE) AS rc, coalesce(c = a, FALSE) AS cc, coalesce(b = a, FALSE) AS bc, {_profit('r')} AS rp, {_profit('c')} AS cp, {_profit('b')} AS bp FROM b1)"""


def _bets(spark, sf_dir):
    return E.betting_outcome(_scored(spark, sf_dir), "line", "actual", "predicted_total", "side_pick", "over_odds", "under_odds")


@query(
    "e14_betting_outcome",
    f"""WITH {_BETS} SELECT game_id, line_no, part_id, run_id, cents, a AS actual_side, r AS regressor_side, c AS classifier_side, b AS both_side, rc AS regressor_correct, cc AS classifier_correct, bc AS both_correct,
        round(rp, 6) AS regressor_profit, round(cp, 6) AS classifier_profit, round(bp, 6) AS both_profit FROM bets""",
    "scored",
)
def e14(spark, sf_dir):
    made = [f"{m}_{c}" for c in ("side", "correct", "profit") for m in ("regressor", "classifier", "both")]
    return rounded(_bets(spark, sf_dir).select("game_id", *TIES, "actual_side", *made))


def _summary_sql():
    out, daily = [], []
    for m, x, mask in (("regressor", "r", "a IS NOT NULL"), ("classifier", "c", "a IS NOT NULL"), ("both", "b", "a IS NOT NULL AND b IS NOT NULL")):
        daily.append(f"sum({x}p) FILTER ({mask}) AS {m}_p, count(*) FILTER ({mask} AND {x}p <> 0) AS {m}_b, count(*) FILTER ({mask}) AS {m}_m, count(*) FILTER ({mask} AND {x}c) AS {m}_c")
        out.append(
            f"CAST(sum({m}_b) AS BIGINT) AS {m}_bets, round(sum({m}_c) / nullif(sum({m}_m), 0), 8) AS {m}_accuracy, round(coalesce(sum({m}_p), 0), 4) AS {m}_total_profit, round(sum({m}_p) / nullif(sum({m}_b), 0), 8) AS {m}_profit_per_bet, round(avg({m}_p) FILTER ({m}_m > 0), 6) AS {m}_profit_per_day, round(avg({m}_b) FILTER ({m}_m > 0), 6) AS {m}_stake_per_day"
        )
    return ", ".join(daily), ", ".join(out)


_DAILY, _OUT = _summary_sql()


@query(
    "e15_betting_summary",
    f"""WITH {_BETS}, d AS (SELECT game_date, count(*) AS n, count(a) AS res, sum(predicted_total - actual) AS e, sum(abs(predicted_total - actual)) AS ae, {_DAILY} FROM bets GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_games, CAST(sum(res) AS BIGINT) AS n_resolved, count(*) AS n_days, round(sum(e) / sum(n), 8) AS mean_error, round(sum(ae) / sum(n), 8) AS mean_abs_error, {_OUT} FROM d""",
    "scored",
)
def e15(spark, sf_dir):
    out = E.betting_summary(_bets(spark, sf_dir), "game_date", "predicted_total", "actual")
    four = {c: F.round(c, 4) for c in out.columns if c.endswith("_total_profit")}
    six = {c: F.round(c, 6) for c in out.columns if c.endswith("_per_day")}
    return rounded(out.withColumns({**four, **six}), 8)


@query(
    "e16_daily_errors",
    "SELECT game_date, count(*) AS n_games, round(avg(predicted_total - actual), 6) AS mean_error, round(avg(abs(predicted_total - actual)), 6) AS mean_abs_error FROM scored GROUP BY 1",
    "scored",
)
def e16(spark, sf_dir):
    return rounded(E.daily_errors(_scored(spark, sf_dir), "game_date", "predicted_total", "actual"))


@query(
    "e16_daily_accuracy",
    f"WITH {_BETS} SELECT game_date, count(*) AS n_games, round(avg(rc::INT), 6) AS regressor_accuracy, round(avg(cc::INT), 6) AS classifier_accuracy, round(avg(bc::INT) FILTER (b IS NOT NULL), 6) AS both_accuracy FROM bets WHERE a IS NOT NULL GROUP BY 1",
    "scored",
)
def e16_accuracy(spark, sf_dir):
    return rounded(E.daily_accuracy(_bets(spark, sf_dir), "game_date"))


@query(
    "e17_pending_results",
    """SELECT game_id, home_pts + away_pts AS total_points, home_pts, away_pts FROM games WHERE (total_line IS NULL OR total_line < 205) AND home_pts + away_pts >= 200 AND home_pts <> away_pts""",
    "games",
)
def e17(spark, sf_dir):
    rows = standin(spark, sf_dir, "team_games").withColumn("matchup", F.when(F.col("home"), "A vs. B").otherwise("B @ A"))
    return E.pending_results(_games(spark, sf_dir), rows, game="game_id", total="total_line", points="pts", result="wl", matchup="matchup", low=205, real=200)


# ---------------------------------------------------------------- E18-E24
@query(
    "e18_model_catalogue",
    "SELECT model AS model_key, model AS label, contains(model, '_2') AS marked_last FROM (SELECT DISTINCT model FROM predictions)",
    "predictions",
)
def e18(spark, sf_dir):
    rows = standin(spark, sf_dir, "predictions").withColumn("blank", F.lit(" "))
    return E.model_catalogue(rows, "blank", "model", "blank", "predicted_on", "_2", TIES)


_LATEST = """lp AS (SELECT * FROM (SELECT *, CASE WHEN prediction_type = 'TOTAL_POINTS' THEN predicted_total END AS tot, CASE WHEN prediction_type <> 'TOTAL_POINTS' THEN predicted_total - line END AS err FROM scored WHERE {{tagged}} AND predicted_on <= DATE '2000-12-31')
      QUALIFY row_number() OVER (PARTITION BY game_id, model ORDER BY predicted_on DESC, CASE WHEN prediction_type = 'TOTAL_POINTS' THEN 1 ELSE 0 END DESC, line_no DESC, part_id DESC, run_id DESC, cents DESC) = 1),
    wide AS (SELECT game_id, {cols} FROM lp GROUP BY 1)"""
_WIDE = ", ".join(f"max(coalesce(tot, line + err)) FILTER (model = '{m}') AS total_{m}, max(upper(side_pick)) FILTER (model = '{m}') AS pick_{m}" for m in MODELS)
_LATEST = _LATEST.format(cols=_WIDE)
_TAGGED = _LATEST.format(tagged="trim(tag) = 'N'")
_LATEST = _LATEST.format(tagged="true")


def _wide(spark, sf_dir, tag_value=None):
    log = _scored(spark, sf_dir)
    direct = F.col("prediction_type") == "TOTAL_POINTS"
    log = log.withColumns(
        {"tot": F.when(direct, F.col("predicted_total")), "err": F.when(~direct, F.col("predicted_total") - F.col("line"))}
    )
    return E.game_level(
        log, game="game_id", model="model", stamp="predicted_on", total="tot", error="err", line="line", pick="side_pick", kind="prediction_type", models=MODELS, ties=TIES,
        tag=tag_value and "tag", tag_value=tag_value, cutoff="2000-12-31",
    )


@query("e19_game_level", f"WITH {_LATEST} SELECT * FROM wide", "scored")
def e19(spark, sf_dir):
    return _wide(spark, sf_dir)


@query("e19_game_level_tagged", f"WITH {_TAGGED} SELECT * FROM wide", "scored")
def e19_tagged(spark, sf_dir):
    return _wide(spark, sf_dir, "N")


@query(
    "e19_open_models",
    """WITH p AS (SELECT *, model || '_' || lower(trim(tag)) AS m, CASE WHEN prediction_type = 'TOTAL_POINTS' THEN predicted_total ELSE line + (predicted_total - line) END AS tot,
             predicted_total - line AS err, (prediction_type = 'TOTAL_POINTS')::INT AS prefer
           FROM scored WHERE predicted_on <= DATE '2000-12-31' AND model IS NOT NULL AND tag IS NOT NULL),
      one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY game_id, m ORDER BY predicted_on DESC, prefer DESC, line_no DESC, part_id DESC, run_id DESC, cents DESC) = 1),
      base AS (SELECT game_id, game_date AS base_date, line AS base_line, actual AS base_actual, predicted_on AS latest_stamp FROM p
               QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY predicted_on DESC, prefer DESC, line_no DESC, part_id DESC, run_id DESC, cents DESC, m DESC) = 1),
      s AS (SELECT *, tot - base_line AS d, CASE WHEN base_actual > base_line THEN 'OVER' WHEN base_actual < base_line THEN 'UNDER' WHEN base_actual = base_line THEN 'PUSH' END AS side,
             coalesce(upper(side_pick), CASE WHEN tot > base_line THEN 'OVER' WHEN tot < base_line THEN 'UNDER' WHEN tot = base_line THEN 'PUSH' END) AS chosen
            FROM one JOIN base USING (game_id))
    SELECT game_id, latest_stamp, base_date AS game_date, base_line, base_actual, m AS model, round(tot, 8) AS total, round(err, 8) AS error, predicted_on AS stamp, round(d, 8) AS line_diff,
      round(tot - base_actual, 8) AS miss, chosen AS pick, coalesce(chosen = side AND side IN ('OVER', 'UNDER'), false) AS correct FROM s""",
    "scored",
)
def e19_open(spark, sf_dir):
    log = _scored(spark, sf_dir).withColumn("m", F.concat("model", F.lit("_"), F.lower(F.trim("tag"))))
    direct = F.col("prediction_type") == "TOTAL_POINTS"
    log = log.withColumns({"tot": F.when(direct, F.col("predicted_total")), "err": F.when(~direct, F.col("predicted_total") - F.col("line"))})
    log = log.withColumns({"base_line": F.col("line"), "base_actual": F.col("actual")})
    out = E.game_level_open(
        log, game="game_id", model="m", stamp="predicted_on", total="tot", error="err", line="line", pick="side_pick", kind="prediction_type",
        base=["game_date", "base_line", "base_actual"], ties=TIES, cutoff="2000-12-31",
    )
    return rounded(E.model_rows(E.score_open(out, "base_line", "base_actual")), 8)


def _consensus(spark, sf_dir):
    results = _games(spark, sf_dir).selectExpr("game_id", "game_date", "total_line AS line", "home_pts + away_pts AS actual")
    scored = E.score_models(_wide(spark, sf_dir).join(results, "game_id"), MODELS, "line", "actual")
    return E.consensus(scored, MODELS, "line", "actual", without=["model_2"])


def _cons_sql():
    diffs = ", ".join(f"total_{m} - line AS d_{m}" for m in MODELS)
    picks = ", ".join(f"coalesce(pick_{m}, {_PICK.format(f'(total_{m} - line)')}) AS p_{m}" for m in MODELS)
    listed = "list_filter([d_model_0, d_model_1, d_model_2], lambda x: x IS NOT NULL)"
    some = "list_filter([d_model_0, d_model_1], lambda x: x IS NOT NULL)"
    big = "greatest(abs(d_model_0), abs(d_model_1), abs(d_model_2))"
    votes = lambda s: f"len(list_filter([p_model_0, p_model_1, p_model_2], lambda x: x = '{s}'))"
    return f"""{_LATEST}, x AS (SELECT w.*, game_date, g.total_line AS line, home_pts + away_pts AS actual FROM wide w JOIN games g USING (game_id)),
    y AS (SELECT *, {_PICK.format('(actual - line)')} AS ap, {diffs}, {picks} FROM x),
    z AS (SELECT *, list_avg({listed}) AS d_consensus, list_avg({some}) AS d_reduced,
        CASE WHEN abs(d_model_0) = {big} THEN d_model_0 WHEN abs(d_model_1) = {big} THEN d_model_1 WHEN abs(d_model_2) = {big} THEN d_model_2 END AS d_bold,
        CAST({votes('OVER')} AS INTEGER) AS votes_over, CAST({votes('UNDER')} AS INTEGER) AS votes_under,
        total_model_0 IS NOT NULL AND total_model_1 IS NOT NULL AND total_model_2 IS NOT NULL AS all_available,
        len(list_distinct(list_filter([p_model_0, p_model_1, p_model_2], lambda e: e IS NOT NULL))) = 1 AS agree FROM y),
    cons AS (SELECT *, {_PICK.format('d_consensus')} AS p_consensus, {_PICK.format('d_reduced')} AS p_reduced, {_PICK.format('d_bold')} AS p_bold,
        CASE WHEN votes_over > votes_under THEN 'OVER' WHEN votes_under > votes_over THEN 'UNDER' END AS p_vote FROM z)"""


_CONS = _cons_sql()
_RIGHT = "coalesce(p_{0} = ap AND ap IN ('OVER', 'UNDER'), FALSE)"


@query(
    "e20_consensus",
    f"""WITH {_CONS} SELECT game_id, {', '.join(f'round(d_{s}, 6) AS line_diff_{s}, p_{s} AS pick_{s}, {_RIGHT.format(s)} AS correct_{s}, round(line + d_{s} - actual, 6) AS error_{s}' for s in ('consensus', 'reduced', 'bold'))},
        votes_over, votes_under, p_vote AS pick_vote, {_RIGHT.format('vote')} AS correct_vote, all_available, agree AND all_available AS all_agree FROM cons""",
    "scored games",
)
def e20(spark, sf_dir):
    names = [f"{c}_{s}" for s in ("consensus", "reduced", "bold") for c in ("line_diff", "pick", "correct", "error")]
    return rounded(_consensus(spark, sf_dir).select("game_id", *names, "votes_over", "votes_under", "pick_vote", "correct_vote", "all_available", "all_agree"))


STRATEGIES = [*MODELS, "consensus", "bold"]
_LONG = " UNION ALL ".join(
    f"SELECT game_date, '{s}' AS strategy, p_{s} AS p, {_RIGHT.format(s)} AS ok, {'line + d_' + s + ' - actual'} AS e, d_{s} AS d FROM cons WHERE ap IN ('OVER', 'UNDER') AND p_{s} IN ('OVER', 'UNDER')" for s in STRATEGIES
)


@query(
    "e21_model_performance",
    f"WITH {_CONS}, l AS ({_LONG}) SELECT strategy, count(*) AS n_games, round(avg(ok::INT) * 100, 6) AS accuracy_pct, round(avg(e), 6) AS mean_error, round(avg(abs(e)), 6) AS mae, round(avg(abs(d)), 6) AS mean_abs_line_diff FROM l GROUP BY 1",
    "scored games",
)
def e21(spark, sf_dir):
    return rounded(E.performance(_consensus(spark, sf_dir), STRATEGIES))


@query(
    "e22_threshold_accuracy",
    f"WITH {_CONS}, l AS ({_LONG}) SELECT strategy, t AS threshold, count(*) FILTER (abs(d) >= t) AS n_games, round(avg(ok::INT) FILTER (abs(d) >= t) * 100, 6) AS accuracy_pct FROM l, (SELECT CAST(UNNEST([0, 0.5, 1, 1.5, 2]) AS DOUBLE) AS t) GROUP BY 1, 2",
    "scored games",
)
def e22(spark, sf_dir):
    return rounded(E.performance_by_threshold(_consensus(spark, sf_dir), STRATEGIES))


@query(
    "e23_daily_metrics",
    f"WITH {_CONS}, l AS ({_LONG}) SELECT game_date, strategy, count(*) AS n_games, round(avg(ok::INT), 6) AS accuracy, round(avg(abs(e)), 6) AS mae FROM l GROUP BY 1, 2",
    "scored games",
)
def e23(spark, sf_dir):
    return rounded(E.daily_metrics(_consensus(spark, sf_dir), STRATEGIES, "game_date"))


@query(
    "e23_daily_pivot",
    f"WITH {_CONS}, l AS ({_LONG}) SELECT game_date, {', '.join(f'''round(avg(abs(e)) FILTER (strategy = '{s}'), 6) AS {s}''' for s in STRATEGIES)} FROM l GROUP BY 1",
    "scored games",
)
def e23_pivot(spark, sf_dir):
    metrics = E.daily_metrics(_consensus(spark, sf_dir), STRATEGIES, "game_date")
    return rounded(E.daily_pivot(metrics, "game_date", STRATEGIES, "mae"))


@query(
    "e24_display",
    "SELECT event_id AS \"Event\", round(value, 1) AS \"Value\", strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid', '%Y-%m-%d %H:%M') AS ts FROM events",
)
def e24(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return E.display(rows, {"value": 1}, {"event_id": "Event", "value": "Value"}, "ts")


# ---------------------------------------------------------------- E25-E29, A14
@query(
    "e25_training_set",
    """WITH a AS (SELECT game_id, season, total_line, home_pts FROM games WHERE game_date < DATE '2000-06-01'), b AS (SELECT game_id, season, total_line + 1 AS total_line, home_pts FROM games WHERE game_date >= DATE '2000-01-01')
        SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE game_id NOT IN (SELECT game_id FROM a)) WHERE season > (SELECT max(season) FROM games) - 4""",
    "games",
)
def e25(spark, sf_dir):
    games = _games(spark, sf_dir).select("game_id", "season", "game_date", "total_line", "home_pts")
    recent = games.filter("game_date >= '2000-01-01'").withColumn("total_line", F.col("total_line") + 1)
    return S.merge_history(games.filter("game_date < '2000-06-01'"), recent, "game_id", "season", 4, ["total_line", "home_pts"])


@query("e26_window_metadata", "SELECT count(*) AS n_rows, min(game_date) AS first_date, max(game_date) AS last_date FROM games", "games")
def e26(spark, sf_dir):
    return S.window_metadata(_games(spark, sf_dir), "game_date")


@query("e27_season_accuracy", f"SELECT season, count(*) AS n_games, round({_HIT}, 8) AS accuracy FROM scored WHERE abs(predicted_total - line) > 2 GROUP BY 1", "scored")
def e27(spark, sf_dir):
    return rounded(E.season_accuracy(_scored(spark, sf_dir), "season", "actual", "predicted_total", "line", 2), 8)


@query("a14_season_accuracy", f"SELECT season, count(*) AS n_games, round({_HIT}, 8) AS accuracy FROM scored GROUP BY 1", "scored")
def a14(spark, sf_dir):
    return rounded(E.season_accuracy(_scored(spark, sf_dir), "season", "actual", "predicted_total", "line"), 8)


@query(
    "e28_entity_panel",
    """WITH t AS (SELECT game_id, game_date, team_id AS team, pts, home AS is_home, 2 * pts - plus_minus - total_line AS target FROM team_games WHERE total_line IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game_id DESC) AS k FROM t)
        SELECT game_id, game_date, team, pts, is_home, target, CASE WHEN k = 1 THEN 'final' ELSE 'context' END AS role FROM r WHERE k <= 16""",
    "team_games",
)
def e28(spark, sf_dir):
    games = _games(spark, sf_dir).withColumnsRenamed({"home_team": "team_home", "away_team": "team_away", "home_pts": "pts_home", "away_pts": "pts_away"})
    target = F.col("pts_home") + F.col("pts_away") - F.col("total_line")
    return S.entity_panel(games, ["game_id", "game_date"], ["team", "pts"], target, "team", ["game_date", "game_id"], 15)


@query(
    "e29_weighted_error",
    """SELECT model, round(avg(CASE WHEN abs(a) < 1 THEN 1.0 WHEN a * p < 0 THEN 1.0 + 0.4 * least(1.0, abs(a) / 6.0) ELSE 0.9 END * (p - a) * (p - a)), 5) AS loss
        FROM (SELECT model, actual - line AS a, predicted_total - line AS p FROM scored) GROUP BY 1""",
    "scored",
)
def e29(spark, sf_dir):
    loss = E.weighted_squared_error(F.col("actual") - F.col("line"), F.col("predicted_total") - F.col("line"))
    return rounded(_scored(spark, sf_dir).groupBy("model").agg(loss.alias("loss")), 5)


# ---------------------------------------------------------------- Q
def _features(spark, sf_dir):
    """A feature table with a constant, a mostly null, a duplicate, a mirrored and a correlated column."""
    odds = standin(spark, sf_dir, "book_odds")
    return odds.select(
        "game_id",
        F.col("total_line_alpha"),
        F.col("total_line_bravo"),
        F.col("total_line_bravo").alias("bravo_copy"),
        F.col("spread_alpha_line_home").alias("spread_home"),
        F.col("spread_alpha_line_away").alias("spread_mirror"),
        (F.col("total_line_delta") * 2 + 1).alias("delta_scaled"),
        F.col("total_line_delta"),
        F.lit(3.0).alias("constant"),
        F.when(F.col("game_id") % 20 == 0, 1.0).alias("mostly_null"),
        F.col("game_id").cast("string").alias("text"),
        F.col("home_team").alias("home_team_id"),
    )


def _kept(df, columns):
    return df.drop(*columns)


# The planted columns are known, so the SQL states which ones must be gone.
_FEATURES = """f AS (SELECT game_id, total_line_alpha, total_line_bravo, total_line_bravo AS bravo_copy, spread_alpha_line_home AS spread_home,
      spread_alpha_line_away AS spread_mirror, total_line_delta * 2 + 1 AS delta_scaled, total_line_delta, CAST(3 AS DOUBLE) AS constant,
      CASE WHEN game_id % 20 = 0 THEN CAST(1 AS DOUBLE) END AS mostly_null, CAST(game_id AS VARCHAR) AS text, home_team AS home_team_id FROM book_odds)"""


@query("q1_useless_columns", f"WITH {_FEATURES} SELECT * EXCLUDE (constant, mostly_null, text, home_team_id) FROM f", "book_odds")
def q1(spark, sf_dir):
    df = _features(spark, sf_dir)
    return _kept(df, Q.useless_columns(df, protected=["game_id"]))


@query("q2_duplicate_columns", f"WITH {_FEATURES} SELECT * EXCLUDE (bravo_copy) FROM f", "book_odds")
def q2(spark, sf_dir):
    df = _features(spark, sf_dir)
    return _kept(df, Q.duplicate_columns(df, "game_id"))


@query("q3_correlated_columns", f"WITH {_FEATURES} SELECT * EXCLUDE (bravo_copy, spread_mirror, constant, mostly_null, delta_scaled) FROM f", "book_odds")
def q3(spark, sf_dir):
    df = _features(spark, sf_dir).drop("bravo_copy", "spread_mirror", "constant", "mostly_null")
    return _kept(df, Q.correlated_columns(df, "game_id"))


@query("q4_absolute_twins", f"WITH {_FEATURES} SELECT * EXCLUDE (spread_mirror) FROM f", "book_odds")
def q4(spark, sf_dir):
    df = _features(spark, sf_dir)
    return _kept(df, Q.absolute_twins(df, "game_id"))


@query(
    "q5_clean_for_training",
    f"""WITH {_FEATURES} SELECT game_id, total_line_alpha, total_line_bravo, spread_mirror, total_line_delta FROM f
        WHERE total_line_alpha > 100 AND (total_line_bravo IS NULL)::INT + (spread_mirror IS NULL)::INT + (total_line_delta IS NULL)::INT <= 1""",
    "book_odds",
)
def q5(spark, sf_dir):
    return Q.clean_for_training(_features(spark, sf_dir), "game_id", line="total_line_alpha", exclude=["constant"], most_nulls=1)


@query(
    "q6_policy",
    "SELECT game_id, 'total_line_alpha' AS required, '' AS keep_null, 'n_absent' AS zero_fill, 'pts_last_all_5_before' AS infer, 'total_line_alpha' AS flag FROM games",
    "games",
)
def q6(spark, sf_dir):
    columns = ["total_line_alpha", "n_absent", "pts_last_all_5_before", "pts_season_before_avg", "x"]
    p = Q.resolve_policy(columns, Q.MissingRules(), line="total_line_alpha")
    sets = {"required": p.required, "keep_null": p.keep_null, "zero_fill": p.zero_fill, "infer": [a for a, _ in p.infer], "flag": p.flag}
    games = _games(spark, sf_dir).select("game_id")
    return games.select("game_id", *[F.lit(",".join(v)).alias(k) for k, v in sets.items()])


@query(
    "q7_apply_policy",
    """WITH f AS (SELECT event_id, pts, CASE WHEN event_id % 3 > 0 THEN minutes END AS minutes_absent, avg(pts) OVER w AS r5, avg(pts) OVER (PARTITION BY entity ORDER BY ts, event_id) AS s FROM series
          WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
        SELECT event_id, pts, coalesce(minutes_absent, 0) AS minutes_absent, round(coalesce(r5, s), 6) AS pts_last_all_2_before, round(s, 6) AS pts_season_before_avg FROM f WHERE pts IS NOT NULL""",
    "series",
)
def q7(spark, sf_dir):
    from pyspark.sql import Window

    from priorline.skew import bounded_frames, Total, running_totals

    base = standin(spark, sf_dir, "series").select("event_id", "entity", "ts", "pts", F.when(F.col("event_id") % 3 > 0, F.col("minutes")).alias("minutes_absent"))
    order = ["ts", "event_id"]
    df = bounded_frames(base, ["entity"], order, 2, lambda w: [F.avg("pts").over(w.rowsBetween(-2, -1)).alias("pts_last_all_2_before")])
    df = running_totals(df, ["entity"], order, [Total("sum", F.col("pts"), "s"), Total("count", F.col("pts"), "n")], include_current=True)
    df = df.withColumn("pts_season_before_avg", F.when(F.col("n") > 0, F.col("s") / F.col("n"))).drop("s", "n", "entity", "ts")
    policy = Q.resolve_policy(df.columns, Q.MissingRules(), target="pts")
    return rounded(Q.apply_policy(df, policy))


@query(
    "q8_frame_difference",
    """SELECT game_id, 'total_line' AS column_name, CAST(NULL AS VARCHAR) AS only_in FROM games WHERE game_id % 10 = 0 AND total_line IS NOT NULL
        UNION ALL SELECT game_id, 'home_pts', 'left' FROM games WHERE game_id % 100 = 7 UNION ALL SELECT game_id, 'total_line', 'left' FROM games WHERE game_id % 100 = 7 AND total_line IS NOT NULL""",
    "games",
)
def q8(spark, sf_dir):
    left = _games(spark, sf_dir).select("game_id", "total_line", "home_pts")
    right = left.filter("game_id % 100 <> 7").withColumn("total_line", F.when(F.col("game_id") % 10 == 0, F.col("total_line") + 0.5).otherwise(F.col("total_line") + 0.00001))
    return Q.frame_difference(left, right, ["game_id"]).select("game_id", "column_name", "only_in")
