"""Game-level predictions of models nobody listed."""

from datetime import date

from priorline.operators import evaluate as E

SCHEMA = "game int, model string, stamp date, total double, error double, line double, pick string, kind string, tag string, actual double, run int"
NAMES = {"game": "game", "model": "model", "stamp": "stamp", "total": "total", "error": "error", "line": "line", "pick": "pick", "kind": "kind"}


def log(spark):
    d = [date(2024, 1, n) for n in range(1, 6)]
    return spark.createDataFrame(
        [
            (1, "old", d[0], 210.0, None, 200.0, None, "TOTAL_POINTS", "1", 205.0, 1),
            (1, "old", d[1], None, -5.0, 201.0, "over", "LINE_ERROR", "1", 205.0, 2),
            (1, "unheard of", d[1], None, 9.0, 203.0, None, "LINE_ERROR", "1", 206.0, 3),
            (1, "unheard of", d[1], 208.0, None, 203.0, None, "TOTAL_POINTS", " 1 ", 206.0, 1),
            (1, None, d[2], 1.0, None, 1.0, None, "TOTAL_POINTS", "1", 1.0, 9),
            (1, "late", d[4], 1.0, None, 1.0, None, "TOTAL_POINTS", "1", 1.0, 9),
            (2, "old", None, 190.0, None, None, None, None, "1", None, 1),
            (3, "other tag", d[0], 190.0, None, 190.0, None, None, "2", 190.0, 1),
        ],
        SCHEMA,
    )


def test_every_model_found_is_kept_with_the_base_of_the_latest_row(spark):
    out = E.game_level_open(log(spark), **NAMES, base=["actual"], ties=["run"], tag="tag", tag_value="1", cutoff=date(2024, 1, 4))
    rows = {r.game: r for r in out.collect()}
    assert set(rows) == {1}  # game 2 has no stamp to hold against the cutoff, game 3 another tag
    r = rows[1]
    assert sorted(r.models) == ["old", "unheard of"]
    assert r.models["old"].asDict() == {"total": 196.0, "error": -5.0, "pick": "OVER", "stamp": date(2024, 1, 2)}
    assert r.models["unheard of"].total == 208.0 and r.models["unheard of"].error == 5.0
    assert r.latest_stamp == date(2024, 1, 2) and r.actual == 206.0  # the total-points row of the latest day


def test_nulls_without_a_cutoff_and_an_empty_log(spark):
    out = E.game_level_open(log(spark), **NAMES, base=["actual"], ties=["run"])
    rows = {r.game: r for r in out.collect()}
    assert set(rows) == {1, 2, 3} and set(rows[1].models) == {"old", "unheard of", "late"}
    assert rows[2].latest_stamp is None and rows[2].models["old"].total == 190.0 and rows[2].models["old"].error is None
    assert E.game_level_open(log(spark).limit(0), **NAMES, base=["actual"], ties=["run"]).count() == 0


def test_scores_follow_the_base_line(spark):
    log_ = log(spark).selectExpr("*", "line AS base_line")
    out = E.game_level_open(log_, **NAMES, base=["actual", "base_line"], ties=["run"], cutoff=date(2024, 1, 4))
    long = {(r.game, r.model): r for r in E.model_rows(E.score_open(out, "base_line", "actual")).collect()}
    assert set(long) == {(1, "old"), (1, "unheard of"), (3, "other tag")}
    old, new, push = long[1, "old"], long[1, "unheard of"], long[3, "other tag"]
    assert (old.line_diff, old.miss, old.pick, old.correct) == (-7.0, -10.0, "OVER", True)  # its own pick stays
    assert (new.line_diff, new.miss, new.pick, new.correct) == (5.0, 2.0, "OVER", True)
    assert (push.pick, push.correct) == ("PUSH", False)
