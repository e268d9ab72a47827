"""CSV sources: headers found on the executors, plain files and folders of parts, layouts that differ."""

import pytest

from priorline.sources import files


def test_layouts_and_names(spark, tmp_path):
    (tmp_path / "team_games_2019_20.csv").write_text("GAME_ID,PTS,\"A,B\",lower\n1,100,x,y\n2,,z,y\n")
    (tmp_path / "team_games_2020_21.csv").write_text("PTS,GAME_ID,Unnamed: 0\n90,3,0\n")
    (tmp_path / "team_games_2021_22.csv").mkdir()
    (tmp_path / "team_games_2021_22.csv" / "part-00000.csv").write_text("PTS,GAME_ID,Unnamed: 0\n80,4,0\n")
    (tmp_path / "file=team_games_2022_23.csv").mkdir()
    (tmp_path / "file=team_games_2022_23.csv" / "part-00000.csv").write_text("PTS,GAME_ID,Unnamed: 0\n")
    (tmp_path / "other_2022_23.csv").write_text("PTS,GAME_ID\n70,5\n")
    got = files.read_season_csvs(spark, str(tmp_path), "team_games", {"PTS": "POINTS"}, drop_lower_case=True)
    rows = sorted((r["GAME_ID"], r["POINTS"], r["A,B"], r["SEASON_YEAR"]) for r in got.collect() if r["POINTS"])
    assert rows == [("1", "100", "x", 2019), ("3", "90", None, 2020), ("4", "80", None, 2021)]
    assert set(got.columns) == {"GAME_ID", "POINTS", "A,B", "SEASON_YEAR"} and got.count() == 4
    assert files.file_headers(spark, f"{tmp_path}/*team_games_*.csv").count() == 4
    with pytest.raises(Exception, match="no file|PATH_NOT_FOUND"):
        files.read_season_csvs(spark, str(tmp_path), "nothing")


def test_a_file_of_several_blocks_has_one_header(spark, tmp_path):
    (tmp_path / "facts_1.csv").write_text("GAME_ID,DAY\n" + "".join(f" {i} ,2020-08-{1 + i % 28:02d}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [r.header for r in files.file_headers(spark, f"{tmp_path}/facts_*.csv").collect()] == ["GAME_ID,DAY"]
        got = files.read_fact_folder(spark, str(tmp_path), "facts", ["game_id"], ["game_id"], "day")
        assert got.count() == 20000 and got.select("season_year").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
