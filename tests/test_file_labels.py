"""Names of files and folders of parts are cut out of the path, and market files are read as text once."""

import pathlib
import re

from pyspark.sql import functions as F

from priorline.sources import files


def _label(path):
    return re.search(r"([^/=]+?)(?:\.csv)?(?:/part-[^/]*)?$", path).group(1)


def test_labels_equal_the_rule_and_need_no_pattern(spark, tmp_path):
    names = ["a_1997_98.csv", "x=b_1998_99.csv", "plain", "c.csv/part-00000-u.csv", "d.csv.csv", "file=e_2001_02.csv/part-1", "day=2024-01-01/part-0.c000.csv", "partly/z.csv"]
    for name in names:
        target = pathlib.Path(tmp_path / name)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("v\n")
    rows = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path)).select(F.col("_metadata.file_path").alias("path"), files._file_label().alias("label"))
    found = {r.path: r.label for r in rows.collect()}
    assert len(found) == len(names) and found == {p: _label(p) for p in found}
    assert "regexp" not in str(files._file_label())


def test_market_files_are_parsed_once(spark, tmp_path):
    for folder, column in (("one", "x"), ("two", "y")):
        for day in ("2024-01-01", "2024-01-02") if folder == "one" else ("2024-01-02",):
            (tmp_path / folder).mkdir(exist_ok=True)
            (tmp_path / folder / f"{day}.csv").write_text(f"game_id,{column}\n1,2.5\n2,\n")
    out = files.read_daily_markets(spark, str(tmp_path), {"one": "game_id bigint, x double", "two": "game_id bigint, y double"}, ["game_id"])
    assert sorted(map(tuple, out.select("game_id", "x", "y").collect())) == [(1, 2.5, 2.5), (2, None, None)]
    assert "FileScan csv" not in spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
