"""The versioned table: merges, replays, failed writes, two writers, and only touched buckets rewritten."""

import pytest
from pyspark.sql import functions as F

from priorline.sources.versions import ConcurrentWrite, VersionedTable

ROWS = "k int, g string, v double, w string"


@pytest.fixture
def held(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "g"], buckets=8)
    table.upsert(spark.createDataFrame([(i, "a", float(i), "old") for i in range(40)] + [(None, "a", -1.0, "old"), (3, "a", 99.0, "worse")], ROWS), [F.asc("v")], "b1")
    return table


def rows(table):
    return {(r.k, r.g): (r.v, r.w) for r in table.read().collect()}


def test_merges_write_back(spark, held):
    assert len(rows(held)) == 41 and rows(held)[3, "a"] == (3.0, "old") and held.read().count() == 41
    held.upsert(spark.createDataFrame([(1, "a", 10.0, "new"), (500, "b", 1.0, "new")], ROWS), [F.asc("v")])
    held.update(spark.createDataFrame([(2, "a", None, "upd"), (None, "a", 7.0, None), (900, "a", 1.0, "upd")], ROWS), ["v", "w"], [F.asc("w")])
    assert held.delete_preview(spark.createDataFrame([(4, "a"), (4, "zz")], "k int, g string")) == 1
    held.delete(spark.createDataFrame([(4, "a"), (4, "zz")], "k int, g string"))
    got = rows(held)
    assert got[1, "a"] == (10.0, "new") and got[500, "b"] == (1.0, "new") and got[2, "a"] == (2.0, "upd") and got[None, "a"] == (7.0, "old")
    assert (4, "a") not in got and (900, "a") not in got and len(got) == 41 and held.manifest()["version"] == 4


def test_replay_and_untouched_buckets(spark, held):
    before = held.manifest()["folders"]
    change = spark.createDataFrame([(7, "a", 70.0, "new")], ROWS)
    assert held.upsert(change, [F.asc("v")], "b2") == 2 and held.upsert(change.withColumn("v", F.lit(0.0)), [F.asc("v")], "b2") == 2
    after = held.manifest()["folders"]
    assert rows(held)[7, "a"] == (70.0, "new") and sum(before[b] != after[b] for b in before) == 1


def test_failed_and_second_writers_change_nothing(spark, held):
    broken = spark.createDataFrame([(1, "a", 5.0, "new")], ROWS).withColumn("v", F.expr("v + raise_error('lost')"))
    with pytest.raises(Exception, match="lost"):
        held.upsert(broken, [F.lit(1).asc()])
    seen, first = rows(held), held.manifest()
    held.upsert(spark.createDataFrame([(1, "a", 5.0, "first")], ROWS), [F.asc("v")])
    late = VersionedTable(spark, held.path, held.keys)
    late.manifest = lambda: first  # started from the version before
    with pytest.raises(ConcurrentWrite):
        late.upsert(spark.createDataFrame([(1, "a", 6.0, "second")], ROWS), [F.asc("v")])
    assert rows(held) == seen | {(1, "a"): (5.0, "first")}


def test_deleting_everything_and_empty_changes(spark, held):
    held.upsert(held.read().limit(0), [F.asc("v")])
    assert len(rows(held)) == 41
    held.delete(held.read())
    assert rows(held) == {} and held.manifest()["folders"] == {}
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, held.path + "-none", ["k"]).read()


def test_rows_are_worked_out_once_by_a_first_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return value

    v = F.udf(counted, "double")(F.col("v"))
    source = spark.createDataFrame([(i, "a", float(i), "old") for i in range(40)], ROWS).withColumn("v", v)
    table = VersionedTable(spark, str(tmp_path / "once"), ["k", "g"], buckets=8)
    table.upsert(source, [F.asc("v")])
    assert seen.value == 40 and table.read().count() == 40
