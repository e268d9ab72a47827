"""The streaming ingest leaves what the batch sink leaves, over several micro-batches and a restart."""

import datetime as dt

from pyspark.sql import functions as F

from priorline.sources import sinks
from priorline.streaming import ingest

SCHEMA = "k int, at timestamp, v string"


def rows(*items):
    return [(k, dt.datetime(2024, 1, 1, 0, m), v) for k, m, v in items]


def test_stream_equals_batch(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    first = spark.createDataFrame(rows((1, 0, "a"), (1, 0, "a"), (2, 1, "b")), SCHEMA)
    second = spark.createDataFrame(rows((2, 5, "z"), (3, 6, "c")), SCHEMA)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.insert_stream(stream, table, ["k"], [F.col("v").asc()], state).awaitTermination()
    batch = str(tmp_path / "batch")
    for part in (first, second):
        sinks.insert_if_absent(part, batch, ["k"], [F.col("v").asc()])
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == sorted(map(tuple, spark.read.parquet(batch).collect()))


def test_dedupe_within_the_delay(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    spark.createDataFrame(rows((1, 0, "a"), (1, 1, "a"), (2, 1, "b"), (2, 2, "b")), SCHEMA).coalesce(1).write.parquet(source)
    stream = ingest.dedupe_stream(spark.readStream.schema(SCHEMA).parquet(source), ["k", "v"], "at", "10 minutes")
    ingest.upsert_stream(stream, table, state).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(table).collect()) == [(1, "a"), (2, "b")]


def test_latest_view_of_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, 1)
    sinks.append_log(spark.createDataFrame([(2, "c")], "k int, v string"), path, 2)
    log = spark.read.parquet(path)
    assert sorted(map(tuple, sinks.latest_view(log, ["k"]).collect())) == [(1, "a"), (2, "c")]
    sinks.compact(log, ["k"], str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
