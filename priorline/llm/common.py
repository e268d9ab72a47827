"""What several operators here share: staged tables, text keys and safe column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.session import forget as forget
from priorline.session import stage as stage

SPACE = r"[\x20\x09-\x0D]"


def text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that identify a text (null is a text of its own)."""
    return [F.xxhash64(text.isNull(), text).alias("__k1"), F.xxhash64(F.lit("second"), text.isNull(), text).alias("__k2")]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns, whatever their case, so that an operator's results can take their names."""
    gone = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in gone])


BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in smaller Arrow batches than the default of 10,000 rows, unless the session chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether at most ``rows`` rows exist; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows
