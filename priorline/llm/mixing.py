"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import without

BUCKET_DIGITS = 3  # a source's documents are numbered in 16 ** 3 slices, so a hot source is never one group


def shares(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Whole slots of a period per source, at least one, by largest remainder (ties: by name)."""
    total = sum(weights.values())
    if len(weights) > period or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive and no more than the period has slots")
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    by_rest = sorted(weights, key=lambda s: (-(exact[s] - int(exact[s])), s is None, s or ""))
    for s in by_rest[: period - sum(out.values())]:
        out[s] += 1
    return out


def pfair_period(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period.

    With share k of D slots, block j may start at floor(j D / k) and must end by ceil((j + 1) D / k).
    Each slot takes the released block with the earliest deadline (ties: by name).  All slots are in use,
    so every deadline is met, each source stays within one block of its share at any time, and the
    schedule repeats after D slots.
    """
    period = sum(slots.values())
    waiting = [(0, i, s, 0) for i, s in enumerate(sorted(slots, key=lambda s: (s is None, s or "")))]
    ready: list[tuple[int, int, str | None, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, i, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[source]), i, source, j, release))
        deadline, i, source, j, release = heapq.heappop(ready)
        out.append((source, j, slot, release, deadline))
        if j + 1 < slots[source]:
            heapq.heappush(waiting, ((j + 1) * period // slots[source], i, source, j + 1))
    return out


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _numbered(docs: DataFrame, id_col: str, source_col: str, salt: str) -> DataFrame:
    """__id, __source and __rank: place of each row in a keyed order of its source.

    Rows are numbered inside slices of the hash and the sizes of the earlier slices are added, so no task
    gets a whole source.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), digest.alias("__u"))
    rows = rows.withColumn("__slice", F.substring("__u", 1, BUCKET_DIGITS))
    sizes = rows.groupBy("__source", "__slice").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__source").alias("__s2"), F.col("__slice").alias("__b2"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__source", "__slice").orderBy("__u", F.col("__id").asc_nulls_first())) - 1
    return (
        rows.withColumn("__in", inside)
        .join(offsets, _same("__source", "__s2") & (F.col("__slice") == F.col("__b2")))
        .select("__id", "__source", (F.col("__before") + F.col("__in")).alias("__rank"))
    )


def schedule(
    docs: DataFrame, weights: Mapping[str | None, float], id_col: str = "doc_id", source_col: str = "source", block_rows: int = 8, period: int = 1000, salt: str = "mix"
) -> DataFrame:
    """Give every row of ``docs`` its block's slot in the interleaved order.

    Columns: id, source, block, place (row within the block), slot, release, deadline (both in slots)
    and in_mix.  Each source's rows are put in a keyed order and cut into blocks of ``block_rows``.
    Weights are rounded to whole slots of ``period``, which also bounds the number of sources.  All rows
    are scheduled; ``in_mix`` is true before the first slot whose source has run out, the stretch in which
    every source holds its weight to within one block.  Sources missing from ``weights`` are an error,
    found when the result is computed: their slot would be null, so they are checked first.  Null is a
    source of its own; repeated rows are rows of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [id_col, source_col, "block", "place", "slot", "release", "deadline", "in_mix"]
    if not weights:
        if docs.limit(1).count():
            raise ValueError("no weights")
        weights = {"none": 1.0}
    slots = shares(weights, period)
    plan = spark.createDataFrame(
        [(s, j, t, slots[s]) for s, j, t, _, _ in pfair_period(slots)], "__s string, __j int, __t int, __k int"
    )  # exactly ``period`` rows
    known = spark.createDataFrame([(s,) for s in slots], "__s string")
    ranked = _numbered(docs, id_col, source_col, salt)
    totals = docs.groupBy(F.col(source_col).cast("string").alias("__source")).agg(F.count("*").alias("__n"))
    if totals.join(known, _same("__source", "__s"), "left_anti").limit(1).count():
        raise ValueError("a source has no weight")
    blocks = ranked.withColumn("__block", F.floor(F.col("__rank") / block_rows))

    def placed(rows: DataFrame) -> DataFrame:
        k = F.broadcast(plan.select(F.col("__s").alias("__ks"), F.col("__k").alias("__share")).distinct())
        rows = rows.join(k, _same("__source", "__ks")).withColumn("__j2", F.col("__block") % F.col("__share"))
        rows = rows.join(F.broadcast(plan), _same("__source", "__s") & (F.col("__j2") == F.col("__j")))
        return rows.withColumn("__slot", F.floor(F.col("__block") / F.col("__share")) * period + F.col("__t"))

    # the first block that a source no longer has
    ends = placed(totals.select("__source", F.ceil(F.col("__n") / block_rows).alias("__block"))).agg(F.min("__slot").alias("__end"))
    out = placed(blocks).crossJoin(F.broadcast(ends))  # one row
    exact = F.col("__block") * period
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__source").alias(source_col),
        F.col("__block").alias("block"),
        (F.col("__rank") % block_rows).alias("place"),
        F.col("__slot").alias("slot"),
        F.floor(exact / F.col("__share")).alias("release"),
        F.ceil((exact + period) / F.col("__share")).alias("deadline"),
        (F.col("__slot") < F.col("__end")).alias("in_mix"),
    ).select(*names)


def tempered(docs: DataFrame, source_col: str = "source", power: float = 0.5, most: int = 1000) -> dict[str | None, float]:
    """Weights proportional to a power of each source's rows; more than ``most`` sources are an error."""
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return {r["s"]: r["count"] ** power for r in rows}


def interleaved(docs: DataFrame, weights: Mapping[str | None, float], id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All rows in scheduled order, columns unchanged.

    While every source lasts each holds its weight; the slots of one that has ended go to the rest, which
    follow each other in the order of their own slots.  The order is a range sort by slot.  Rows with a
    null id or an id that repeats in a source stand together at the place of the first of them.
    """
    return _in_order(docs, schedule(docs, weights, id_col, source_col, **options), id_col, source_col)


def mix(docs: DataFrame, weights: Mapping[str | None, float], id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of the stretch that holds the weights, in scheduled order, columns unchanged.

    The stretch ends with the first source that runs out, so a tiny source leaves little of the others:
    ``interleaved`` keeps every row.  Rows with a null id or an id that repeats are kept or left together
    with the first of them.
    """
    return _in_order(docs, schedule(docs, weights, id_col, source_col, **options), id_col, source_col, F.col("__at.in_mix"))


SCHEDULE = ["block", "place", "slot", "release", "deadline", "in_mix"]


def with_schedule(docs: DataFrame, weights: Mapping[str | None, float], id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All rows in scheduled order with the SCHEDULE columns of their own.

    Rows with a null id or an id that repeats in a source have a place each, dealt out among them in the order of their hashes; only
    they are shuffled once more.
    """
    plan = schedule(docs, weights, id_col, source_col, **options).withColumnsRenamed({id_col: "__id", source_col: "__src"})
    plan = plan.select("__id", "__src", F.struct("slot", "place", *[c for c in SCHEDULE if c not in ("slot", "place")]).alias("__at"))
    own = plan.groupBy("__id", "__src").agg(F.min("__at").alias("__at"), F.count("*").alias("__n"))
    source = F.col(source_col).cast("string")
    rows = docs.join(own, F.col(id_col).eqNullSafe(F.col("__id")) & source.eqNullSafe(F.col("__src")))
    group = Window.partitionBy("__id", "__src")
    again = rows.filter("__n > 1").drop("__at", "__n").withColumn("__nth", F.row_number().over(group.orderBy(F.xxhash64(*docs.columns))))
    shared = plan.withColumns({"__m": F.row_number().over(group.orderBy("__at")), "__n": F.count("*").over(group)}).filter("__n > 1")
    shared = shared.select(F.col("__id").alias("__i"), F.col("__src").alias("__s"), "__m", "__at")
    again = again.join(shared, _same("__id", "__i") & _same("__src", "__s") & (F.col("__nth") == F.col("__m")))
    placed = rows.filter("__n = 1").select(*docs.columns, "__at").unionByName(again.select(*docs.columns, "__at"))
    ordered = placed.repartitionByRange("__at.slot").sortWithinPartitions("__at.slot", "__at.place")
    return ordered.select(*docs.columns, *[F.col(f"__at.{c}").alias(c) for c in SCHEDULE])


def _in_order(docs: DataFrame, plan: DataFrame, id_col: str, source_col: str, wanted: Column | None = None) -> DataFrame:
    first = plan.groupBy(F.col(id_col).alias("__id"), F.col(source_col).alias("__src")).agg(F.min(F.struct("slot", "place", "in_mix")).alias("__at"))
    if wanted is not None:
        first = first.filter(wanted)
    rows = docs.join(first, F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__src")))
    return rows.repartitionByRange("__at.slot").sortWithinPartitions("__at.slot", "__at.place").select(*[F.col(c) for c in docs.columns])
