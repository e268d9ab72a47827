"""Report rows from extracted text blocks (one row per block, tokens split by line breaks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.functions.text import REPORT_STATUSES, token_kind
from priorline.skew import CHECK, Total, attach, bounded_frames, find_hot_keys, narrower, running_totals

FIELDS = ("game_date", "game_time", "matchup", "team", "player", "status", "reason")


def _tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), "\n"), lambda t: F.trim(t)), lambda t: t != "")


def _glue(tokens: Column, from_end: int) -> Column:
    """Join the last ``from_end`` tokens when the first of them holds ';' or '-'."""
    at = F.try_element_at(tokens, F.lit(-from_end))
    tail = F.slice(tokens, -from_end, from_end)
    front = F.greatest(F.size(tokens) - from_end, F.lit(0))
    glued = F.concat(F.slice(tokens, F.lit(1), front), F.array(F.array_join(tail, " ")))
    return F.when((F.size(tokens) >= from_end + 1) & (at.contains(";") | at.contains("-")), glued).otherwise(tokens)


def _assign(tokens: Column) -> Column:
    """Walk the tokens once and fill the report columns.

    Once the first token is placed, the last one stands as the reason until a later token replaces
    it, and a token that already stands in a column is passed over.
    """
    def kinds(token: Column) -> Column:
        """Worked out once per token, for either state of the walk; inside the walk every use would match the patterns again."""
        return F.struct(token.alias("token"), token_kind(token, F.lit(False)).alias("first"), token_kind(token, F.lit(True)).alias("later"))

    empty = F.struct(*[F.lit(None).cast("string").alias(f) for f in FIELDS], F.lit("").alias("last"))

    def step(state: Column, known: Column) -> Column:
        token = known["token"]
        kind = F.when(state["last"] == "player", known["later"]).otherwise(known["first"])
        seen = F.array_contains(F.array_compact(F.array(*[state[f] for f in FIELDS])), token)
        use = kind.isNotNull() & ~seen
        placed = {f: F.when(use & (kind == f), token).otherwise(state[f]) for f in FIELDS}
        placed["reason"] = F.coalesce(placed["reason"], F.try_element_at(tokens, F.lit(-1)))
        return F.struct(*[c.alias(f) for f, c in placed.items()], F.when(use, kind).otherwise(state["last"]).alias("last"))

    return F.aggregate(F.transform(tokens, kinds), empty, step)


def report_rows(blocks: DataFrame, doc: str, line: str, text: str) -> DataFrame:
    """Parse blocks in document order and carry date, time, matchup and team forward.

    A two-token block with a status word is put in front of the next block.
    """
    status = F.lit(False)
    for word in REPORT_STATUSES:
        status = status | F.col(text).contains(word)
    rows = blocks.withColumn("__t", _tokens(F.col(text))).filter(F.size("__t") > 0)
    rows = rows.withColumn("__short", (F.size("__t") == 2) & status)
    hot = find_hot_keys(blocks, [doc])  # looked for once: rows only get fewer from here
    # Inside a run of such blocks every second one is already joined to the one before.
    rows = running_totals(rows, [doc], [line], [Total("count", F.when(~F.col("__short"), 1), "__run"), Total("count", F.lit(1), "__n")], hot=hot)
    first = F.min(F.when(F.col("__short"), F.col("__n")))
    if hot is None:
        rows = rows.withColumn("__first", first.over(Window.partitionBy(doc, "__run")))
    else:
        rows = attach(rows, rows.groupBy(doc, "__run").agg(first.alias("__first")), [doc, "__run"])
    rows = rows.withColumn("__held", F.col("__short") & ((F.col("__n") - F.col("__first")) % 2 == 0))
    rows = bounded_frames(rows, [doc], [line], 1, lambda w: [F.lag("__t").over(w).alias("__pt"), F.lag("__held").over(w).alias("__ph")], hot=narrower(hot))
    joined = F.when(F.coalesce("__ph", F.lit(False)), F.concat("__pt", "__t")).otherwise(F.col("__t"))
    rows = rows.filter(~F.col("__held")).withColumn("__t", joined)
    header = (F.get("__t", F.lit(0)) == "Game Date") & (F.get("__t", F.lit(1)) == "Game Time")
    rows = rows.filter((F.size("__t") >= 2) & ~F.coalesce(header, F.lit(False)))
    rows = rows.withColumn("__t", _glue(F.col("__t"), 2)).withColumn("__t", _glue(F.col("__t"), 3))
    direct = F.struct(*[F.get("__t", F.lit(i)).alias(f) for i, f in enumerate(FIELDS)], F.lit("").alias("last"))
    rows = rows.withColumn("__r", F.when(F.size("__t") == 7, direct).otherwise(_assign(F.col("__t"))))
    rows = rows.select(doc, line, *[F.col(f"__r.{f}").alias(f) for f in FIELDS])
    carried = ["game_date", "game_time", "matchup", "team"]
    filled = fill_forward(rows, [doc], [line], carried, narrower(hot))
    return filled.select(doc, line, *FIELDS)


def fill_forward(df: DataFrame, group: list[str], order: list[str], columns: list[str], hot=CHECK) -> DataFrame:
    """Last non-null value up to and including the row."""
    out = running_totals(df, group, order, [Total("last", F.col(c), f"__f_{c}") for c in columns], include_current=True, hot=hot)
    return out.withColumns({c: F.col(f"__f_{c}") for c in columns}).drop(*[f"__f_{c}" for c in columns])
