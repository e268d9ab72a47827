"""Periodic runs of words, found in overlapping tiles per octave of periods and stitched by document and period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from priorline.llm.common import SPACE, stage

SHORTEST = 24  # words of a run
TIMES = 3  # periods of a run
BLOCK = 8  # words of the first octave's blocks; periods below it are the first octave
TILE_CODES = 1 << 20  # word codes written at a time

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def octave(k: int) -> tuple[int, int, int]:
    """(block, first period, last period + 1) of octave k: 1 to 7, then 8 to 15, 16 to 31 and so on.

    Tiles of an octave stand around centres every 2 blocks and reach from 2 blocks before to 4 blocks behind theirs.  Every
    run of the octave (24 words and 3 periods at least) holds a centre whose next period is inside too, and in
    each such tile its words repeat after the period for 2 blocks or more.
    """
    block = BLOCK << max(k - 1, 0)
    return (block, 1, BLOCK) if k == 0 else (block, block, 2 * block)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): a hash of every word of the texts data[offsets[i]:offsets[i + 1]]; text i has those from bounds[i] to bounds[i + 1]."""
    space = _IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # texts end words
    start = ~space
    start[1:] &= space[:-1] | cut[1:-1]
    end = ~space
    end[:-1] &= space[1:] | cut[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int((last - first).max(initial=0)) + 1, _BASE)]))
    length = last - first + 1
    begun = np.zeros(len(data), np.int64)
    begun[first] = first
    inside = np.arange(len(data)) - np.maximum.accumulate(begun)
    terms = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(inside, len(powers) - 1)])
    hashes = np.add.reduceat(terms, first) if len(first) else np.zeros(0, np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX + length.astype(np.uint64)
    return hashes, np.searchsorted(first, offsets)


def repeating_blocks(codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, text, start in text) of the aligned blocks whose words seem to come again one period of the octave later.

    Hashes are compared, so equal blocks are always found and, rarely, others.  Octaves end where no text holds three periods.
    """
    sizes = np.diff(bounds)
    most = int(sizes.max(initial=0))
    mixed = (codes ^ (codes >> np.uint64(31))) * _MIX
    width, k = 1, 0
    while True:
        block, low, high = octave(k)
        if most < max(SHORTEST, TIMES * low):
            return
        while width < block:  # hash of twice as many words from two neighbours
            mixed = mixed[:-width] * _BASE + mixed[width:] if len(mixed) > width else mixed[:0]
            mixed ^= mixed >> np.uint64(31)
            mixed *= _MIX
            width *= 2
        texts = np.flatnonzero(sizes >= max(SHORTEST, TIMES * low))
        blocks = sizes[texts] // block
        text = np.repeat(texts, blocks)
        inside = (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
        at, room = bounds[text] + inside, sizes[text] - inside - block
        found = np.zeros(len(text), bool)
        for period in range(low, high):
            fits = np.flatnonzero(room >= period)
            found[fits] |= mixed[at[fits]] == mixed[at[fits] + period]
        yield k, text[found], inside[found]
        k += 1


def matches(codes: list[int], centre: int, reach: int) -> tuple[list[int], list[int]]:
    """For every distance q below ``reach``: how many words before and from the centre on equal those q words later.

    Two Z-functions at the boundary: of what follows it, and of what precedes it against the same read backwards.
    """
    before = codes[:centre][::-1]
    far = codes[: centre + reach][::-1]
    z = _z([*before, -1, *far], len(before) + 1 + len(far))
    # the place of centre + q in the text read backwards
    behind = [z[len(before) + 1 + len(far) - centre - q] if centre else 0 for q in range(min(reach, len(far) - centre + 1))]
    return behind, _z(codes[centre:], reach)


def _z(s: list[int], wanted: int) -> list[int]:
    """Z-function of the first ``wanted`` places, 0 beyond the end."""
    n = len(s)
    z = [0] * max(wanted, 1)
    z[0] = n
    left = right = 0
    for i in range(1, min(wanted, n)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(codes: list[int], k: int, at: int, start: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches around a tile's centre that repeat for 2 blocks or more, as far as the tile shows them."""
    block, low, high = octave(k)
    centre = at - start
    behind, ahead = matches(codes, centre, min(high, len(codes) - centre + 1))
    for period in range(low, min(high, len(codes) - centre + 1)):
        if behind[period] + ahead[period] >= 2 * block:
            yield period, at - behind[period], at + period + ahead[period]


def _texts(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and where each begins; a null is empty."""
    part = part.fill_null("").cast(pa.large_string())
    _, offsets, data = part.buffers()
    offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@F.arrow_udf(ArrayType(IntegerType()))
def _octaves(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Octaves in which a text may hold a run; mostly none."""
    for part in parts:
        found: list[list[int]] = [[] for _ in range(len(part))]
        codes, bounds = word_hashes(*_texts(part))
        for k, text, _ in repeating_blocks(codes, bounds):
            for i in np.unique(text):
                found[i].append(k)
        yield pa.array(found, pa.list_(pa.int32()))


_TILE = pa.schema([("row", pa.int64()), ("octave", pa.int32()), ("at", pa.int64()), ("start", pa.int64()), ("codes", pa.list_(pa.int32()))])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles around the centres whose tile holds a repeating block; equal words of a text have equal codes."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _TILE, strict=True)], schema=_TILE)

    for part in batches:
        for row, text in zip(part.column("row").to_pylist(), part.column("text"), strict=True):
            words = np.array([*(text.as_py() or "").encode().split(), None], object)[:-1]
            codes = pd.factorize(words)[0].astype(np.int32)
            for k, _, inside in repeating_blocks(codes.astype(np.uint64), np.array([0, len(codes)])):
                block = octave(k)[0]
                near = [np.arange(-(-(i - 3 * block) // (2 * block)), (i + 2 * block) // (2 * block) + 1) for i in inside]
                centres = np.unique(np.concatenate(near)) * 2 * block if near else []
                for at in centres:
                    if 0 <= at < len(codes):
                        start = max(0, int(at) - 2 * block)
                        held.append((row, k, int(at), start, codes[start : at + 4 * block]))
                        size += len(held[-1][-1])
                        if size >= TILE_CODES:
                            yield batch()
                            held, size = [], 0
    if held:
        yield batch()


_FRAGMENT = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        out = []
        tiles = zip(*[part.column(c).to_pylist() for c in ("row", "octave", "at", "start")], part.column("codes"), strict=True)
        for row, k, at, start, codes in tiles:  # one tile's codes at a time as a list
            out += [(row, *f) for f in solve_tile(codes.as_py(), k, at, start)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _FRAGMENT, strict=True)], schema=_FRAGMENT)


def stitch(fragments: DataFrame) -> DataFrame:
    """(row, runs): fragments of one document and period that share a period's length of words are one stretch.

    Different stretches of a period share fewer.  Stretches below SHORTEST words or TIMES periods go; of those with the
    same ends the least period counts, the others are its multiples.
    """
    ordered = Window.partitionBy("row", "period").orderBy("start", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("opens", F.coalesce(F.col("start") + F.col("period") > reached, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(SHORTEST), TIMES * F.col("period")))
    least = whole.groupBy("row", "start", "end").agg(F.min("period").alias("period"))
    run = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    return least.groupBy("row").agg(F.array_sort(F.collect_list(run)).alias("runs"))


@F.arrow_udf(StringType())
def _collapse(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, runs in parts:
        out = []
        for text, found in zip(texts, runs, strict=True):
            words = (text.as_py() or "").encode().split()
            change = np.zeros(len(words) + 1, np.int64)
            for r in found.as_py() or []:
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            kept = np.cumsum(change[:-1]) == 0
            out.append(b" ".join(w for w, k in zip(words, kept, strict=True) if k).decode())
        yield pa.array(out, pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Periodic stretches of words of every whole text: id, n_words, runs and collapsed.

    Words are what white space (blank, tab to carriage return) parts.  A run is a stretch of at least 24 words and
    three times its smallest period q, in which words q apart are equal and that no neighbouring word extends; ``runs`` holds start, length and
    period by start, then period.  ``collapsed`` has the words joined by one blank, less those that any run
    holds after its first q words.  Null and empty texts have no words, no runs and an empty ``collapsed``; rows that share an
    id and null ids are rows of their own; an empty table gives none.

    Texts without a block that repeats within its octave's periods are answered at once.  The others are written
    once, cut into tiles per octave, and the tiles dealt out one by one, so a long text is solved by many tasks;
    only stretches (document, period, start, end) come back, are shuffled by document and period and stitched.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("octaves", _octaves("text"))
    words = F.regexp_extract_all("text", F.lit(f"[^{SPACE[1:-1]}]+"), F.lit(0))
    nothing = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    plain = rows.filter("size(octaves) = 0").withColumn("words", F.coalesce(words, F.array().cast("array<string>")))
    plain = plain.select("id", F.size("words").cast("long").alias("n_words"), nothing.alias("runs"), F.array_join("words", " ").alias("collapsed"))

    some = stage(rows.filter("size(octaves) > 0").select(F.monotonically_increasing_id().alias("row"), "id", "text"), "periodic")
    tiles = some.select("row", "text").mapInArrow(_tiles, "row long, octave int, at long, start long, codes array<int>")
    fragments = tiles.repartition("row", "octave", "at").mapInArrow(_solve, "row long, period long, start long, end long")
    found = some.join(stitch(fragments), "row", "left").withColumn("runs", F.coalesce("runs", nothing))
    found = found.select("id", F.size(words).cast("long").alias("n_words"), "runs", _collapse("text", "runs").alias("collapsed"))
    return plain.union(found).withColumnRenamed("id", id_col)
