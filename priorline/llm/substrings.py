"""Repeated passages found with one FM-index per shard."""

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import stage, text_keys

GRAM = 12  # words of the runs among which a window's anchor is picked
SHARD_CONTEXTS = 30_000  # contexts an index should hold
HOT_CONTEXTS = 15_000  # contexts of one anchor beyond which its windows are dealt out one by one
_BASE = np.uint64(0x9E3779B97F4A7C15)


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the anchors of a text and the first and last window each stands for.

    A window's anchor is its run of GRAM words with the least hash (ties: the leftmost).  Equal windows
    have equal anchors, neighbouring windows mostly share one, and every window has exactly one.
    """
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.view(np.uint64), none, none
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = h[: len(h) - GRAM + 1].copy()
    for j in range(1, GRAM):
        runs = runs * _BASE + h[j : len(h) - GRAM + 1 + j]
    runs ^= runs >> np.uint64(31)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    width = window - GRAM + 1
    place = np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1) + np.arange(len(runs) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return runs[place[first]], first, last


class WaveletMatrix:
    """Rank of any symbol at any position of a sequence, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.depth = max(1, int(kinds - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.depth):
            ones = (symbols >> (self.depth - 1 - level) & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(len(ones) - int(ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` ends up when only the symbol's occurrences before it are kept, level by level."""
        for level in range(self.depth):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = self.before[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where(symbol >> (self.depth - 1 - level) & 1, ones + self.zeros[level], at - ones)
        return at


class FMIndex:
    """Backward search over a token sequence whose rotations are ordered by their first ``depth`` tokens.

    Intervals of patterns up to that length are exact.  ``weight`` counts each position's occurrences.
    """

    def __init__(self, tokens: np.ndarray, weight: np.ndarray, depth: int):
        n = len(tokens)
        rank, span = tokens.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while span < depth:
            later = np.zeros(n, np.int64)
            later[: n - span] = rank[span:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + later
            order = np.argsort(key, kind="stable")
            inside = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(inside[1:] != inside[:-1])])
            span *= 2
        kinds = int(tokens.max(initial=0)) + 1
        last = tokens[order - 1]  # the token before each rotation
        self.size = n
        self.matrix = WaveletMatrix(last.astype(np.int64), kinds)
        every = np.arange(kinds)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=kinds))[:-1]])
        self.offset = smaller - self.matrix.follow(every, np.zeros(kinds, np.int64))
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])

    def extend(self, token: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after putting a token in front of each pattern, and how often the longer patterns occur."""
        moved = self.matrix.follow(np.concatenate([token, token]), np.concatenate([low, high]))
        moved += np.concatenate([self.offset[token]] * 2)
        low, high = moved[: len(token)], moved[len(token) :]
        return low, high, self.weight[high] - self.weight[low]


def repeated_windows(index: FMIndex, tokens: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Marks the positions at which a window of a streamed text starts that occurs at least twice in the index.

    Text i is tokens[start[i]:end[i]].  From its end each text is matched backwards as far as the match
    occurs twice; a match of at least ``window`` tokens marks all windows in it.  Where a match ends, the search
    begins anew at the right end of the next window that is still undecided.
    """
    marked = np.zeros(len(tokens) + 1, np.int64)  # differences of the marked intervals
    lane = np.flatnonzero(end - start >= window)
    first, right = start[lane], end[lane].copy()
    left, low, high = right.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), index.size)
    while len(lane):
        more = left > first
        token = tokens[np.where(more, left - 1, first)]
        new_low, new_high, times = index.extend(token, low, high)
        going = more & (times >= 2)
        low, high, left = np.where(going, new_low, low), np.where(going, new_high, high), left - going
        stopped = ~going
        if stopped.any():
            found = stopped & (right - left >= window)
            np.add.at(marked, left[found], 1)
            np.add.at(marked, right[found] - window + 1, -1)
            again = np.minimum(right - 1, left - 1 + window)
            right = np.where(stopped, again, right)
            left = np.where(stopped, right, left)
            low, high = np.where(stopped, 0, low), np.where(stopped, index.size, high)
            live = ~stopped | (more & (right - first >= window))
            if not live.all():
                first, right, left, low, high, lane = (x[live] for x in (first, right, left, low, high, lane))
    return np.cumsum(marked[:-1]) > 0


def _shard(contexts: list[bytes], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context of one shard the starts of its windows that occur at least twice in the shard."""
    parts = [c.split() for c in contexts]
    sizes = np.array([len(p) for p in parts], np.int64)
    codes: dict[bytes, int] = {}
    words = np.fromiter((codes.setdefault(w, len(codes) + 1) for w in chain.from_iterable(parts)), np.int64, int(sizes.sum()))
    start = np.cumsum(sizes + 1) - sizes - 1
    tokens = np.zeros(int((sizes + 1).sum()), np.int64)  # 0 ends each context
    tokens[np.arange(len(words)) + np.repeat(np.arange(len(parts)), sizes)] = words
    index = FMIndex(tokens, np.repeat(copies, sizes + 1), int(sizes.max(initial=1)))
    marked = repeated_windows(index, tokens, start, start + sizes, window)
    return [np.flatnonzero(marked[a : a + n]).astype(np.int32) for a, n in zip(start, sizes, strict=True)]


def _search(contexts: DataFrame, window: int) -> DataFrame:
    """(h, cid, starts) of the contexts (h, cid, ctx, m) with repeated windows; rows of one h share a shard."""
    shards = max(1, -(-contexts.count() // SHARD_CONTEXTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        found = _shard(table["ctx"].cast(pa.large_binary()).to_pylist(), table["m"].to_numpy(), window)
        keep = np.array([len(f) > 0 for f in found], bool)
        rows = table.select(["h", "cid"]).filter(pa.array(keep)).append_column("starts", pa.array([f for f in found if len(f)], pa.list_(pa.int32())))
        yield from rows.combine_chunks().to_batches()

    return contexts.repartition(shards, "h").select("h", "cid", "ctx", "m").mapInArrow(run, "h bigint, cid bigint, starts array<int>")


def _repeated(contexts: DataFrame, window: int) -> DataFrame:
    """As ``_search``; anchors with very many contexts are dealt out window by window, so no shard must hold them."""
    crowded = stage(contexts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_CONTEXTS).select("h"), "crowded")
    if not crowded.limit(1).count():
        return _search(contexts, window)
    words = F.split("ctx", " ")
    each = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.array_join(F.slice(words, i, window), " "))
    single = contexts.join(crowded, "h", "left_semi").select("h", "cid", "m", F.posexplode(each).alias("at", "ctx"))
    single = stage(single.withColumn("w", F.xxhash64("ctx")).withColumn("w2", F.xxhash64(F.lit(2), "ctx")), "windows")
    distinct = single.groupBy("w", "w2", "ctx").agg(F.sum("m").alias("m"))
    hit = _search(distinct.select(F.col("w").alias("h"), F.col("w2").alias("cid"), "ctx", "m"), window).select(F.col("h").alias("w"), F.col("cid").alias("w2"))
    back = single.join(hit, ["w", "w2"]).groupBy("h", "cid").agg(F.array_distinct(F.collect_list("at")).alias("starts"))
    return _search(contexts.join(crowded, "h", "left_anti"), window).union(back)


def _describe(docs: DataFrame, window: int) -> DataFrame:
    """Per row: id, text keys, n_words, the digest of its words and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for value in batch.column("text").cast(pa.large_binary()):
                words = (value.as_py() or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(anchors(words, window)[0].view(np.int64))
            rest = [batch.column(c) for c in ("id", "__k1", "__k2")]
            new = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*rest, *new], ["id", "__k1", "__k2", "n_words", "sha", "anchors"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, __k1 bigint, __k2 bigint, n_words bigint, sha string, anchors array<bigint>")


def _contexts(texts: DataFrame, window: int) -> DataFrame:
    """Per anchor that other places share: the words of all its windows, and where the first of them starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k1, k2, value, shared in zip(*[batch.column(c) for c in ("__k1", "__k2")], batch.column("text").cast(pa.large_binary()), batch.column("shared"), strict=True):
                words = value.as_py().split()
                h, first, last = anchors(words, window)
                h = h.view(np.int64)
                for i in np.flatnonzero(np.isin(h, shared.values.to_numpy())):
                    row = (k1.as_py(), k2.as_py(), int(h[i]), int(first[i]), b" ".join(words[first[i] : last[i] + window]))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, ["__k1", "__k2", "h", "first", "ctx"])

    return texts.select("__k1", "__k2", "text", "shared").mapInArrow(run, "__k1 bigint, __k2 bigint, h bigint, first int, ctx string")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """Per text: how many words its repeated windows (``starts``, lists of lists) cover, and the rest's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for value, starts in zip(batch.column("text").cast(pa.large_binary()), batch.column("starts"), strict=True):
                words = value.as_py().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.concatenate([np.asarray(s, np.int64) for s in starts.as_py()]))
                change[at] += 1
                change[at + window] -= 1
                covered = np.cumsum(change[:-1]) > 0
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, c in zip(words, covered, strict=True) if not c)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("__k1"), batch.column("__k2"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["__k1", "__k2", "removed", "cut_sha"])

    return texts.select("__k1", "__k2", "text", "starts").mapInArrow(run, "__k1 bigint, __k2 bigint, removed bigint, cut_sha string")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed and kept_sha256 (digest of the words that stay).

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in the same
    document or another; windows are judged on the input.  Equal texts are handled once: all their windows
    are repeated.  Every window has an anchor that depends on its words alone; anchors that occur once
    cannot lie in a repeated window, and the contexts of the others meet in shards by anchor, where an
    FM-index over them answers for each streamed context which of its windows occur again.  Null and
    short texts lose nothing; repeated rows are copies of each other.
    """
    if window <= GRAM:
        raise ValueError(f"a window needs more than {GRAM} words")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *text_keys(F.col(text_col)))
    info = stage(_describe(rows, window), "info")
    texts = info.groupBy("__k1", "__k2").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    places = stage(texts.select("__k1", "__k2", "copies", F.explode_outer("anchors").alias("h")), "places")
    shared = places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1 AND h IS NOT NULL").select("h")
    wanted = places.join(shared, "h").groupBy("__k1", "__k2").agg(F.collect_set("h").alias("shared"))  # anchors of one text
    one = Window.partitionBy("__k1", "__k2").orderBy("id")
    single = rows.withColumn("n", F.row_number().over(one)).filter("n = 1").select("__k1", "__k2", "text")
    sources = stage(single.join(wanted, ["__k1", "__k2"]), "sources")
    contexts = stage(_contexts(sources, window).withColumn("cid", F.xxhash64("ctx")), "contexts")
    hits = _repeated(stage(contexts.groupBy("h", "cid", "ctx").agg(F.count("*").alias("m")), "distinct"), window)
    placed = contexts.select("__k1", "__k2", "h", "cid", "first").join(hits, ["h", "cid"])
    starts = placed.groupBy("__k1", "__k2").agg(F.collect_list(F.transform("starts", lambda s: s + F.col("first"))).alias("starts"))  # windows of one text
    cut = _cut(sources.select("__k1", "__k2", "text").join(starts, ["__k1", "__k2"]), window)
    copies = places.groupBy("__k1", "__k2").agg(F.max("copies").alias("copies"))
    verdict = copies.join(cut, ["__k1", "__k2"], "left")
    out = info.drop("anchors").join(verdict.withColumnsRenamed({"__k1": "a", "__k2": "b"}), (F.col("__k1") == F.col("a")) & (F.col("__k2") == F.col("b")))
    all_ = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(all_, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
