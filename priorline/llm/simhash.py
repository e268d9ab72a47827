"""SimHash near-duplicates found through tables of distances to reference fingerprints."""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import forget, stage, text_keys
from priorline.llm.graph import components

BITS = 64
REFERENCES = 8  # whole-fingerprint references whose distances are compared before a pair is verified
BLOCK_REFERENCES = 10  # references per block of bits; their distances are packed four bits each
LARGE = 16  # members of one bucket up to which all its pairs are looked at


def reference(name: str) -> int:
    """A reference fingerprint, by rule, as a signed 64-bit value."""
    return int(np.uint64(xxhash.xxh64_intdigest(name, 42)).astype(np.int64))


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats kept; a shorter text is one run, no word none."""
    found = (text or b"").lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not found:
        return np.zeros(0, np.uint64)
    body, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    pairs = zip(starts.tolist(), last.tolist(), strict=False)
    return np.fromiter((xxhash.xxh64_intdigest(body[a:b], 42) for a, b in pairs), np.uint64, len(last))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 hash bits per shingle; lane 0 is the hash itself."""
    if not lane:
        return h
    h = (h ^ np.uint64(xxhash.xxh64_intdigest(f"lane {lane}", 42))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed value."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def simhash(text: Column, words: int = 3, lanes: int = 1, distinct: bool = False) -> Column:
    """Array of ``lanes`` 64-bit SimHash fingerprints of a whole text (null: no words, all zero).

    ``distinct`` counts a repeated shingle once, as a similarity of shingle sets does.
    """

    @F.arrow_udf("array<bigint>")
    def prints(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            values = []
            for piece in part.cast(pa.large_binary()):
                h = shingle_hashes(piece.as_py(), words)
                h = np.unique(h) if distinct else h
                values += [_majority(_mixed(h, lane)) for lane in range(lanes)]
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, lanes), pa.int32()), pa.array(values, pa.int64()))

    return prints(text)


def copy_prints(text: Column, words: int) -> Column:
    """The operator's own fingerprint (three words, repeats kept), then LANES of distinct shingles of ``words`` words."""

    @F.arrow_udf("array<bigint>")
    def prints(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            values = []
            for piece in part.cast(pa.large_binary()):
                values.append(_majority(shingle_hashes(piece.as_py(), 3)))
                h = np.unique(shingle_hashes(piece.as_py(), words))
                values += [_majority(_mixed(h, lane)) for lane in range(LANES)]
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, LANES + 1), pa.int32()), pa.array(values, pa.int64()))

    return prints(text)


def shingle_set(text: Column, words: int) -> Column:
    """Distinct shingle hashes of a whole text."""

    @F.arrow_udf("array<bigint>")
    def hashes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([np.unique(shingle_hashes(x.as_py(), words)).view(np.int64) for x in part.cast(pa.large_binary())], pa.list_(pa.int64()))

    return hashes(text)


def _distance(a: Column, b: Column | int, mask: int = -1) -> Column:
    if not isinstance(b, Column):
        b = F.lit(b).cast("long")
    bits = a.bitwiseXOR(b)
    return F.bit_count(bits if mask == -1 else bits.bitwiseAND(F.lit(mask).cast("long")))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _block_codes(fp: Column, blocks: int) -> list[Column]:
    """Per block of bits, the packed distances of the fingerprint to that block's references.

    Fingerprints that agree on a block have the same distances; a single differing bit changes all of them.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    codes = []
    for low, high in zip(edges, edges[1:], strict=False):
        mask = _signed(((1 << high) - 1) ^ ((1 << low) - 1))
        one = [F.shiftleft(_distance(fp, reference(f"block {low} {j}"), mask).cast("long"), 4 * j) for j in range(BLOCK_REFERENCES)]
        codes.append(reduce(lambda a, b: a + b, one))
    return codes


def _coordinates(fp: Column) -> list[Column]:
    return [_distance(fp, reference(f"whole {j}")).cast("tinyint").alias(f"d{j}") for j in range(REFERENCES)]


def linked_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) whose components are those of all links between distinct fingerprints (column fp).

    Two fingerprints link when at most ``radius`` bits differ.  With radius + 4 blocks of bits, linked
    ones agree on four whole blocks, so they have equal distance tables there and meet in a bucket of
    those tables.  Up to LARGE members, a bucket's pairs are taken, those whose distances to the whole
    references differ by more than ``radius`` anywhere are discarded, and the rest are verified.  In
    larger buckets pairs would grow with the square of the group, so each member is joined to the
    points half the radius away, one row per point: members within the radius share a point, and those
    sharing one are within it.  Points are then nodes of the graph; they are no fingerprints of their own.
    The point form needs an even radius and is written for 2.
    """
    if radius != 2:
        raise ValueError("the exact form for large buckets is written for a radius of 2")
    from itertools import combinations

    blocks = radius + 4
    nodes = prints.select("fp", *_coordinates(F.col("fp")), *[c.alias(f"c{i}") for i, c in enumerate(_block_codes(F.col("fp"), blocks))])
    buckets = [F.xxhash64(F.lit(k), *[F.col(f"c{i}") for i in chosen]) for k, chosen in enumerate(combinations(range(blocks), 4))]
    coordinates = [f"d{j}" for j in range(REFERENCES)]
    members = nodes.select("fp", *coordinates, F.explode(F.array(*buckets)).alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(members.join(sizes, "key"), "buckets")
    one = shared.filter(F.col("n") <= LARGE)
    other = one.select("key", F.col("fp").alias("fp2"), *[F.col(c).alias(f"{c}_2") for c in coordinates])
    apart = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}_2")) for c in coordinates])
    near = (
        one.join(other, "key")
        .filter((F.col("fp") < F.col("fp2")) & (apart <= radius))
        .filter(_distance(F.col("fp"), F.col("fp2")) <= radius)
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )
    crowd = shared.filter(F.col("n") > LARGE).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS)])
    points = crowd.select(F.col("fp").alias("a"), F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("b"))
    shared_points = points.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b")
    return near.union(points.join(shared_points, "b").filter("a <> b").select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (long ``fp``) and ``component_id``, the least id reachable by links.

    Null texts and texts without words have fingerprint zero, which links like any other.  Rows with a
    null id stay; a component of null ids only has a null component id.  Repeated rows are repeated.
    """
    prints = stage(docs.select(F.col(id_col).alias("__id"), simhash(F.col(text_col), words)[0].alias("fp")), "prints")
    return grouped(prints, radius).withColumnRenamed("__id", id_col)


def grouped(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints`` (__id, fp) with ``component_id``, the least id reachable by links between fingerprints."""
    distinct = stage(prints.groupBy("fp").agg(F.min("__id").alias("least")), "distinct")
    label = components(linked_fingerprints(distinct, radius)).withColumnRenamed("node", "fp")
    known = distinct.join(label, "fp")
    best = known.groupBy("component").agg(F.min("least").alias("component_id"))
    found = known.join(best, "component").select("fp", "component_id")
    final = distinct.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(final, "fp").select("__id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- near copies: the links above, and shingle similarity with SimHash tables giving the candidates ---

LANES = 4
CANDIDATE_BITS = 54  # of 256; similarity 0.8 differs in 39 on average, with a deviation of 5.8: one pair in 200 lies beyond
AGREE = 0.8485  # probability that one bit agrees at similarity 0.8


def table_shape(texts: int) -> tuple[int, int]:
    """Bits per key and number of tables for so many texts.

    Sixteen keys for every text keep chance meetings rare at any size; the tables make up for the longer
    keys, so that a pair of similarity 0.8 meets with probability 0.95 (three expected meetings).
    """
    bits = max(16, int(texts).bit_length() + 4)
    return bits, int(np.ceil(3 / AGREE**bits))


def _table_keys(lanes: Column, bits: int, tables: int) -> Column:
    """Bucket of the text in each table: its bits at positions that the table's number fixes."""
    masks = np.zeros((tables, LANES), np.uint64)
    for table in range(tables):
        for spot in np.random.default_rng(table).choice(BITS * LANES, min(bits, BITS * LANES), replace=False):
            masks[table, spot // BITS] |= np.uint64(1) << np.uint64(spot % BITS)

    @F.arrow_udf("array<bigint>")
    def keys(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            prints = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, LANES)
            out = np.empty((len(prints), tables), np.uint64)
            for table in range(tables):
                h = np.full(len(prints), table, np.uint64)
                for lane in range(LANES):
                    h = _mixed((h * np.uint64(0x9E3779B97F4A7C15)) ^ (prints[:, lane] & masks[table, lane]), 1)
                out[:, table] = h
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel().view(np.int64)))

    return keys(lanes)


def _close(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [_distance(F.col(a)[i], F.col(b)[i]) for i in range(LANES)]) <= CANDIDATE_BITS


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether two shingle sets reach the similarity; the sizes alone rule out most that do not."""
    small, large, both = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b)), F.size(F.array_intersect(a, b))
    return (small >= F.lit(similarity) * large) & (both >= F.lit(similarity) * (small + large - both))


def _similar(pairs: DataFrame, prints: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The candidate pairs (a, b), not linked yet, whose fingerprints are close and whose shingle sets are similar enough."""
    left = prints.select(F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("c").alias("ca"))
    right = prints.select(F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("c").alias("cb"))
    open_ = (F.col("ca") != F.col("cb")) & _close("fa", "fb")
    close = stage(pairs.distinct().join(left, "a").join(right, "b").filter(open_).select("a", "b"), "close")
    known = stage(sets(close.select(F.col("a").alias("node")).union(close.select("b")).distinct()), "sets")
    left, right = known.select(F.col("node").alias("a"), F.col("s").alias("sa")), known.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    found = stage(close.join(left, "a").join(right, "b").filter(_alike("sa", "sb", similarity)).select("a", "b"), "links")
    forget(close, known)
    return found


def near_copy_pairs(prints: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float = 0.8) -> DataFrame:
    """Links (a, b) whose components are those of all verified pairs that share a bucket and of the links known before.

    ``prints``: node, fp (LANES fingerprints), c (least node linked to it before, by the distance tables); ``sets`` gives
    node and s, the shingle set of the whole text, for a table of nodes.  A link is a similarity of shingle sets of at
    least ``similarity``; the tables only propose.
    First each member is compared with its bucket's least node, one pair per row.  Members of a bucket
    that now share a component need no further look, as no pair of them can change the result; pairs of
    one bucket that lie in different components are all compared.  A group of copies is thus linked in
    the first step, and no pair that shares a bucket is left out.
    """
    bits, tables = table_shape(prints.count())
    # dealt out once: the sizes and the members read the same shuffle
    members = prints.select("node", F.explode(_table_keys(F.col("fp"), bits, tables)).alias("key")).repartition("key")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    shared = stage(members.join(sizes, "key"), "buckets")
    pairs = shared.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    first = _similar(pairs, prints, sets, similarity).union(prints.filter("node <> c").select(F.col("node").alias("a"), F.col("c").alias("b")))
    label = components(first)
    # what belongs to a text is joined once per text, not once per bucket it is in; a text has no more buckets than tables
    placed = shared.filter("n > 2").groupBy("node").agg(F.collect_list(F.struct("key", "least")).alias("at")).join(label, "node", "left")
    placed = placed.select("node", F.coalesce("component", "node").alias("c"), F.inline("at"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    buckets = placed.join(mixed, "key").groupBy("node", "c").agg(F.collect_list(F.struct("key", "least")).alias("at"))
    held = stage(buckets.join(prints.select("node", "fp"), "node").select("node", "c", "fp", F.inline("at")), "held")
    mates = held.select(F.col("key").alias("k2"), F.col("c").alias("cb"), F.col("fp").alias("fb"))
    apart = (F.col("key") == F.col("k2")) & (F.col("c") != F.col("cb")) & _close("fp", "fb")
    near = stage(held.join(mates, apart, "left_semi"), "near")
    # with their shingle sets, so that the join itself turns down what does not link: a large group of texts
    # that are mostly below the similarity still takes its comparisons, but makes no rows of them
    known = stage(sets(near.select("node").distinct()), "known")
    buckets = near.groupBy("node", "c", "fp").agg(F.collect_list(F.struct("key", "least")).alias("at"))
    rest = buckets.join(known, "node").select("node", "c", "fp", "s", F.inline("at"))
    other = rest.select(F.col("key").alias("k2"), F.col("node").alias("b"), F.col("c").alias("cb"), F.col("fp").alias("fb"), F.col("s").alias("sb"))
    new = (F.col("node") < F.col("b")) & (F.col("node") != F.col("least"))
    second = rest.join(other, apart & new & _alike("s", "sb", similarity)).select(F.col("node").alias("a"), "b").distinct()
    links = stage(first.union(second), "all_links")
    forget(shared, held, near, known)
    return links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row of every group of exact or near copies, columns unchanged.

    Exact copies are equal texts (nulls are equal).  Near copies are the links of ``near_duplicates``, found exactly through its
    distance tables (fingerprints at 2 or fewer differing bits), and texts whose shingle sets have at least the given
    Jaccard similarity and that meet in one of the tables of SimHash bits.  At similarity 0.8 a pair meets there
    with probability 0.95, from 0.85 on with 0.99 and more.  Groups are joined by either kind of link; the least id
    stays (null ids last).  Texts without a word have no shingles and are copies of equal texts only.  Column names that
    start with two underscores are reserved.

    Only keys and fingerprints take part in the search.  Texts are shuffled twice: once for the shingle sets that are
    compared and once for the rows that stay.
    """
    if words != 5:
        raise ValueError("near copies are compared on shingles of five words")

    def numbered(c: Column) -> Column:
        return F.xxhash64(c.isNull(), c).alias("__i")

    def rows_of(columns: DataFrame, wanted: DataFrame) -> DataFrame:
        """One row for each wanted text and id; what is wanted grows with the input, so it is never broadcast."""
        return columns.join(wanted.hint("merge"), ["__k1", "__k2", "__i"], "left_semi").dropDuplicates(["__k1", "__k2", "__i"])

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = one.join(nodes.withColumnRenamed("node", "__k1"), "__k1", "left_semi").select("__k1", "__k2", "__i")
        texts = docs.select(F.col(text_col).alias("__text"), *key, numbered(F.col(id_col)))
        return rows_of(texts, wanted).select(F.col("__k1").alias("node"), shingle_set(F.col("__text"), words).alias("s"))

    key, found = text_keys(F.col(text_col)), [f"__p{i}" for i in range(LANES + 1)]
    marks = docs.select(F.col(id_col).alias("__id"), *key, F.col(text_col).rlike(r"[^\x20\x09-\x0D]").alias("__worded"), copy_prints(F.col(text_col), words).alias("__p"))
    marks = marks.select("__id", "__k1", "__k2", "__worded", *[F.col("__p")[i].alias(c) for i, c in enumerate(found)])
    # equal texts have equal marks, so any of theirs will do; min leaves null ids out unless there is no other
    one = marks.groupBy("__k1", "__k2").agg(F.min("__id").alias("__id"), *[F.min(c).alias(c) for c in ("__worded", *found)])
    one = stage(one.withColumn("__i", numbered(F.col("__id"))), "texts")
    worded = one.filter("__worded")
    linked = grouped(worded.select(F.col("__k1").alias("__id"), F.col(found[0]).alias("fp"))).select(F.col("__id").alias("node"), F.col("component_id").alias("c"))
    prints = stage(worded.select(F.col("__k1").alias("node"), F.array(*found[1:]).alias("fp")).join(linked, "node"), "linked")
    links = near_copy_pairs(prints, sets, similarity)
    ranked = components(links).join(one.select(F.col("__k1").alias("node"), F.col("__id").alias("id")), "node")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))
    kept = ranked.groupBy("component").agg(F.min_by("node", order).alias("keep"))
    gone = ranked.join(kept, "component").filter("node <> keep").select(F.col("node").alias("__k1")).distinct()
    wanted = stage(one.join(gone, "__k1", "left_anti").select("__k1", "__k2", "__i"), "kept")
    forget(one, prints, links)
    return rows_of(docs.select("*", *key, numbered(F.col(id_col))), wanted).select(*docs.columns)
