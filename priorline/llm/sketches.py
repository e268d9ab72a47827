"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.session import freed_shuffles, work_folder

LONGEST = 256  # characters of a piece without an end of its own
KEY_BITS = 40  # of a digest; sums of them fit a long for any text
TABLES = 3
CELLS = 8  # cells per table of a fingerprint and of the first try
WIDER = 32  # times as many after each failure; cells without a digest are no rows, so wide tables cost nothing
ROUNDS = 2  # in which every table is peeled once; what is not whole then is tried again in wider tables
TASK_DIGESTS = 1 << 18  # in the lists that one task works on


def paragraphs(text: Column) -> Column:
    """The whole text in pieces that its own marks end, wherever they stand and however long the text is.

    A piece ends with its line or sentence; in a run of over LONGEST characters without such an end, with the
    first word after a short stretch that ends in a vowel, and without that at the longest length.
    """
    most = LONGEST - 1
    ends = rf".{{0,{most}}}?(?:\n|[。！？।]|[.!?…؟]\s)|.{{{LONGEST // 8},{most}}}?[aeiouаеиоуαειο]\s|.{{1,{LONGEST}}}"
    return F.regexp_extract_all(text, F.lit(f"(?s){ends}"), F.lit(0))


def digests(text: Column) -> Column:
    """Paragraph digests in order, as numbers of KEY_BITS bits; a null text has none."""
    mask = F.lit((1 << KEY_BITS) - 1).cast("long")
    return F.transform(F.coalesce(paragraphs(text), F.array().cast("array<string>")), lambda p: F.xxhash64(p).bitwiseAND(mask))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit((1 << KEY_BITS) - 1).cast("long"))


def _place(key: Column, table: Column, cells: int) -> Column:
    """Cell of a digest in one table; cells are numbered through all tables."""
    return F.pmod(F.xxhash64(key, table.cast("int")), F.lit(cells).cast("long")) + table * cells


def _lanes(tables: list[int]) -> Column:
    return F.array(*[F.lit(t).cast("long") for t in tables])


def _summed(rows: DataFrame, of: list[str]) -> DataFrame:
    return rows.groupBy(*of, "at").agg(*[F.sum(c).alias(c) for c in ("n", "k", "x")])


def _occupied(cells: DataFrame) -> DataFrame:
    return cells.filter("at < 0 OR n <> 0 OR k <> 0 OR x <> 0")


def sketch(digested: DataFrame, of: list[str], cells: int, blank: list[int]) -> DataFrame:
    """Sketches of lists of digests, a row per cell.  Digests: columns ``of`` name the list, ``key`` occurs ``times`` times.

    A cell ``at`` holds n (digests in it), k (their sum) and x (the sum of their check hashes).  Sums, unlike exclusive ors,
    keep a digest that occurs twice apart from one that does not occur, and cells of two lists can be subtracted: a list
    whose digests occur -1 times takes them away.  A null digest adds nothing to the cells of ``blank`` but makes them rows.
    """
    put = digested.select(*of, "key", "times", _check(F.col("key")).alias("c"), F.explode(F.when(F.col("key").isNull(), _lanes(blank)).otherwise(_lanes(range(TABLES)))).alias("t"))
    at = F.when(F.col("key").isNull(), F.col("t")).otherwise(_place(F.col("key"), F.col("t"), cells))
    sums = [F.when(F.col("key").isNull(), 0).otherwise(v).cast("long").alias(c) for c, v in (("n", F.col("times")), ("k", F.col("key") * F.col("times")), ("x", F.col("c") * F.col("times")))]
    return _summed(put.select(*of, at.alias("at"), *sums), of)


_FOUND, _KEPT = -1, -2  # where found digests are counted, and the mark of a cell that stays


def peel(difference: DataFrame, of: list[str], cells: int) -> DataFrame:
    """How many digests, copies counted, the sketches of ``_occupied`` cells hold; null where some cannot be taken out.

    A cell that holds copies of one digest only shows it: the sums divide by the number, and check and place fit.  Tables
    take turns: all digests that one table shows, each in one cell of it, leave the other tables' cells.
    """
    for table in [*range(TABLES)] * ROUNDS:
        inside = F.col("at").between(table * cells, (table + 1) * cells - 1)
        shown = difference.withColumn("key", F.when(inside, F.expr("k DIV nullif(n, 0)")))
        key = F.col("key")
        shows = (key >= 0) & (key * F.col("n") == F.col("k")) & (_check(key) * F.col("n") == F.col("x")) & (_place(key, F.lit(table).cast("long"), cells) == F.col("at"))
        moves = F.when(shows, _lanes([_FOUND, *[t for t in range(TABLES) if t != table]])).otherwise(_lanes([_KEPT]))
        moved = shown.select(*of, "at", "n", "k", "x", "key", F.explode(moves).alias("t"))
        to = F.col("t")
        at = F.when(to == _KEPT, F.col("at")).when(to == _FOUND, to).otherwise(_place(key, to, cells))
        n = F.when(to == _KEPT, F.col("n")).when(to == _FOUND, F.abs("n")).otherwise(-F.col("n"))
        rest = [F.when(to == _KEPT, F.col(c)).when(to == _FOUND, 0).otherwise(-F.col(c)).cast("long").alias(c) for c in ("k", "x")]
        difference = _occupied(_summed(moved.select(*of, at.alias("at"), n.alias("n"), *rest), of))
    out = difference.groupBy(*of).agg(F.max(F.when(F.col("at") == _FOUND, F.col("n"))).alias("n"), F.count_if(F.col("at") >= 0).alias("stay"))
    return out.select(*of, F.when(F.col("stay") == 0, F.col("n")).alias("n"))


def _digested(lists: DataFrame, of: list[str]) -> DataFrame:
    """A row per digest of ``keys``, and one without for each list."""
    return lists.select(*of, "times", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key"))


def _stage(df: DataFrame, name: str) -> DataFrame:
    """Written and read back; digests are numbers without order, which take a third less when packed harder."""
    path = work_folder(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tasks(sizes: DataFrame) -> int:
    return 1 + (sizes.agg(F.sum("size")).first()[0] or 0) // TASK_DIGESTS


def differing(pairs: DataFrame, of: list[str]) -> DataFrame:
    """How many digests differ between a and b of every pair, copies counted: the peeled difference of their sketches.

    All pairs begin with CELLS cells a table; those that do not come out whole are built again with WIDER times as many,
    so the size follows the difference.  The result is exact, up to equal hashes.  ``of`` names a pair and is unique,
    ``size`` is the number of its digests.
    """
    sizes, failed, cells, whole = pairs.select(*of, "size"), None, CELLS, []
    while True:
        # all rows of a pair stay in its task, however many cells and digests they become
        left = pairs.repartition(_tasks(sizes), *of)
        if failed:
            left = left.join(failed.hint("shuffle_hash"), of)  # a semi-join would be moved before the shuffle and need one of its own
        sides = left.select(*of, F.inline(F.array(F.struct(F.col("a").alias("keys"), F.lit(1).alias("times")), F.struct(F.col("b").alias("keys"), F.lit(-1).alias("times")))))
        tried = _stage(peel(_occupied(sketch(_digested(sides, of), of, cells, [_FOUND])), of, cells), "peeled")
        whole.append(tried.filter("n IS NOT NULL"))
        failed = tried.filter("n IS NULL").select(*of)
        if failed.isEmpty():
            return reduce(DataFrame.union, whole)
        sizes, cells = pairs.select(*of, "size").join(failed, of, "left_semi"), cells * WIDER


def fingerprints(lists: DataFrame) -> DataFrame:
    """row, and the sketches of its own and edited digests as strings: n, k and x of every cell in hexadecimal, empty cells empty."""
    each = TABLES * CELLS
    tasks = _tasks(lists.select((F.col("own_size") + F.col("edited_size")).alias("size")))
    sides = lists.select("row", "own", "edited").repartition(tasks, "row")
    sides = sides.select("row", F.inline(F.array(*[F.struct(F.lit(i * each).alias("from"), F.col(c).alias("keys"), F.lit(1).alias("times")) for i, c in enumerate(("own", "edited"))])))
    cells = sketch(_digested(sides, ["row", "from"]), ["row", "from"], CELLS, list(range(each)))
    shown = F.when(F.col("n") == 0, "").otherwise(F.lower(F.concat_ws(".", F.hex("n"), F.hex("k"), F.hex("x"))))
    rows = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((F.col("from") + F.col("at")).alias("at"), shown.alias("shown")))).alias("c"))
    return rows.select("row", *[F.array_join(F.slice("c.shown", i * each + 1, each), ",").alias(f) for i, f in enumerate(("fingerprint", "edited_fingerprint"))])


def _near(differ: str, a: str, b: str) -> Column:
    """One less the share of digests that differ, 0 to 1; texts without digests are alike only to each other."""
    total = F.col(a) + F.col(b)
    return F.when(total == 0, 1.0).otherwise(1 - F.col(differ) / F.nullif(total, F.lit(0)))


def _hashed(keys: np.ndarray, salt: int) -> np.ndarray:
    h = (keys.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _checks(keys: np.ndarray) -> np.ndarray:
    return (_hashed(keys, TABLES) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


class Sketches:
    """Sketches of many digest lists in memory: three tables of cells each, in three flat arrays.  Tables of texts use `sketch` and `peel`.

    A cell holds n (digests in it), k (their sum) and x (the sum of their check hashes).  Sums, unlike exclusive ors,
    keep a digest that occurs twice apart from one that does not occur, and cells of two versions can be subtracted.
    """

    def __init__(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray, cells: np.ndarray):
        """List ``owner[i]`` gets digest ``keys[i]`` ``sign[i]`` times; list j has ``cells[j]`` cells a table."""
        self.cells = cells
        self.base = np.concatenate([[0], np.cumsum(TABLES * cells)])
        self.n, self.k, self.x = (np.zeros(self.base[-1], np.int64) for _ in range(3))
        self._add(keys, owner, sign)

    def _places(self, keys: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        width = self.cells[owner]
        for table in range(TABLES):
            yield self.base[owner] + table * width + (_hashed(keys, table) % width.astype(np.uint64)).astype(np.int64)

    def _add(self, keys: np.ndarray, owner: np.ndarray, times: np.ndarray) -> None:
        sums, checks = keys * times, _checks(keys) * times
        for at in self._places(keys, owner):
            np.add.at(self.n, at, times)
            np.add.at(self.k, at, sums)
            np.add.at(self.x, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, times) of all digests that can be taken out, and which lists came out whole.

        A cell that holds one digest only, however often, shows it: the sums divide by the number and check and place
        fit.  Each round takes all such digests out of all their cells, until none is left.
        """
        lists = np.repeat(np.arange(len(self.cells)), TABLES * self.cells)
        found = []
        live = np.flatnonzero(self.n)
        while len(live):
            n, k = self.n[live], self.k[live]
            fits = (k % n == 0) & (k // n >= 0)
            at, n, key = live[fits], n[fits], (k // n)[fits]
            own = lists[at]
            shows = (_checks(key) * n == self.x[at]) & np.logical_or.reduce([p == at for p in self._places(key, own)])
            pure = np.unique(np.stack([own[shows], key[shows], n[shows]]), axis=1)
            if not pure.shape[1]:
                break
            found.append(pure)
            self._add(pure[1], pure[0], -pure[2])
            live = live[self.n[live] != 0]
        rest = (self.n != 0) | (self.k != 0) | (self.x != 0)
        whole = np.bincount(lists[rest], minlength=len(self.cells)) == 0
        return *(np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)), whole


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many digests differ between a[i] and b[i], copies counted: the peeled difference of their sketches.

    All pairs begin with CELLS cells a table; those that do not come out whole are built again with four times as
    many, so the size follows the difference.  The result is exact, up to equal hashes.
    """
    out = np.zeros(len(a), np.int64)
    todo, cells = np.arange(len(a)), CELLS
    while len(todo):
        keys = np.concatenate([*(a[i] for i in todo), *(b[i] for i in todo), np.zeros(0, np.int64)])
        left, right = [len(a[i]) for i in todo], [len(b[i]) for i in todo]
        owner = np.repeat(np.concatenate([np.arange(len(todo))] * 2), left + right)
        sign = np.repeat([1, -1], [sum(left), sum(right)])
        own, _, times, whole = Sketches(keys, owner, sign, np.full(len(todo), cells)).peel()
        out[todo[whole]] = np.bincount(own, np.abs(times), len(todo)).astype(np.int64)[whole]
        todo, cells = todo[~whole], cells * 4
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """One less the share of digests that differ, 0 to 1; texts without digests are alike only to each other."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(total == 0, 1.0, 1 - differences(a, b) / np.maximum(total, 1))


GAP = 4096  # ids per slice when the next id is looked for


def following(ids: DataFrame) -> DataFrame:
    """(k, next) for distinct ids k: the next larger one, after the largest the smallest.

    Ids are cut into slices of about GAP; the slices' first ids, one row per slice, are ordered in one window.
    """
    ends = ids.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"))
    width = F.greatest(F.lit(1.0), (F.col("hi").cast("double") - F.col("lo").cast("double") + 1) / F.greatest(F.lit(1.0), F.col("n") / GAP))
    rows = ids.crossJoin(F.broadcast(ends.select("lo", width.alias("w"))))  # one row
    rows = rows.select("k", "lo", F.floor((F.col("k").cast("double") - F.col("lo").cast("double")) / F.col("w")).alias("s"))
    firsts = rows.groupBy("s").agg(F.min("k").alias("first"), F.first("lo").alias("lo"))
    later = firsts.select(F.col("s").alias("s2"), F.coalesce(F.lead("first").over(Window.orderBy("s")), F.col("lo")).alias("then"))
    inside = rows.withColumn("in", F.lead("k").over(Window.partitionBy("s").orderBy("k")))
    return inside.join(later, F.col("s") == F.col("s2")).select("k", F.coalesce("in", "then").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited version of it.

    The edit replaces the last quarter of the code points by the first as many (or all) of the next
    document in ascending id order; the last is followed by the first.  Columns: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts are empty.  A
    null id sorts before all others; of rows that share an id each is a row of the result, and the least text
    among them is what the document before them borrows from.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(-(1 << 63)).cast("long")).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.length("text").alias("n"), digests(F.col("text")).alias("d"))
    order = following(rows.select("k").distinct())
    # what each document needs of the next: at most a quarter of its own length, for the longest of its rows
    asked = rows.groupBy("k").agg(F.max(F.floor(F.col("n") / 4)).cast("int").alias("need")).join(order, "k").select(F.col("k").alias("by"), F.col("next").alias("k"), "need")
    piece = F.substring(F.col("text"), F.lit(1), F.least("need", "n"))
    # reads the same columns as the join below, so that both share one shuffle of the texts
    given = rows.join(asked, "k").select("by", F.struct(piece.alias("piece"), F.sha2("text", 256).alias("h"), "d", "id").alias("next"))
    given = given.groupBy("by").agg(F.min("next").alias("next"))
    both = rows.join(given, F.col("k") == F.col("by"))
    quarter = F.floor(F.col("n") / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - quarter), F.substring(F.col("next.piece"), F.lit(1), quarter)))
    both = both.select("id", "n", "d", F.col("next.d").alias("nd"), F.sha2("edited", 256).alias("sha"), digests(F.col("edited")).alias("ed"))
    # every row becomes many digests below; as a table, no text is read for them again
    sizes = [F.size(c).alias(f"{c}_size") for c in ("own", "edited", "after")]
    lists = both.select(F.monotonically_increasing_id().alias("row"), "id", "n", "sha", F.col("d").alias("own"), F.col("ed").alias("edited"), F.col("nd").alias("after"))
    lists = _stage(lists.select("*", *sizes), "digests")
    pairs = lists.select("row", F.inline(F.array(*[F.struct(F.lit(i).alias("side"), (F.col("own_size") + F.col(f"{b}_size")).alias("size"), F.col("own").alias("a"), F.col(b).alias("b")) for i, b in enumerate(("edited", "after"))])))
    near = differing(pairs, ["row", "side"]).groupBy("row").agg(*[F.max(F.when(F.col("side") == i, F.col("n"))).alias(c) for i, c in enumerate(("from_edited", "from_next"))])
    done = lists.drop("own", "edited", "after").join(near, "row").join(fingerprints(lists), "row")
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        _near("from_edited", "own_size", "edited_size").alias("near_edited"),
        _near("from_next", "own_size", "after_size").alias("near_next"),
    )
