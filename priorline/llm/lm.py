"""Cross-entropy difference of two n-gram models over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorline.llm.common import stage, without

MARK = "\x02"  # stands before a text's first character
CHUNK = 4 << 20  # characters looked at together
BLOCK_ROWS = 4096  # documents that look their n-grams up together
SCORES = ["n_tokens", "loss_target", "loss_background", "loss_difference"]


def _pieces(texts: Iterable[str | None], order: int, chunk: int) -> Iterator[tuple[list[int], list[str]]]:
    """(place of the text, order - 1 characters of context and a stretch of the text) in lists of about ``chunk`` characters."""
    places, parts, held = [], [], 0
    for place, text in enumerate(texts):
        text = (text or "").replace(MARK, " ").replace("\0", " ")
        for at in range(0, len(text), chunk):
            before = MARK * (order - 1) + text[max(0, at - order + 1) : at]
            body = text[at : at + chunk]
            places.append(place)
            parts.append(before[len(before) - order + 1 :] + body)
            held += len(body)
            if held >= chunk:
                yield places, parts
                places, parts, held = [], [], 0
    if parts:
        yield places, parts


def _windows(parts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code per n-gram of the parts in turn, the alphabet the codes are numbers over, and the n-grams of each part.

    With so many different characters that codes would not fit, the n-grams themselves stand for the codes
    and the alphabet is empty.
    """
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(points), bool)
    for back in range(1, order):
        inside[ends - back] = False
    starts = np.flatnonzero(inside)
    place = np.zeros(0x110000, np.int64)
    place[points] = 1
    alphabet = np.flatnonzero(place)
    if len(alphabet) ** order >= 1 << 62:
        spread = np.stack([points[starts + k] for k in range(order)], axis=1)
        return np.ascontiguousarray(spread).view(f"<U{order}").ravel(), np.zeros(0, np.int64), sizes - order + 1
    place[alphabet] = np.arange(len(alphabet))
    symbols = place[points]
    code = symbols[starts]
    for k in range(1, order):
        code = code * len(alphabet) + symbols[starts + k]
    return code, alphabet, sizes - order + 1


def _spelled(codes: np.ndarray, alphabet: np.ndarray, order: int) -> pa.Array:
    """The n-grams that codes stand for."""
    if len(alphabet):
        points = np.empty((len(codes), order), np.uint32)
        for k in reversed(range(order)):
            codes, symbol = np.divmod(codes, len(alphabet))
            points[:, k] = alphabet[symbol]
        codes = points.view(f"<U{order}").ravel()
    return pa.array(codes.tolist(), pa.string())


def block_grams(rows: DataFrame, block: str, text: str, target: str, order: int, chunk: int = CHUNK) -> DataFrame:
    """block, gram, n and t: how often each n-gram stands in a block's documents, and in those that are targets.

    A block that several tasks read has several rows of a gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                sums = pa.concat_tables(held).group_by("gram").aggregate([("n", "sum"), ("t", "sum")])
                out = pa.table({"block": pa.array(np.full(len(sums), at, np.int64)), "gram": sums["gram"], "n": sums["n_sum"], "t": sums["t_sum"]})
                yield from out.to_batches()
            held.clear()

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            wanted = batch.column(2).to_numpy(zero_copy_only=False)
            for b in np.unique(blocks):
                if b != at:
                    yield from flush()
                    at = b
                for kind in (False, True):
                    texts = batch.column(1).filter(pa.array((blocks == b) & (wanted == kind)))
                    for _, parts in _pieces((v.as_py() for v in texts), order, chunk):
                        code, alphabet, _ = _windows(parts, order)
                        codes, n = np.unique(code, return_counts=True)
                        held.append(pa.table({"gram": _spelled(codes, alphabet, order), "n": n, "t": n * kind}))
        yield from flush()

    return rows.select(block, text, target).mapInArrow(count, "block bigint, gram string, n bigint, t bigint")


def losses(counts: DataFrame, order: int) -> DataFrame:
    """gram, loss_t, loss_b: bits of each n-gram's last character given those before it, in both models.

    ``counts`` has one row per n-gram of all documents (gram, n, t).  Witten-Bell smoothing runs down through
    all shorter orders to the uniform model over the characters of all documents.  Every order is a table
    that grows with the corpus; each is joined to the next shorter one.
    """
    shorter = None
    for k in range(1, order + 1):
        gram = F.substring("gram", order - k + 1, k)
        own = counts.groupBy(gram.alias("g")).agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        context = own.groupBy(F.substring("g", 1, k - 1).alias("c")).agg(
            F.sum("n").alias("cn"), F.sum("t").alias("ct"), F.count_if(F.col("n") > 0).alias("kn"), F.count_if(F.col("t") > 0).alias("kt")
        )
        if shorter is None:
            rows = own.crossJoin(F.broadcast(context)).withColumn("sb", 1 / F.col("kn")).withColumn("st", 1 / F.col("kn"))  # one row
        else:
            rows = own.join(context, F.substring("g", 1, k - 1) == F.col("c")).join(shorter, F.substring("g", 2, k - 1) == F.col("s"))

        def smoothed(n: str, total: str, kinds: str, less: str) -> Column:
            return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(less)) / (F.col(total) + F.col(kinds))).otherwise(F.col(less))

        shorter = rows.select(F.col("g").alias("s"), smoothed("n", "cn", "kn", "sb").alias("sb"), smoothed("t", "ct", "kt", "st").alias("st"))
    return shorter.select(F.col("s").alias("gram"), (-F.log2("st")).alias("loss_t"), (-F.log2("sb")).alias("loss_b"))


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def cross_entropy_difference(
    docs: DataFrame,
    target_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 4,
    block_rows: int = BLOCK_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """Score every document by how much better the target model codes it than the background model.

    Adds n_tokens, loss_target, loss_background and loss_difference (bits a token, lower is closer to the
    target); columns of these names are replaced, all others kept whatever they are called.  Tokens are
    characters.  The background model is counted on all documents, the target model on those whose id is in
    ``target_ids`` (its first column; nulls and repeats there do not matter).  Both share one vocabulary, every
    code point of the corpus, and their order and smoothing.  Their n-grams are tables that grow with the
    corpus: documents are dealt into blocks of up to twice ``block_rows``, a block's distinct n-grams are joined to
    the tables, and the block's texts are scored with what comes back, so a task holds one block and its n-grams.

    Null and empty texts have no tokens and null losses; U+0000 and U+0002 count as spaces.  Null ids are never
    targets, repeated rows count and are scored each, an empty table gives an empty result.  Without target
    documents the target model is uniform over the vocabulary.
    """
    kept = without(docs, *SCORES)
    block, target, text = (_unused(docs, name) for name in ("__block", "__target", "__text"))
    wanted = target_ids.select(F.col(target_ids.columns[0]).alias(target)).dropna().distinct()
    carried = [docs[c] for c in kept.columns]
    if dict(kept.dtypes).get(text_col) == "string":
        text = text_col
    else:
        carried.append(docs[text_col].cast("string").alias(text))
    # one plan at every size: a few labels would be broadcast, many not, and the texts' shuffle come as a surprise
    flagged = docs.join(wanted.hint("merge"), docs[id_col] == wanted[target], "left").select(*carried, wanted[target].isNotNull().alias(target))
    # many thin partitions would each spell out their n-grams: written ones hold about a block of rows, more than two are cut
    flagged = flagged.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // block_rows)))
    # numbers of neighbouring rows of a written partition, fixed once they are stored
    rows = stage(flagged.withColumn(block, F.floor(F.monotonically_increasing_id() / (2 * block_rows))), "lm_rows")
    grams = stage(block_grams(rows, block, text, target, order, chunk), "lm_grams")
    table = losses(grams.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), order)
    answers = grams.select(F.col("block").alias(block), "gram").join(table, "gram")
    schema = T.StructType([*kept.schema, T.StructField(SCORES[0], T.LongType()), *[T.StructField(c, T.DoubleType()) for c in SCORES[1:]]])
    at = rows.columns.index(text)
    width = len(kept.columns)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right["gram"].combine_chunks()
        table = np.stack([right["loss_t"].to_numpy(), right["loss_b"].to_numpy()]) if len(right) else np.zeros((2, 0))
        n, bits = np.zeros(len(left), np.int64), np.zeros((2, len(left)))
        for places, parts in _pieces((v.as_py() for v in left.column(at)), order, chunk):
            code, alphabet, sizes = _windows(parts, order)
            codes, inverse = np.unique(code, return_inverse=True)
            found = table[:, pc.index_in(_spelled(codes, alphabet, order), value_set=known).to_numpy()]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            np.add.at(n, places, sizes)
            for model in (0, 1):
                np.add.at(bits[model], places, np.add.reduceat(found[model][inverse], starts))
        empty = n == 0
        bits /= np.maximum(n, 1)
        new = [pa.array(n), pa.array(bits[0], mask=empty), pa.array(bits[1], mask=empty), pa.array(bits[0] - bits[1], mask=empty)]
        return pa.Table.from_arrays([*left.columns[:width], *new], names=[*left.column_names[:width], *SCORES])

    return rows.groupBy(block).cogroup(answers.groupBy(block)).applyInArrow(rate, schema)
