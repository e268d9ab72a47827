"""Language identification by cross-parsing against suffix automata."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import without

SEGMENT = 512  # bytes parsed by one lane; a phrase ends at a segment's end in every language alike
UNKNOWN = "und"


def normalise(text: Column) -> Column:
    """Lower-case letters; each run of anything else becomes one space."""
    return F.trim(F.lower(F.regexp_replace(text, r"\P{L}+", " ")))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``data``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in data:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and byte not in moves[p]:
            moves[p][byte] = now
            p = link[p]
        if p >= 0:
            q = moves[p][byte]
            if length[q] != length[p] + 1:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(byte) == q:
                    moves[p][byte] = clone
                    p = link[p]
                link[q] = link[now] = clone
            else:
                link[now] = q
        last = now
    return moves


class CrossParser:
    """Counts, for many texts at once, the longest-match phrases that each language's text needs.

    The automata are tables [state, symbol] whose entry holds the row of the next state and, in its
    lowest bit, whether the match had to end there and a new phrase begins with that symbol.
    """

    def __init__(self, references: dict[str, bytes]):
        self.languages = sorted(references)
        symbols = sorted(set(b"".join(references.values())))
        self.symbol = np.zeros(256, np.int32)  # 0: a byte in no reference
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        width = len(symbols) + 1
        self.bits = np.array([np.log2(len(references[x]) + 2) for x in self.languages])
        self.tables = [self._table(references[x], width) for x in self.languages]

    def _table(self, data: bytes, width: int) -> np.ndarray:
        moves = suffix_automaton(data)
        root = np.ones(width, np.int32)
        for byte, to in moves[0].items():
            root[self.symbol[byte]] = to * width * 2 + 1
        table = np.tile(root, (len(moves), 1))
        state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        pairs = np.array([x for m in moves for x in m.items()], np.int64).reshape(-1, 2)
        inner = state > 0  # the root is only met again after an unknown symbol, when any symbol opens a phrase
        table[state[inner], self.symbol[pairs[inner, 0]]] = pairs[inner, 1] * width * 2
        return table.ravel()

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per text (rows) and language; text i is data[offsets[i]:offsets[i + 1]]."""
        size = np.diff(offsets)
        lanes = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), lanes)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[owner] + part * SEGMENT
        length = np.minimum(SEGMENT, offsets[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # lanes longer than each step
        rows = [np.zeros(len(start), np.int32) for _ in self.tables]
        counts = [np.ones(len(start), np.int32) for _ in self.tables]
        symbols = self.symbol[data]
        for step in range(int(length[0]) if len(length) else 0):
            n = active[step]
            at = symbols[start[:n] + step]
            for table, row, count in zip(self.tables, rows, counts, strict=True):
                value = table.take(row[:n] + at)
                if step:  # the first symbol always opens the phrase that is counted already
                    count[:n] += value & 1
                np.right_shift(value, 1, out=row[:n])
        return np.stack([np.bincount(owner, c, len(size)) for c in counts], axis=1) if rows else np.zeros((len(size), 0))

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language with the fewest normalised phrases (ties: first by name) and how clearly it won, 0 to 1."""
        size = np.diff(offsets)
        if not self.languages:
            return [UNKNOWN] * len(size), np.zeros(len(size))
        cost = self.phrases(data, offsets) * self.bits
        best = cost.argmin(axis=1)
        rest = cost.copy()
        rest[np.arange(len(size)), best] = np.inf
        second = rest.min(axis=1) if len(self.languages) > 1 else np.full(len(size), np.inf)
        won = cost[np.arange(len(size)), best]
        sure = np.where(size > 0, 1 - won / np.maximum(second, 1e-9), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)], np.clip(sure, 0, 1)


_PARSERS: dict[int, CrossParser] = {}


def _parser(references: dict[str, bytes]) -> CrossParser:
    """One parser per Python worker and model."""
    key = hash(tuple(sorted(references.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(references)
    return _PARSERS[key]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 200, reference_bytes: int = 24_000) -> dict[str, bytes]:
    """Reference text per label, from a bounded sample.

    Per label the ``sample_docs`` documents with the least hash of their id are taken and cut to
    ``reference_bytes`` in all; every label gets the same length where its texts allow.  Only ids and
    labels are ranked; texts are read for the chosen rows.  Rows without id, text, letters or label are
    not used.  What reaches the driver is bounded by labels x (sample_docs x chunk) bytes.
    """
    known = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang")).dropna()
    order = Window.partitionBy("__lang").orderBy(F.xxhash64("__id"), "__id")
    chosen = known.distinct().withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample_docs).select("__id", "__lang", "__n")
    chunk = max(64, 4 * reference_bytes // sample_docs)
    texts = (
        docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__t"))
        .join(F.broadcast(chosen), ["__id", "__lang"])  # at most labels x sample_docs rows
        .groupBy("__lang", "__n")
        .agg(F.min("__t").alias("__t"))
        .select("__lang", "__n", F.substring(normalise(F.col("__t")), 1, chunk).alias("__t"))
    )
    parts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(texts.collect()):
        if text:
            parts.setdefault(lang, []).append(text.encode())
    return {lang: b" ".join(p)[:reference_bytes] for lang, p in parts.items()}


def predict(docs: DataFrame, references: dict[str, bytes], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its score (0 to 1) to every row, from the whole text alone.

    The score is one minus the winner's normalised phrases over the runner-up's; a single learned
    label scores 1.  Null texts and texts without a letter get ``und`` and 0; without references all do.
    Existing columns of the two names are replaced.  Ties go to the first label by name.
    """

    @F.arrow_udf("struct<l:string,s:double>")
    def decide(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(references)
        for text in parts:
            words = text.cast(pa.large_binary())
            names: list[str] = []
            scores: list[np.ndarray] = []
            for at in range(0, len(words), 2000):
                piece = words[at : at + 2000].to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(x or b"") for x in piece])]).astype(np.int64)
                found, sure = parser.decide(np.frombuffer(b"".join(x or b"" for x in piece), np.uint8), offsets)
                names += found
                scores.append(sure)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], ["l", "s"])

    out = without(docs, lang_out, score_out).withColumn("__found", decide(F.coalesce(normalise(F.col(text_col)), F.lit(""))))
    return out.select("*", F.col("__found.l").alias(lang_out), F.col("__found.s").alias(score_out)).drop("__found")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept out of learning: crc32 of the id's text leaves 2 modulo 4 (null ids: false, and not learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, references: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows whose language could be told, columns unchanged."""
    kept = predict(docs, references, text_col, "__lang", "__score").filter(F.col("__lang") != UNKNOWN)
    return kept.select(*docs.columns)
