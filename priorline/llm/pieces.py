"""SentencePiece models run by the tokenizers library."""

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import without

SPACE = "▁"
KEPT = 150_000  # chunks a worker remembers
GROUP = 64
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# fixed values of the public model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """What a model file says that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif wire == 1:
            value, at = struct.unpack("<d", data[at : at + 8])[0], at + 8
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield number, value


def parse(data: bytes) -> Model:
    """Read the model's protobuf: pieces (1), trainer (2) and normaliser (3) settings."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.suffix = bool(trainer.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if model.suffix or not model.escape:
        raise ValueError("white space must be escaped and lead its word")
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that make a piece, best piece first; a merge of equal score keeps the order of the vocabulary."""
    known = {p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = sorted((i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL and len(p) > 1), key=lambda i: (-pieces[i][1], i))
    return [(p[:cut], p[cut:]) for p in (pieces[i][0] for i in ranked) for cut in range(1, len(p)) if p[:cut] in known and p[cut:] in known]


def build(model: Model):
    """A tokenizer of the tokenizers library with the model's normaliser, pieces and fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    names, scores = [], []
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    for i, (piece, score, kind) in enumerate(model.pieces):
        # control pieces are never found in a text: their entries get a name no text can have
        names.append(piece if kind in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else f"\0{i}\0{piece}")
        scores.append(score)
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(names, scores, strict=True)), unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, p in enumerate(names)}, _merges(model.pieces), unk_token=names[unknown], byte_fallback=model.byte_fallback, fuse_unk=True)
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    out.normalizer = normalizers.Sequence(steps)
    # No piece has a marker after another character, so none crosses the start of a run of markers.
    if not any(SPACE in p.lstrip(SPACE) for p, _, _ in model.pieces):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), behavior="isolated")
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
    return out


class _Codes(dict):
    """Numbers chunks in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        return code


class Pieces:
    """Encoder and decoder of one model.

    No piece holds a marker after another character, so a normalised text falls into chunks (a run of
    markers and what follows) that are encoded independently.  The library gets the chunks of a batch
    that are new to this worker, in one multithreaded call; the texts' ids are put together from the chunks'.
    """

    def __init__(self, data: bytes):
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.normalizer = self.tokenizer.normalizer
        self.whole = self.tokenizer.pre_tokenizer is None  # a model whose texts do not fall into chunks
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = None
        # what a piece spells by itself: its characters, or the one character of an ASCII byte
        spelled = [chr(int(p[1:-1], 16)) if kind == BYTE and int(p[1:-1], 16) < 128 else p if kind in (NORMAL, USER_DEFINED) else "" for p, _, kind in self.model.pieces]
        self.names, self.length = spelled, np.array([len(p) for p in spelled], np.int64)
        self.forget()
        self.simple = self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap and not self.whole

    def _chunks(self, text: str) -> str:
        """The text's chunks, separated by blanks (which no normalised text has)."""
        if not text:
            return ""
        if self.simple and SPACE not in text and "  " not in text and text[0] != " ":
            return SPACE + text.replace(" ", " " + SPACE)
        text = self.normalizer.normalize_str(text)
        return text if self.whole else " ".join(CHUNK.findall(text))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ids per text, and whether each text's ids decode to it as normalised."""
        if len(self.codes) > KEPT:
            self.forget()
        known = len(self.codes)
        parts = [self._chunks(t).split(" ") for t in texts]  # each text has at least one chunk, perhaps an empty one
        counts = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(parts)), np.int32, int(counts.sum()))
        self._learn(list(islice(self.codes, known, None)))
        size = self.sizes[at]
        ends = np.cumsum(size)
        first = (np.cumsum(self.sizes) - self.sizes)[at]
        out = self.flat[np.repeat(first - (ends - size), size) + np.arange(int(size.sum()))]
        rows = np.concatenate([[0], np.cumsum(counts)])
        same = np.logical_and.reduceat(self.same[at], rows[:-1]) if texts else np.zeros(0, bool)
        return out, np.diff(np.concatenate([[0], ends])[rows]), same

    def forget(self) -> None:
        """Start again without known chunks, so that what a worker keeps is bounded."""
        self.codes = _Codes()
        self.flat, self.sizes, self.same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks not met before and check that their ids decode to them.

        The library takes groups of chunks as words of one input.  Where each piece spells characters
        of its own, their lengths tell where each chunk ends; groups with longer byte runs go chunk by chunk.
        """
        groups = [chunks[i : i + GROUP] for i in range(0, len(chunks), GROUP)]
        coded = [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)]
        flat, sizes, same = [self.flat], [self.sizes], [self.same]
        for group, ids in zip(groups, coded, strict=True):
            length = np.cumsum(self.length[ids])
            ends = np.cumsum([len(c) for c in group])
            cut = np.searchsorted(length, ends, side="left") + 1
            if self.length[ids].all() and "".join(map(self.names.__getitem__, ids.tolist())) == "".join(group) and (length[cut[ends > 0] - 1] == ends[ends > 0]).all():
                cut[ends == 0] = 0
                sizes.append(np.diff(cut, prepend=0))
                same.append(np.ones(len(group), bool))
            else:
                single = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                back = self.tokenizer.decode_batch(single, skip_special_tokens=False)
                ids = np.fromiter(chain.from_iterable(single), np.int64)
                sizes.append(np.array([len(x) for x in single], np.int64))
                same.append(np.array([a == b.replace(SPACE, " ") for a, b in zip(back, group, strict=True)], bool))
            flat.append(ids.astype(np.int32))
        self.flat, self.sizes, self.same = np.concatenate(flat), np.concatenate(sizes), np.concatenate(same)

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in texts]


_LOADED: dict[bytes, Pieces] = {}


def _pieces(data: bytes, threads: int) -> Pieces:
    """One tokenizer per Python worker; the library's threads are set before it first runs."""
    if data not in _LOADED:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        _LOADED.clear()
        _LOADED[data] = Pieces(data)
    return _LOADED[data]


BATCH = 2 << 20  # characters encoded at a time


def _batches(texts: pa.Array) -> Iterator[list[str]]:
    batch, held = [], 0
    for value in texts:
        batch.append(value.as_py() or "")
        held += len(batch[-1])
        if held >= BATCH:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def encode(docs: DataFrame, model: bytes, text_col: str = "text", threads: int = 2, ids_out: str = "token_ids", exact_out: str = "round_trip") -> DataFrame:
    """Add the token ids of each whole text and whether decoding them gives the normalised text back.

    ``model`` is the content of a SentencePiece model file (bounded: it holds a vocabulary).  A null text
    has null ids and a null ``round_trip``; an empty one has no ids and round-trips.  Columns of the two
    names are replaced.  No text is cut; long ones are batches of their own.
    """

    @F.arrow_udf("struct<i:array<int>,r:boolean>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(model, threads)
        for part in parts:
            ids, sizes, same = zip(*[pieces.encode(batch) for batch in _batches(part)] or [pieces.encode([])], strict=True)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            nulls = part.is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(nulls, False)), pa.array(np.concatenate(ids)))
            yield pa.StructArray.from_arrays([lists, pa.array(np.concatenate(same), pa.bool_(), mask=nulls)], ["i", "r"])

    out = without(docs, ids_out, exact_out).withColumn("__e", run(F.col(text_col).cast("string")))
    return out.select("*", F.col("__e.i").alias(ids_out), F.col("__e.r").alias(exact_out)).drop("__e")


def decode(coded: DataFrame, model: bytes, ids_col: str = "token_ids", text_out: str = "text", threads: int = 2) -> DataFrame:
    """Add the text of each row's token ids (null for null ids); a column of that name is replaced."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(model, threads)
        for part in parts:
            rows = [x.as_py() for x in part]
            texts = iter(pieces.decode([x for x in rows if x is not None]))
            yield pa.array([None if x is None else next(texts) for x in rows], pa.string())

    ids = coded[ids_col]
    return coded.withColumn(text_out, run(ids))


def read_model(path: str) -> bytes:
    """The model file's bytes, read by the driver once and sent along with the tasks."""
    with open(path, "rb") as file:
        return file.read()
