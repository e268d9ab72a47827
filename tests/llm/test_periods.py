"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from priorline.llm import periods, queries


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, period by period; multiples of a run's period have its ends."""
    ends = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                ends.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in ends.items())


def collapsed(words: list, runs) -> list:
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def a_text(rnd: random.Random) -> list[str]:
    """Random words with periodic stretches of all kinds, touching and nested."""
    out = []
    for _ in range(rnd.randint(0, 6)):
        out += [rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 1, 5, 40]))]
        root = [rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70]))]
        out += (root * 12)[: rnd.choice([20, 24, 25, 3 * len(root) - 1, 3 * len(root), 3 * len(root) + 1, 5 * len(root) + 2, 7 * len(root)])]
    return out


def test_runs_against_brute_force(spark):
    rnd = random.Random(5)
    texts = {i: a_text(rnd) for i in range(300)}
    nested = ["a", "a", "b"] * 9
    texts |= {1000: ["x"] * 23, 1001: ["x"] * 24, 1002: nested + ["c"] + nested + ["c"] + nested + ["c"], 1003: ["x"] * 5000, 1004: [f"w{i % 1500}" for i in range(4700)]}
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(t)) for i, t in texts.items()]
    got = periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    seen = 0
    for r in got:
        want = plain_runs(texts[r.doc_id])
        seen += len(want)
        assert [tuple(x) for x in r.runs] == want, r.doc_id
        assert r.n_words == len(texts[r.doc_id]) and r.collapsed == " ".join(collapsed(texts[r.doc_id], want))
    assert seen > 200


def test_tiles_do_not_depend_on_neighbours():
    """Block hashes across texts of one batch never count."""
    data = np.frombuffer(b"a b c d e f g h " * 3 + b"a b c d e f g h " * 2, np.uint8)
    whole = [x for x in periods.repeating_blocks(*periods.word_hashes(data, np.array([0, 48, 80])))]
    alone = [x for x in periods.repeating_blocks(*periods.word_hashes(data[:48], np.array([0, 48])))]
    assert [(k, t.tolist(), i.tolist()) for k, t, i in whole] == [(k, t.tolist(), i.tolist()) for k, t, i in alone]


def test_words_end_at_white_space_only():
    text = "é b c\x0bd e\x1cf".encode()
    codes, bounds = periods.word_hashes(np.frombuffer(text + b"c", np.uint8), np.array([0, len(text), len(text) + 1]))
    assert bounds.tolist() == [0, 3, 4] and codes[1] == codes[3] and len(set(codes.tolist())) == 3


@pytest.mark.parametrize("rows", [[], [(None, None, 1, 2), (None, "", 1, 2), (7, "a " * 30, 1, 2), (7, "a " * 30, 1, 2), (8, " \n\t", 1, 2)]])
def test_odd_rows(spark, rows):
    """Null and empty texts, ids that are null or repeated, columns with the operator's own names, no rows at all."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, octaves int")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()))
    assert got == ([(0, 0, [], ""), (0, 0, [], ""), (7, 30, [(0, 30, 1)], "a"), (7, 30, [(0, 30, 1)], "a"), (8, 0, [], "")] if rows else [])


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    texts = {i: " ".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(rnd.choice([0, 3, 30, 200, 600]))) for i in range(150)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(texts)
    for i, text in texts.items():
        words = text.split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        milli = 1000 * top[1] // top[2] if runs else None
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *top, milli)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
