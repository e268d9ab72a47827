"""Spelling variants against brute force, and what the grouping does with odd rows."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from priorline.llm import queries, spelling

WORDS = "word string, n long"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_groups(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [(-counts[x], x) for x in counts if one_edit(w, x)] for w in counts}
    form = {w: min(o)[1] if o and -min(o)[0] >= 10 * counts[w] else None for w, o in near.items()}
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def grouped(frame) -> dict[str, tuple]:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(frame).collect()}


@pytest.mark.parametrize("crowd", [4, 64])
def test_groups_against_brute_force(spark, monkeypatch, crowd):
    """A small CROWD cuts nearly every chunk again, down to one open code point."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rnd = random.Random(crowd)
    counts = {"".join(rnd.choice("abé") for _ in range(rnd.randint(0, 7))): rnd.choice([1, 2, 50, 600, 7000]) for _ in range(900)}
    assert grouped(spark.createDataFrame(list(counts.items()), WORDS)) == plain_groups(counts)


def test_odd_words(spark):
    """Counts of repeated rows add up; nulls go; ties take the smaller word; long words keep their edit anywhere."""
    long = "ab" * 3000
    rows = [("lantern", 30), ("lantern", 70), ("lanternx", 10), (None, 5), ("nullcount", None), ("lanterm", 10), ("xlanternx", 1), (long, 40), (long[:2000] + long[2001:], 2), (long + "c", 4)]
    rows += [("tiewordaa", 50), ("tiewordab", 50), ("tiewordac", 5)]
    got = grouped(spark.createDataFrame(rows, WORDS))
    assert got["lantern"] == (None, "lantern", 100, 2, None)
    assert got["xlanternx"] == ("lanternx", "lantern", 1, 1, 10)
    assert got["lanterm"] == ("lantern", "lantern", 10, 1, 100)
    assert got["tiewordac"] == ("tiewordaa", "tiewordaa", 5, 2, 50)
    assert got[long + "c"] == (long, long, 4, 1, 40)
    assert set(got) == {w for w, n in rows if w and n}
    assert grouped(spark.createDataFrame([], WORDS)) == {}


def test_words_of_texts_with_errors_put_in(spark, tmp_path):
    """The query's words and counts, worked out again in Python."""
    texts = [(i, t) for i, t in enumerate(["Straßenbahn straßenbahn, naïveté NAÏVETÉ abcdefgh", None, "", "zzzzzzzz " * 300, "word1wordword×wordword"] + ["Lanterns lantern"] * 40)]
    spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, word string, n string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    letters = set(range(0xC0, 0x100)) | set(range(65, 91)) | set(range(97, 123))
    for i, t in texts:
        for run in "".join(c if ord(c) in letters else " " for c in t or "").split():
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            cut = h % len(run)
            want[run[:cut] + run[cut + 1 :] if h % 31 == 0 else run] += 1
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_runs_keep_repeats_and_case_of_wide_letters(spark):
    docs = spark.createDataFrame([(1, "ÀBC abc ABC ab"), (None, "abc")], "doc_id long, text string")
    got = spelling.runs(docs, queries.LETTERS, 3).orderBy(F.col("id").asc_nulls_first()).collect()
    assert sorted((r.id, r.run) for r in got if r.id) == [(1, "abc"), (1, "abc"), (1, "Àbc")] and got[0].run == "abc"
