"""SimHash, near copies, embeddings and passages against brute force, edge cases included."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from priorline.llm import graph, simhash, substrings, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


def components(ids, linked):
    """Least id reachable, by plain search."""
    out, todo = {}, sorted(ids)
    for i in todo:
        if i in out:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in out:
                out[j] = i
                stack += [k for k in ids if k not in out and linked(j, k)]
    return out


def fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = 0
    for b in range(64):
        if sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) * 2 > len(runs):
            bits |= 1 << b
    return bits


def test_components_of_a_long_chain_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert graph.components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_simhash_matches_spark_hash_and_brute_force(spark, monkeypatch):
    base = words(1, 400)
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1] + ["x"]), None, "", "  \t\n", "One", "one", "ÀB cd", "àb cd", "a b", "A  B", "a b c"]
    for i in range(40):  # many near copies, so that large buckets occur
        w = list(base)
        w[i * 9] = f"edit{i}"
        texts.append(" ".join(w))
    docs = frame(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    want = [fingerprint(t) for t in texts]
    ids = list(range(len(texts)))
    expected = components(ids, lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    for large in (16, 2):
        monkeypatch.setattr(simhash, "LARGE", large)
        got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
        assert {r.doc_id: r.f for r in got} == {i: f"{w:016x}" for i, w in zip(ids, want, strict=True)}
        assert {r.doc_id: r.component_id for r in got} == expected
    row = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row & (2**64 - 1) == simhash.shingle_hashes(b"One two  three", 3)[0]


def test_simhash_with_repeated_and_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "same words here"), (7, "same words here"), (7, "same words here"), (None, "quite another text")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [("7", 7), ("7", 7), ("None", 7), ("None", None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def jaccard(a: str, b: str) -> float:
    def runs(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y)


def test_near_copies_keep_one_of_each_group(spark):
    texts = []
    for g in range(12):
        base = words(100 + g, 250)
        texts.append(" ".join(base))
        for e in range(4):
            w = list(base)
            for k in range(e + 1):
                w[20 + 50 * k] = f"new{e}{k}"
            texts.append(" ".join(w))
    texts += [None, None, "", "short", "short", "other short text"]
    docs = frame(spark, texts).withColumn("node", F.lit(1))
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    some = [i for i, t in enumerate(texts) if t]
    groups = components(some, lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert kept - {60, 62} == {i for i in some if groups[i] == i}
    assert {60, 62} <= kept and simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_copies_that_repeat_other_lines_are_found(spark):
    """Equal shingle sets are one text to the similarity, however often a line is repeated."""
    texts = [" ".join(words(100 + i, 304)) for i in range(12)]
    more = [t + (" " + " ".join(t.split()[:24])) * 10 for t in texts]
    again = [" ".join(t.split()[:24]) + " " + t for t in more]
    kept = simhash.drop_near_copies(frame(spark, more + again)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(12))


def test_near_copies_hold_the_links_of_the_distance_tables(spark):
    """Fingerprints within two bits are links here too, whatever the shingle sets, and join groups with the other kind."""
    line = " ".join(words(1, 25))
    texts = [" ".join([line] * 60 + words(50 + i, 12)) for i in range(3)]
    prints = [fingerprint(t) for t in texts]
    groups = components(range(3), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert set(groups.values()) == {0} and max(jaccard(texts[0], t) for t in texts[1:]) < 0.8
    near = " ".join([*texts[2].split()[:-1], "new"])  # alike to the last one only by its shingles or its fingerprint
    docs = frame(spark, [*texts, near, " ".join(words(7, 200))])
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {0, 4}


def test_components_are_joined_once_per_text(spark, monkeypatch):
    base, made = words(31, 300), []
    docs = frame(spark, [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 300, 10)] + [" ".join(words(32 + i, 300)) for i in range(10)])
    join = type(docs).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and (on, how) == ("node", "left"):
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "join", counted)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [0, *range(30, 40)]
    assert made and max(made) <= 40


def test_near_copies_of_repeated_rows_and_null_ids(spark):
    text, other = " ".join(words(1, 60)), " ".join(words(2, 60))
    rows = [(None, text), (7, text), (7, text), (9, text), (None, other), (None, other), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.drop_near_copies(docs).collect()), key=str)
    assert got == sorted([(7, text), (None, other), (3, None)], key=str)


def test_near_copies_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    groups = components(sorted(rows), lambda a, b: rows[a] == rows[b] or jaccard(rows[a] or "", rows[b] or "") >= 0.8)
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert kept == {i for i in rows if groups[i] == i}


@pytest.mark.parametrize("dense", [False, True])
def test_vectors_against_brute_force(spark, dense):
    r = np.random.default_rng(3)
    rows, centre = [], r.normal(size=32)
    for i in range(600):
        v = centre + r.normal(size=32) * 0.1 if dense and i % 3 else r.normal(size=32)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(600 + i, rows[0][1], 0) for i in range(5)]
    rows += [(700, None, 0), (701, [0.0] * 32, 0), (702, [float("nan")] * 32, 0), (703, rows[0][1], None), (704, [float("inf")] + [1.0] * 31, 0), (705, [None] + [1.0] * 31, 0), (706, [], 0)]
    rows += [(707, (np.array(rows[0][1]) * 2).tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("k", F.lit(1)).withColumn("n_links", F.lit("x"))
    good = [x for x in rows if x[1] and x[2] is not None and all(v is not None and np.isfinite(v) for v in x[1]) and any(x[1])]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in good}
    label = {i: c for i, _, c in good}
    linked = lambda a, b: label[a] == label[b] and unit[a] @ unit[b] >= 0.98
    groups = components(sorted(unit), linked)
    got = {x.vec_id: x for x in vectors.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    want = {i: sum(linked(i, j) for j in unit if j != i) for i in unit}
    assert all(got[i].n_links <= want.get(i, 0) for i in got)
    assert sum(g.n_links for g in got.values()) >= 0.99 * sum(want.values())
    assert {i: got[i].component_id for i in got} == {i: groups.get(i, i) for i in got}
    assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())


def test_vectors_without_rows(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def cut(texts, window):
    parts = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in parts for i in range(len(w) - window + 1))
    out = []
    for w in parts:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_passages_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substrings, "HOT_CONTEXTS", 3)
    passage, loop = words(5, 60), words(6, 10)
    texts = [" ".join(words(i, 80) + passage[: 30 + i] + words(50 + i, 40)) for i in range(30)]
    texts += [" ".join(passage), " ".join(passage), None, "", " ".join(loop * 30), " ".join(words(9, 34)), " ".join(words(9, 35)), " ".join(words(10, 35)), " ".join(words(10, 35)), "a b\x0bc " * 30]
    texts += [" ".join(["same"] * 200), " ".join(words(11, 3000) + passage + words(12, 100))]
    docs = frame(spark, texts).withColumn("h", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_passages(docs).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts, 35)


def test_passages_without_rows_and_with_repeated_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert substrings.repeated_passages(empty).count() == 0
    text = " ".join(words(1, 50))
    rows = substrings.repeated_passages(spark.createDataFrame([(1, text), (1, text), (None, "few words")], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(2, 0), (50, 50), (50, 50)]
