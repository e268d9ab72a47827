"""Language, personal data, scoring, mixing, tokens, URL lists, sketches and the pipeline."""

import hashlib
import math
import re
from collections import Counter
from datetime import datetime

import corpus_pipeline
import numpy as np
import oracle
import pytest
import sentencepiece
from pyspark.sql import functions as F

from priorline.llm import langid, lm, mixing, pieces, pii, queries, sketches, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        verdict = oracle.compare(spark, oracle.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
        assert verdict.startswith("OK"), verdict
    else:
        assert queries.QUERIES[name](spark, SF).count() == 200


# --- language --------------------------------------------------------------------------------------


def greedy_phrases(text: bytes, reference: bytes) -> int:
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        count, at = count + 1, at + size
    return count


def test_cross_parsing_counts_longest_matches():
    references = {"x": b"abracadabra banana", "y": b"the quick brown fox"}
    parser = langid.CrossParser(references)
    texts = [b"abra", b"banana cadabra", b"zzz", b"the fox quick", b"", b"abracadabra" * 3]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = parser.phrases(data, offsets)
    for i, t in enumerate(texts):
        for j, lang in enumerate(parser.languages):
            assert got[i, j] == greedy_phrases(t, references[lang]), (t, lang)


def test_language_on_held_out_documents_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    references = langid.learn(docs.filter(~langid.held_out()))
    found = langid.predict(docs.filter(langid.held_out()), references).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98 and all(0 <= r.score <= 1 for r in found)
    long = "The and attion to thanedble the anea " * 4000
    edge = table(spark, [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 ## !", "en", "s", 7), (None, "the and of", None, None, None), (4, long, "en", "s", 1), (4, long, "en", "s", 1)])
    edge = edge.withColumn("lang_pred", F.lit(5)).withColumn("l", F.lit(1))
    got = langid.predict(edge, references)
    rows = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert Counter(rows) == Counter([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en"), (4, "en")]) and "l" in got.columns
    assert langid.learn(edge.limit(0)) == {} and {r.lang_pred for r in langid.predict(edge, {}).collect()} == {"und"}
    assert {r.doc_id for r in langid.keep_known(edge, references).collect()} == {None, 4}


# --- personal data ---------------------------------------------------------------------------------


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash"))
    rows = {r.doc_id: r for r in pii.replace(docs, key=key).collect()}
    return [rows[i].text for i in range(len(texts))], [rows[i].n_entities for i in range(len(texts))]


def test_surrogates_keep_form_and_coreference(spark):
    texts = [
        "Write to Bob.34@mail7.example.com or bob.34@mail7.example.com from 97.51.17.173.",
        "Call +1 (017) 555-7713, SSN 123-45-6789, card 4539 1488 0343 6467 or 4539148803436467 or 9807915762804490.",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### and DE89 3704 0044 0532 0130 00',
        "Mrs. Anna Schmidt met Mr. Schmidt; Господин Иван Петров too",
        None,
        "",
        "No data: 473696257, 3.14, 2024-01-15, 1.2.3.4.5, a@b and Version 2.0",
        "bob.34@mail7.example.com " * 2000,
    ]
    got, counts = replaced(spark, texts)
    assert counts[:4] == [3, 5, 2, 3] and got[4:7] == texts[4:7] and counts[4:7] == [0, 0, 0] and counts[7] == 2000
    first, second = re.findall(r"\S+@\S+", got[0])[:2]
    assert first.lower() == second and first[0].isupper() and second.endswith(".com") and "example.com" not in got[0]
    assert set(got[7].split()) == {second}
    assert re.search(r"from (\d{1,3}\.){3}\d{1,3}\.$", got[0]) and "97.51.17.173" not in got[0]
    assert re.match(r"Call \+1 \(\d{3}\) \d{3}-\d{4}, SSN \d{3}-\d{2}-\d{4}, card \d{4} \d{4} \d{4} \d{4} or \d{16} or \d{16}\.$", got[1])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[1])
    assert cards[0].replace(" ", "") == cards[1] != cards[2]
    luhn = lambda n: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10
    assert luhn("4539148803436467") == luhn(cards[1]) == 0
    assert re.match(r'token = "[0-9a-f]{40}"### and DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2}$', got[2]) and "24be64" not in got[2]
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+); Господин ([А-я]+) ([А-я]+) too", got[3])
    assert names[2] == names[3] and names[1].endswith(("na", "lia")) and names[4].endswith(("рон", "мир")) and "Schmidt" not in got[3]
    assert replaced(spark, texts)[0] == got and replaced(spark, texts, "other")[0][0] != got[0]


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Addresses have few surrogates here, so first draws collide and are drawn again."""
    texts = [f"from 10.0.{i // 200}.{i % 200 + 1} x" for i in range(600)]
    original = pii._stream
    # 24 bits of the stream decide, two of them are fixed: many collisions
    monkeypatch.setattr(pii, "_stream", lambda key, kind, canon, attempt: F.concat(F.lit("000000000000"), F.substring(original(key, kind, canon, attempt), 1, 3), F.lit("0" * 120)))
    moved = pii.attempts(spark.createDataFrame([(t,) for t in texts[:25]], "text string"), "text", "k")
    assert moved.count() > 0
    for small in (1000, 0):
        monkeypatch.setattr(pii, "SMALL", small)
        got, _ = replaced(spark, texts[:25])
        assert len(set(got)) == 25 and not set(got) & set(texts)


def test_no_planted_entity_is_left_and_clean_texts_are_unchanged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.join(pii.replace(docs, key="k").withColumnRenamed("text", "new"), "doc_id").collect()
    private = re.compile(r"[\w.]+@mail\d+\.example\.com|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-f]{40}\b")
    for r in rows:
        before = set(private.findall(r.text))
        assert not any(p in r.new for p in before), r.doc_id
        assert before or r.n_entities or r.new == r.text
    assert pii.replace(docs.limit(0), key="k").count() == 0


# --- scoring ---------------------------------------------------------------------------------------


def plain_losses(texts, size, order):
    own, seen, kinds = Counter(), Counter(), Counter()
    for t in texts:
        s = "\x02" * (order - 1) + t
        for i in range(len(t)):
            for k in range(order):
                gram = s[i + k : i + order]
                kinds[gram[:-1]] += gram not in own
                own[gram] += 1
                seen[gram[:-1]] += 1

    def p(gram):
        if not gram:
            return 1 / size
        c = gram[:-1]
        w = kinds[c] / (seen[c] + kinds[c]) if seen[c] else 1
        return (own[gram] / seen[c] if seen[c] else 0) * (1 - w) + w * p(gram[1:])

    def loss(t):
        s = "\x02" * (order - 1) + t
        return sum(-math.log2(p(s[i : i + order])) for i in range(len(t))) / len(t)

    return loss


def check_scores(docs, ids, targets, order, **options):
    scored = lm.cross_entropy_difference(docs, ids, order=order, **options).collect()
    texts = [r.text.replace("\x02", " ").replace("\0", " ") for r in docs.collect() if r.text]
    size = len(set("".join(texts)))
    good = [r.text.replace("\x02", " ").replace("\0", " ") for r in docs.collect() if r.text and r.doc_id in targets]
    target, background = plain_losses(good, size, order), plain_losses(texts, size, order)
    for r in scored:
        if not r.text:
            assert (r.n_tokens, r.loss_target, r.loss_background, r.loss_difference) == (0, None, None, None)
            continue
        t = r.text.replace("\x02", " ").replace("\0", " ")
        assert r.n_tokens == len(t)
        assert r.loss_target == pytest.approx(target(t)) and r.loss_background == pytest.approx(background(t))
        assert r.loss_difference == pytest.approx(r.loss_target - r.loss_background, abs=1e-9)
    return scored


@pytest.mark.parametrize("order", [1, 2, 4])
def test_cross_entropy_difference_against_plain_models(spark, order):
    texts = ["abab ab", "ba ab abba", "zzz ab!", "", None, "abé", "a", "a\x02b\0", "\U0001f600 ab", "abab ab"]
    rows = [*enumerate(texts), (None, "no id"), (None, "no id"), (3, "ab again"), (3, "ab again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("__block", F.lit("kept"))
    docs = docs.withColumn("gram", F.lit(7)).withColumn("__target", F.lit(1.5))
    ids = spark.createDataFrame([(0,), (1,), (1,), (9,), (None,)], "doc_id long")
    scored = check_scores(docs, ids, {0, 1, 9}, order, block_rows=2, chunk=3)
    assert len(scored) == len(rows) and {(r["__block"], r.gram, r["__target"]) for r in scored} == {("kept", 7, 1.5)}
    assert lm.cross_entropy_difference(docs.limit(0), ids).count() == 0


def test_scores_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    assert len(check_scores(docs, good, {r.doc_id for r in good.collect()}, 4)) == docs.count()


def test_every_script_is_learned(spark):
    latin = [(i, "the same words in every text") for i in range(300)]
    other = [(1000 + i, "много разных слов" if i % 2 else "другие буквы здесь") for i in range(10)]
    docs = spark.createDataFrame(latin + other, "doc_id long, text string")
    ids = spark.createDataFrame([(1001,)], "doc_id long")
    found = {r.text: r.loss_difference for r in lm.cross_entropy_difference(docs, ids).collect()}
    assert found["много разных слов"] < found["другие буквы здесь"] < found["the same words in every text"]


def test_scores_of_long_texts_and_of_many_characters(spark):
    every = "".join(chr(c) for c in range(0x100, 0xD800)) + "".join(chr(c) for c in range(0x10000, 0x11000))
    docs = spark.createDataFrame([(1, "ab" * 100_000 + "c"), (2, every), (3, "ab")], "doc_id long, text string")
    check_scores(docs, spark.createDataFrame([(1,)], "doc_id long"), {1}, 4, chunk=65_536)


def test_targets_missing_or_unmatched(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "ba")], "doc_id long, text string")
    check_scores(docs, spark.createDataFrame([(7,)], "doc_id long"), set(), 3)


# --- mixing ----------------------------------------------------------------------------------------


def test_periods_meet_deadlines_and_stay_within_a_block():
    for weights in ({"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1, None: 0.2}, {str(i): i + 1 for i in range(30)}):
        slots = mixing.shares(weights, 1000)
        assert sum(slots.values()) == 1000
        plan = mixing.pfair_period(slots)
        assert all(release <= slot < deadline for _, _, slot, release, deadline in plan)
        done = Counter()
        for source, _, slot, _, _ in plan:
            done[source] += 1
            assert all(abs(done[s] - (slot + 1) * k / 1000) < 1 for s, k in slots.items())


def test_schedule_covers_all_rows_and_mix_holds_weights(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else ["x", "y", None][i // 3 % 3], 2) for i in range(900)] + [(5, "t5", "en", "big", 2), (None, "n", "en", "x", 1)]
    docs = table(spark, rows).withColumn("slot", F.lit("clash")).withColumn("__note", F.lit(1))
    weights = {"big": 1.0, "x": 1.0, "y": 1.0, None: 1.0}
    plan = mixing.schedule(docs, weights, block_rows=4, period=100).collect()
    assert len(plan) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in plan)
    by_slot = {}
    for r in plan:
        assert by_slot.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    end = max(r.slot for r in plan if r.in_mix) + 1
    done = Counter()
    for slot in range(end):
        done[by_slot[slot][0]] += 1
        assert all(abs(done[s] - (slot + 1) / 4) < 1 for s in weights)
    out = mixing.mix(docs, weights, block_rows=4, period=100)
    assert out.columns == docs.columns and out.count() == sum(r.in_mix for r in plan)
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"big": 1.0})
    assert mixing.schedule(docs.limit(0), {}).count() == 0 and mixing.mix(docs.limit(0), mixing.tempered(docs.limit(0))).count() == 0


def test_a_tiny_source_does_not_shrink_the_mixture(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "other", 2) for i in range(30000)] + [(30000, "one", "en", "tiny", 3), (30001, "none", "en", None, 4), (7, "t7", "en", "big", 2), (None, "n", "en", "big", 1)]
    docs = table(spark, rows)
    stage = dict(corpus_pipeline.STAGES)["pfair_mixing"]
    out = [tuple(r) for r in stage(spark, docs, SF).collect()]
    assert Counter(out) == Counter(rows)
    slots = {(r.doc_id, r.source): r.slot for r in mixing.schedule(docs, mixing.tempered(docs)).filter("doc_id <> 7").collect()}
    order = [slots[r[0], r[3]] for r in out if r[0] not in (None, 7)]
    assert order == sorted(order)


# --- tokens ----------------------------------------------------------------------------------------

ODD = ["", "  a  b ", "\n\t x", "é😀漢字\u0000z", "<s>hi</s><unk>", "▁▁ a▁b", "   ", "a" * 70, " " * 40 + "x", "ﬁ ½ Å", "\r\n\r\n", "<0x41>", "a b  c", " lead", "trail ", "word " * 30000]


def test_ids_equal_the_reference_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(10**7, None)], "doc_id long, text string")).withColumn("token_ids", F.lit(1))
    model = pieces.read_model(MODEL)
    rows = pieces.encode(docs, model).collect()
    known = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in rows:
        if r.text is None:
            assert r.token_ids is None and r.round_trip is None
        else:
            assert r.token_ids == known.encode(r.text) and r.round_trip, r.doc_id
    coded = spark.createDataFrame([(r.doc_id, r.token_ids) for r in rows], "doc_id long, token_ids array<int>")
    back = {r.doc_id: r.text for r in pieces.decode(coded, model).collect()}
    assert all(back[r.doc_id] == (r.text if r.text is None else r.text.replace("▁", " ")) for r in rows)
    assert pieces.encode(docs.limit(0), model).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def test_a_unigram_model_with_byte_fallback():
    """A small model written by hand, read by both libraries."""
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    vocabulary += [("▁", -2.0, 1), ("▁the", -3.0, 1), ("▁th", -4.0, 1), ("e", -3.5, 1), ("t", -5.0, 1), ("h", -5.1, 1), ("▁cat", -4.2, 1), ("c", -6.0, 1), ("a", -4.9, 1), ("at", -4.4, 1), ("s", -4.3, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocabulary)
    data += message((2, message((3, 1), (35, 1)))) + message((3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    known = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = pieces.Pieces(data)
    texts = ["the cats", "the  theath", "", "x the cat", " cat ", "tea", "é the"]
    flat, sizes, same = own.encode(texts)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert flat[a:b].tolist() == known.encode(t), t
    assert same.all()


# --- URL lists -------------------------------------------------------------------------------------


def test_urls_are_judged_as_of_their_fetch(spark):
    day = lambda n: datetime(2024, 1, n)
    entries = [("bad.com", "block", day(5)), ("bad.com", "removed", day(10)), ("BAD.com", "block", day(15)), ("bad.com", "block", day(15)), ("good.bad.com", "allow", day(6))]
    entries += [("news.org/Ads", "block", day(1)), ("news.org/Ads/ok", "allow", day(1)), (None, "block", day(1)), ("x.com", None, day(1)), ("com", "removed", day(1))]
    lists = spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp")
    asked = [
        ("http://bad.com/x", day(4), None, False),
        ("http://bad.com/x", day(5), "bad.com", True),
        ("HTTPS://user@a.b.BAD.com:80?q", day(9), "bad.com", True),
        ("http://bad.com", day(10), None, False),
        ("http://bad.com", day(20), "bad.com", True),
        ("http://notbad.com/", day(20), None, False),
        ("http://good.bad.com/y", day(7), "good.bad.com", False),
        ("http://news.org/Ads/1#z", day(2), "news.org/Ads", True),
        ("http://news.org/ads/1", day(2), None, False),
        ("http://news.org/Ads/ok/2", day(2), "news.org/Ads/ok", False),
        ("no url", day(2), None, False),
        (None, day(2), None, False),
        ("http://bad.com", None, None, False),
    ]
    rows = asked + asked[1:2]
    captures = spark.createDataFrame([(i, u, t, "c") for i, (u, t, _, _) in enumerate(rows)], "page_id long, url string, fetched_at timestamp, pattern string").withColumn("blocked", F.lit(1))
    got = {r.page_id: (r.matched, r.blocked) for r in urls.evaluate(captures, lists).collect()}
    assert got == {i: (m, b) for i, (_, _, m, b) in enumerate(rows)}
    assert urls.evaluate(captures.limit(0), lists).count() == 0
    assert not any(r.blocked for r in urls.evaluate(captures, lists.limit(0)).collect())


# --- sketches --------------------------------------------------------------------------------------


def test_peeling_recovers_differing_digests():
    lists = [np.array(x, np.int64) for x in (list(range(100, 120)) + [7, 7], list(range(103, 122)) + [7], [5], range(1000, 1060), [])]

    def peeled(a, b, cells):
        keys, sign = np.concatenate([a, b]), np.repeat([1, -1], [len(a), len(b)])
        own, key, times, whole = sketches.Sketches(keys, np.zeros(len(keys), np.int64), sign, np.array([cells])).peel()
        return set(zip(key.tolist(), times.tolist(), strict=True)) if whole[0] else None

    for cells in (8, 32, 128):
        assert peeled(lists[0], lists[1], cells) == {(100, 1), (101, 1), (102, 1), (120, -1), (121, -1), (7, 1)}
        assert peeled(lists[4], lists[4], cells) == set() and peeled(lists[2], lists[4], cells) == {(5, 1)}
    assert peeled(lists[3], lists[4], 8) is None and len(peeled(lists[3], lists[4], 128)) == 60  # too full at first, whole in the end


def test_differences_against_counting():
    rng = np.random.default_rng(4)
    a = [rng.integers(0, most, size) for most, size in zip(rng.choice([3, 40, 2**40], 300), rng.choice([0, 1, 9, 80, 700], 300), strict=True)]
    b = [np.concatenate([x[: len(x) // 2], rng.integers(0, 50, rng.integers(0, 60))]) for x in a]
    counted = [sum((x - y).values()) + sum((y - x).values()) for x, y in zip(map(Counter, map(np.ndarray.tolist, a)), map(Counter, map(np.ndarray.tolist, b)), strict=True)]
    assert sketches.differences(a, b).tolist() == counted and sketches.differences([], []).tolist() == []


def test_sketches_of_tables_against_counting(spark):
    rng = np.random.default_rng(6)
    a = [rng.integers(0, most, size).tolist() for most, size in zip(rng.choice([3, 40, 2**40], 40), rng.choice([0, 1, 9, 80, 700], 40), strict=True)]
    b = [x[: len(x) // 2] + rng.integers(0, 50, rng.integers(0, 60)).tolist() for x in a]
    a, b = [*a, [], [7, 7, 5], [2**40 - 1] * 9], [*b, [], [5, 7, 7], [2**40 - 1] * 4]
    pairs = spark.createDataFrame([(i, x, y, len(x) + len(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "row long, a array<long>, b array<long>, size int")
    counted = {i: sum((Counter(x) - Counter(y)).values()) + sum((Counter(y) - Counter(x)).values()) for i, (x, y) in enumerate(zip(a, b, strict=True))}
    found = sketches.differing(pairs, ["row"]).collect()
    assert len(found) == len(a) and {r.row: r.n for r in found} == counted
    assert sketches.differing(pairs.limit(0), ["row"]).count() == 0


def test_fingerprints_hold_every_digest_in_each_table_without_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sketches.edited_fingerprints(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    lists = {r.doc_id: Counter(r.d) for r in docs.select("doc_id", sketches.digests(F.col("text")).alias("d")).collect()}
    for r in found.collect():
        cells = [[int(v, 16) for v in c.split(".")] if c else [0, 0, 0] for c in r.fingerprint.split(",")]
        assert len(cells) == sketches.TABLES * sketches.CELLS
        for t in range(sketches.TABLES):
            held = cells[t * sketches.CELLS : (t + 1) * sketches.CELLS]
            assert sum(c[0] for c in held) == lists[r.doc_id].total()
            assert sum(c[1] for c in held) == sum(k * n for k, n in lists[r.doc_id].items())


def plain_paragraphs(text):
    """Pieces by hand: to the end of the line or sentence within 256 characters, else to a word that ends in a vowel, else 256."""
    out = []
    while text:
        ends = [i + 1 for i in range(min(256, len(text))) if text[i] in "\n。！？।"] + [i + 2 for i in range(min(256, len(text) - 1)) if text[i] in ".!?…؟" and text[i + 1] in " \t\n\x0b\f\r"]
        vowels = [i + 2 for i in range(32, min(256, len(text) - 1)) if text[i] in "aeiouаеиоуαειο" and text[i + 1] in " \t\n\x0b\f\r"]
        size = min(ends, default=min(vowels, default=256))
        out.append(text[:size])
        text = text[size:]
    return out


def test_likeness_of_documents_against_counting(spark):
    """near_edited and near_next of every document, worked out from counted paragraphs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op9_lookup_sketches"](spark, SF).collect()}
    texts = [d.text or "" for d in docs]
    for i, d in enumerate(docs):
        after, q = texts[(i + 1) % len(texts)], len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - q] + after[:q]
        own = Counter(plain_paragraphs(texts[i]))
        for other, near in ((edited, got[d.doc_id].near_edited), (after, got[d.doc_id].near_next)):
            theirs = Counter(plain_paragraphs(other))
            total = own.total() + theirs.total()
            assert near == pytest.approx(1 - ((own - theirs).total() + (theirs - own).total()) / total if total else 1.0), d.doc_id


def test_edited_texts(spark):
    texts = ["abcdefgh" * 5, "", None, "é😀" * 50, "short", "line one\nline two\nline three\n" * 40, "abcdefgh" * 5, "x" * 200000]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("next", F.lit(1))
    got = {r.doc_id // 3: r for r in sketches.edited_fingerprints(docs).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        q = len(t) // 4
        edited = t[: len(t) - q] + plain[(i + 1) % len(plain)][:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert edited != t or (got[i].near_edited == 1 and got[i].edited_fingerprint == got[i].fingerprint)
    assert got[0].fingerprint == got[6].fingerprint and got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1
    docs = spark.createDataFrame([(1, "aaaa"), (1, "bbbbbbbb"), (None, "cccc"), (9, "dddd")], "doc_id long, text string")
    shas = Counter(r.edited_sha256 for r in sketches.edited_fingerprints(docs).collect())
    first = min(("aaaa", "bbbbbbbb"), key=lambda t: t[0])
    assert shas == Counter(hashlib.sha256(t.encode()).hexdigest() for t in ("aaad", "bbbbbbdd", "ccc" + first[0], "dddc"))
    assert sketches.edited_fingerprints(docs.limit(0)).count() == 0


def test_edited_documents_are_nearer_than_next_ones(spark):
    rows = sketches.edited_fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_likeness_does_not_depend_on_length(spark):
    lines = [f"line {i} of {i * i} says so.\n" for i in range(2000)]
    plain = "".join(f"{w} " for w in np.random.default_rng(5).choice(["alpha", "bravo", "lima", "tango", "delta", "kilo", "oscar", "quebec", "sierra"], 800))
    text, long = "".join(lines)[:3072], "".join(lines)
    swapped = "".join(lines[:1500] + [f"other {i}\n" for i in range(500)])
    pairs = [(text, text + "x"), (text, "new line\n" + text), (plain, "front " + plain), (long, swapped), ("a.\n" * 900, "a.\n" * 600), (text, "nothing\nlike it")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(sketches.digests(F.col("a")).alias("a"), sketches.digests(F.col("b")).alias("b")).collect()
    got = sketches.likeness([np.array(r.a, np.int64) for r in rows], [np.array(r.b, np.int64) for r in rows]).tolist()
    assert min(got[:2]) > 0.95 and got[2] > 0.7
    assert got[3:] == [0.75, 0.8, 0]


def test_following_ids(spark):
    ids = sorted({int(x) for x in np.random.default_rng(1).integers(-(2**62), 2**62, 3000)} | set(range(20000)))
    got = {r.k: r.next for r in sketches.following(spark.createDataFrame([(i,) for i in ids], "k long")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


# --- pipeline --------------------------------------------------------------------------------------


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = table(spark, [(10**6, None, "en", "src1", 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "1234 !!", None, "src1", 7), (10**6 + 3, docs.first().text, "en", "src2", 1)])
    now = docs.unionByName(odd)
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        now = step(spark, now, SF).cache()
        seen[name] = now.count()
        assert name == "sentencepiece" or now.columns == docs.columns
    assert seen["language_id"] == 201 and seen["simhash_near_dedup"] < 200 and seen["pii_surrogates"] == seen["simhash_near_dedup"]
    assert 0 < seen["pfair_mixing"] <= seen["pii_surrogates"] and seen["sentencepiece"] == seen["pfair_mixing"]
    assert all(r.round_trip for r in now.collect())


def test_pipeline_on_an_empty_table(spark):
    now = table(spark, [])
    for _, step in corpus_pipeline.STAGES:
        now = step(spark, now, SF)
    assert now.count() == 0
