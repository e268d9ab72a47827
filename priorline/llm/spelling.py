"""Spelling variants: words one edit apart, found by the chunk that the edit leaves alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import stage

CROWD = 64  # words under one chunk beyond which its words are cut once more
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, letters: str, shortest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every maximal run of at least ``shortest`` letters of the whole texts, A-Z in lower case.

    ``letters`` is the content of a character class.  A null text has no runs; a run that occurs twice is two rows.
    """
    found = F.regexp_extract_all(docs[text_col], F.lit(f"[{letters}]{{{shortest},}}+"), F.lit(0))
    return docs.select(docs[id_col].alias("id"), F.explode(found).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))


def without_point(word: Column, at: Column) -> Column:
    """The word less its code point at a place (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def _cut(rows: DataFrame) -> DataFrame:
    """Halve the open part of each row: one row keeps the first half as its chunk, the other the second.

    A row stands for a word as the shorter of a pair (more = 0) or, more = 1, as one that is longer by a code point:
    then its second half is the gram one place further on.  ``key`` hashes the chunks kept so far and their places.
    """
    half = F.floor(F.col("open") / 2).cast("int")
    first = F.substring("word", F.col("at") + 1, half)
    second = F.substring("word", F.col("at") + half + F.col("more") + 1, F.col("open") - half)
    kept = F.array(
        F.struct(F.xxhash64("key", F.lit(0), first).alias("key"), (F.col("at") + half).alias("at"), (F.col("open") - half).alias("open")),
        F.struct(F.xxhash64("key", F.lit(1), second).alias("key"), F.col("at").alias("at"), half.alias("open")),
    )
    return rows.select("word", "n", "more", F.inline(kept))


def _meet(rows: DataFrame) -> DataFrame:
    """Pairs of words under one key that are one edit apart."""
    a = rows.filter("more = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", "more", F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = a.join(b, "key").filter((F.col("more") == 1) | (F.col("a") < F.col("b")))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of distinct words that differ by one inserted, deleted or replaced code point, once each.

    ``words`` has distinct words and their counts n.  Of a pair the shorter word (of equal ones either) gives two disjoint
    chunks, its halves; the other gives its grams of that size at the places a chunk can have in it, shifted by one at
    most (grams elsewhere cannot meet any chunk and are not written).  One edit leaves one half whole, so the pair meets
    under it and is verified.  Where more than CROWD words share a chunk, the rest of each word is halved in the same way
    and both chunks make the key, until few share it or one code point is left open: no pair is lost and no group
    is joined whole.
    """
    size = F.length("word") - F.col("more")
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    rows = rows.select("*", F.xxhash64(size).alias("key"), F.lit(0).alias("at"), size.alias("open")).filter("open >= 0")
    found = []
    while True:
        rows = _cut(rows)
        sizes = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("more").alias("least"))
        shared = rows.join(sizes.filter("members > 1 AND least = 0"), "key")
        shared = stage(shared.withColumn("crowded", (F.col("members") > CROWD) & (F.col("open") > 1)).drop("members", "least"), "chunks")
        found.append(_meet(shared.filter("NOT crowded")))
        rows = shared.filter("crowded").drop("crowded")
        if rows.isEmpty():
            return reduce(DataFrame.union, found).distinct()


def _follow(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms; each round doubles the steps a word has gone."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("then"))
        further = roots.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved"))
        further = stage(further, "roots")
        roots = further.drop("moved")
        if further.filter("moved").isEmpty():
            return roots


def variant_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """Group words with the spelling they are variants of: word, form, root, n, n_near, form_n.

    ``words``: word and n; rows that share a word are added up, null words and null counts are left out.  A word's form is
    the most frequent word one edit away (ties: the smallest in code-point order) if that has at least ``times`` its
    count, else null; root follows forms to the last, which ends since counts grow at every step.  n_near is the
    number of words one edit away, form_n the form's count.  An empty table gives no rows.
    """
    counted = stage(words.filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    pairs = stage(near_pairs(counted), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    best_n = -F.col("best.less")
    taken = best_n >= times * F.col("n")
    judged = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, best_n).alias("form_n")
    )
    judged = stage(judged, "forms")
    roots = _follow(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
