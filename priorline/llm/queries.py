"""One query per operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.llm import langid, lm, mixing, periods, pieces, pii, secrets, simhash, sketches, spelling, substrings, urls, vectors
from priorline.llm.common import small_batches
from priorline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODEL_SETTING = "spark.priorline.pieceModel"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEY_SETTING = "spark.priorline.surrogateKey"


def _query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(spark: SparkSession) -> bytes:
    """The SentencePiece model that the session names."""
    return pieces.read_model(spark.conf.get(MODEL_SETTING, MODEL))


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, "priorline")


@_query("op1_language_id")
def language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    references = langid.learn(docs.filter(~langid.held_out()))
    return langid.predict(docs, references).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query("op2_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@_query("op3_pii_surrogates")
def pii_surrogates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, key=surrogate_key(spark)).select("doc_id", "text", "n_entities")


@_query("op4_cross_entropy_difference")
def cross_entropy_difference(spark, sf_dir):
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    scored = lm.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", "loss_target", "loss_background", "loss_difference")


@_query(
    "op5_embedding_near_dedup",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
part AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN part ON part.a = vec_id LEFT JOIN n ON n.a = vec_id""",
)
def embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query(
    "op6_pfair_mixing",
    """
WITH RECURSIVE src AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
tot AS (SELECT sum(sqrt(n)) AS t, count(*) AS c FROM src),
want AS (SELECT source, n, sqrt(n) / t * (1000 - c) AS e FROM src, tot),
base AS (SELECT source, n, 1 + floor(e)::INT AS b, row_number() OVER (ORDER BY e - floor(e) DESC, source) AS o, 1000 - sum(1 + floor(e)::INT) OVER () AS spare FROM want),
share AS (SELECT source, n, b + CASE WHEN o <= spare THEN 1 ELSE 0 END AS k, row_number() OVER (ORDER BY source) - 1 AS i FROM base),
lists AS (SELECT list(k ORDER BY i) AS ks FROM share),
walk(slot, done, pick) AS (
  SELECT -1, list_transform(ks, lambda x: 0), -1 FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(range(len(ks)), lambda i: done[i + 1] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT slot, done, ks, (list_min(list_transform(range(len(ks)), lambda i:
          CASE WHEN done[i + 1] < ks[i + 1] AND done[i + 1] * 1000 // ks[i + 1] <= slot + 1
               THEN {'d': ((done[i + 1] + 1) * 1000 + ks[i + 1] - 1) // ks[i + 1], 'i': i} END))).i::INT AS p
        FROM walk, lists WHERE slot < 999)),
plan AS (SELECT slot, pick, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM walk WHERE slot >= 0),
ends AS (SELECT min((cb // k) * 1000 + slot) AS stop FROM (SELECT i, k, (n + 7) // 8 AS cb FROM share) s JOIN plan ON pick = i AND j = cb % k),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || doc_id), doc_id) - 1 AS r FROM documents),
placed AS (SELECT doc_id, source, r // 8 AS block, r % 8 AS place, k, i FROM ranked JOIN share USING (source))
SELECT doc_id, source, block::BIGINT AS block, place::BIGINT AS place, ((block // k) * 1000 + slot)::BIGINT AS slot,
  (block * 1000 // k)::BIGINT AS "release", (((block + 1) * 1000 + k - 1) // k)::BIGINT AS deadline, (block // k) * 1000 + slot < stop AS in_mix
FROM placed JOIN plan ON pick = i AND j = block % k, ends""",
)
def pfair_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return mixing.schedule(docs, mixing.tempered(docs))


@_query("op7_sentencepiece")
def sentencepiece(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, piece_model(spark)).select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n_tokens"), "token_ids", "round_trip")


def _number(text: Column) -> Column:
    """A number that both engines get from a text: the first eight hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


START = 1704067200  # 2024-01-01, the first day captures and entries can have
DAY = 86400


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a fetch time within a year, which the table lacks, from the page's id."""
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(START + _number(F.concat(F.lit("f"), "page_id")) % (365 * DAY)).alias("fetched_at"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries about the domains, hosts and first path parts that occur in pages.

    A third of the domains is blocked, taken off after 60 days and blocked again after 120; a quarter of
    the hosts is allowed and a quarter of the first path parts blocked from some day on.
    """
    seen = _table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("h"), F.regexp_extract(urls.path(F.col("url")), "^/([^/]+)", 1).alias("s"))
    seen = seen.filter("h IS NOT NULL")

    def day(p: Column, more: int = 0) -> Column:
        return F.timestamp_seconds(START + (_number(F.concat(F.lit("d"), p)) % 300 + more) * DAY).alias("listed_at")

    p = F.col("p")
    domains = seen.select(F.substring_index("h", ".", -2).alias("p")).distinct().filter(_number(p) % 3 == 0)
    hosts = seen.select(F.col("h").alias("p")).distinct().filter(_number(F.concat(F.lit("h"), p)) % 4 == 1)
    parts = seen.filter("s <> ''").select(F.concat("h", F.lit("/"), "s").alias("p")).distinct().filter(_number(p) % 4 == 2)
    steps = [("block", 0), ("removed", 60), ("block", 120)]
    entries = [domains.select(p.alias("pattern"), F.lit(a).alias("action"), day(p, more)) for a, more in steps]
    entries += [hosts.select(p.alias("pattern"), F.lit("allow").alias("action"), day(p)), parts.select(p.alias("pattern"), F.lit("block").alias("action"), day(p))]
    out = entries[0]
    for e in entries[1:]:
        out = out.union(e)
    return out


_NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _duck_number(text: str) -> str:
    return _NUMBER.format(text)


@_query(
    "op8_url_filters",
    f"""
WITH seen AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) AS path,
    1704067200 + {_duck_number("'f' || page_id")} % 31536000 AS t FROM pages),
keyed AS (SELECT *, regexp_extract(path, '^/([^/]+)', 1) AS s, string_split(h, '.') AS labels FROM seen WHERE h <> ''),
domains AS (SELECT DISTINCT CASE WHEN len(labels) >= 2 THEN labels[-2] || '.' || labels[-1] ELSE h END AS p FROM keyed),
entries AS (
  SELECT p, a.act, (SELECT {_duck_number("'d' || p")}) % 300 + a.more AS day FROM domains, (VALUES ('block', 0), ('removed', 60), ('block', 120)) a(act, more) WHERE {_duck_number("p")} % 3 = 0
  UNION ALL SELECT p, 'allow', {_duck_number("'d' || p")} % 300 FROM (SELECT DISTINCT h AS p FROM keyed) WHERE {_duck_number("'h' || p")} % 4 = 1
  UNION ALL SELECT p, 'block', {_duck_number("'d' || p")} % 300 FROM (SELECT DISTINCT h || '/' || s AS p FROM keyed WHERE s <> '') WHERE {_duck_number("p")} % 4 = 2),
daily AS (SELECT p, day, min(act) AS act FROM entries GROUP BY p, day),
spans AS (SELECT p, act, 1704067200 + day * 86400 AS since, 1704067200 + lead(day) OVER (PARTITION BY p ORDER BY day) * 86400 AS until FROM daily),
probes AS (
  SELECT page_id, t, array_to_string(labels[i:], '.') AS p FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM keyed)
  UNION SELECT page_id, t, h || '/' || array_to_string(parts[1:i], '/') FROM
    (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM keyed))),
hits AS (SELECT page_id, p, act, row_number() OVER (PARTITION BY page_id ORDER BY length(p) DESC, p DESC) AS o
  FROM probes JOIN spans USING (p) WHERE act IN ('allow', 'block') AND since <= t AND (until IS NULL OR t < until))
SELECT seen.page_id, seen.url, make_timestamp(t * 1000000) AS fetched_at, p AS matched, coalesce(act = 'block', false) AS blocked
FROM seen LEFT JOIN hits ON hits.page_id = seen.page_id AND o = 1""",
)
def url_filters(spark, sf_dir):
    found = urls.evaluate(captures(spark, sf_dir), listed(spark, sf_dir))
    return found.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@_query("op9_lookup_sketches")
def lookup_sketches(spark, sf_dir):
    return sketches.edited_fingerprints(_table(spark, sf_dir, "documents"))


@_query(
    "op10_substring_dedup",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS x FROM (SELECT *, unnest(range(1, len(ws) - 33)) AS s FROM w)),
rep AS (SELECT doc_id, s FROM win JOIN (SELECT x FROM win GROUP BY x HAVING count(*) > 1) USING (x)),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(35)) AS p FROM rep),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
)
def substring_dedup(spark, sf_dir):
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


#: Remainder of zlib's CRC-32 in SQL, bit by bit: the text's bits, the lowest of each byte first, enter one at a time.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * octet_length(encode({0}))),
    lambda i: (('0x' || substr(hex(encode({0})), 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)) & 1)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT)"""

@_query(
    "op11_periodic_runs",
    f"""
WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {_CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
sized AS (SELECT *, len(ws) AS n, h // 10 AS g FROM raw),
spun AS (SELECT doc_id, ws, n, h % 10 = 0 AND n > 0 AS spins, g % greatest(n, 1) AS a, 3 + g % 8 AS k FROM sized),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM spun),
place AS (SELECT doc_id, unnest(range(n)) AS i, spins, a, 1 + (n - a) // k AS p FROM spun),
text AS (SELECT place.doc_id, place.i, w FROM place JOIN word ON word.doc_id = place.doc_id
  AND word.i = CASE WHEN spins AND place.i >= a THEN a + (place.i - a) % p ELSE place.i END),
whole AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM text GROUP BY doc_id),
gram AS (SELECT doc_id, s, array_to_string(ws[s + 1:s + 16], ' ') AS x, n FROM (SELECT doc_id, ws, len(ws) AS n, unnest(range(len(ws) - 15)) AS s FROM whole)),
twin AS (SELECT a.doc_id, a.s, b.s - a.s AS q FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.x = b.x AND b.s > a.s AND 3 * (b.s - a.s) <= a.n),
part AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, q ORDER BY s) AS o FROM twin),
stretch AS (SELECT doc_id, q, min(s) AS start, max(s) + 16 + q - min(s) AS length FROM part GROUP BY doc_id, q, o),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS o FROM run),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM text ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN top ON top.doc_id = d.doc_id AND o = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id""",
)
def periodic_runs(spark, sf_dir):
    """Runs of every whole text; a tenth of the texts is made periodic from some word on, by hash of the id."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    spun = docs.withColumn("ws", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    spun = spun.withColumn("n", F.size("ws")).withColumn("g", F.floor(F.col("h") / 10))
    spun = spun.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    spun = spun.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    runs = periods.periodic_runs(spun.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), edited).otherwise(F.col("text")).alias("text")))
    # exact: a / b > c / d as a * d > c * b
    above = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    by_exponent = lambda x, y: F.when(above(x, y) != 0, F.signum(-above(x, y))).otherwise(F.signum(F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]))).cast("int")
    top = F.get(F.array_sort("runs", by_exponent), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


LETTERS = "A-Za-z\u00c0-\u00ff"
#: Code points that DuckDB's byte-wise edit distance must see as one byte each, and what stands for them there.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 !#$%&()*+,-./:;<=>?@[]^_{|}~"[:64]


@_query(
    "op12_spelling_variants",
    f"""
WITH RECURSIVE run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS r FROM documents),
hashed AS (SELECT r, {_CRC32.format("(doc_id || ':' || r)")} AS h FROM run WHERE length(r) >= 7),
word AS (SELECT word, count(*) AS n FROM
    (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, translate(word, '{_WIDE}', '{_NARROW}') AS t, unnest(list_prepend(word, list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)))) AS x FROM word),
near AS (SELECT DISTINCT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM cut a JOIN cut b USING (x) WHERE a.word <> b.word AND levenshtein(a.t, b.t) = 1),
best AS (SELECT a, a_n, count(*) AS n_near, min({{'n': -b_n, 'w': b}}) AS f FROM near GROUP BY a, a_n),
form AS (SELECT a AS word, f.w AS form, -f.n AS form_n FROM best WHERE -f.n >= 10 * a_n),
walk(word, stop) AS (SELECT word, form FROM form UNION ALL SELECT w.word, f.form FROM walk w JOIN form f ON f.word = w.stop),
ends AS (SELECT word, stop FROM walk WHERE stop NOT IN (SELECT word FROM form))
SELECT word.word, form, coalesce(stop, word.word) AS root, n::BIGINT AS n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM word LEFT JOIN best ON best.a = word.word LEFT JOIN form ON form.word = word.word LEFT JOIN ends ON ends.word = word.word""",
)
def spelling_variants(spark, sf_dir):
    """Every word of the corpus with the frequent word it is one edit away from; typing errors are put in by hash."""
    found = spelling.runs(_table(spark, sf_dir, "documents"), LETTERS, 7)
    length = F.length("run")
    h = F.crc32(F.concat_ws(":", F.col("id").cast("string"), "run"))
    word = F.when(h % 31 == 0, spelling.without_point(F.col("run"), (h % length).cast("int"))).otherwise(F.col("run"))
    words = found.select(word.alias("word")).filter(F.length("word") >= 7).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.variant_groups(words.filter("n >= 2"))


@_query("op13_secret_scans")
def secret_scans(spark, sf_dir):
    """Secrets of every whole text: how many of each fixed kind, the digest of their spans, and all spans with the lexer's."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def spans(chosen: Column) -> Column:
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.BASE]
    base = F.filter("secrets", lambda s: s["kind"] != secrets.LITERAL)
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("secrets")).alias("spans"))
