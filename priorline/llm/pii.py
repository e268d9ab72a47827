"""Personal data replaced by keyed surrogates of the same kind and form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import is_small, stage, without

# Titles that come before a name, by the gender they tell ("" where they tell none).
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Srta Doña Госпожа Г-жа",
    "m": "Mr Mister Herr Monsieur Señor Sr Don Господин Г-н",
    "": "Dr Prof",
}
_ALL = "|".join(sorted((t for names in TITLES.values() for t in names.split()), key=lambda t: (-len(t), t)))
_WORD = r"\p{Lu}(?:\p{Ll}|[’'-]\p{Lu}?\p{Ll})+"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\p{{L}}\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
PHONE = r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
SSN = r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\p{L}\d])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\d])"
SECRET = r"(?<![\p{L}\d])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,128})(?![\p{L}\d])"
NAME = rf"(?<!\p{{L}})(?:{_ALL})\.? {_WORD}(?: {_WORD}){{0,2}}"
ANY = "|".join((EMAIL, IPV4, IBAN, PHONE, SSN, SECRET, CARD, NAME))
HINT = rf"@|\d[ .)-]*\d[ .(-]*\d|[0-9a-f]{{32}}|[A-Z]{{2}}\d{{2}} ?[A-Z0-9]{{4}}|(?:sk|pk|ghp|xox[bp])[-_]|AKIA|(?<!\p{{L}})(?:{_ALL})\.? \p{{Lu}}"  # no entity is without one of these

COUNTRY = r"^\+\d{1,3}"
STREAM = 128  # hash digits drawn per entity; longer entities use them again


def _fits(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(entity: Column) -> Column:
    """What a detected string is; the first kind whose whole form it has."""
    kinds = {"email": EMAIL, "ipv4": IPV4, "iban": IBAN, "phone": PHONE, "ssn": SSN, "secret": SECRET, "card": CARD}
    return reduce(lambda c, k: c.when(entity.rlike(_fits(kinds[k])), k), kinds, F.when(F.lit(False), "")).otherwise("name")


def _gender(entity: Column) -> Column:
    title = F.regexp_replace(F.substring_index(entity, " ", 1), r"\.$", "")
    return F.when(title.isin(TITLES["f"].split()), "f").when(title.isin(TITLES["m"].split()), "m").otherwise("n")


def parts_of(entity: Column) -> Column:
    """The parts replaced one by one: a name's words (given names with their gender, then the surname), else the whole.

    Each part has its kind and the canonical spelling under which all its mentions are the same.
    """
    kind = kind_of(entity)
    words = F.slice(F.split(entity, " "), F.lit(2), F.greatest(F.size(F.split(entity, " ")) - 1, F.lit(0)))
    named = F.transform(
        words,
        lambda w, i: F.struct(
            F.when(i + 1 == F.size(words), F.lit("surname")).otherwise(F.concat(F.lit("given_"), _gender(entity))).alias("kind"), F.lower(w).alias("canon"), w.alias("form")
        ),
    )
    bare = F.upper(F.regexp_replace(entity, r"[^\p{L}\d]", ""))
    country = F.regexp_extract(entity, COUNTRY, 0)
    phone = F.when(country == "", bare).otherwise(F.concat(country, F.lit(" "), F.substring(bare, F.length(country), F.length(bare))))
    canon = F.when(kind == "email", F.lower(entity)).when(kind.isin("ipv4", "secret"), entity).when(kind == "phone", phone).otherwise(bare)
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), entity.alias("form"))))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """STREAM hex digits that the key, the entity and the attempt fix."""
    seed = F.concat_ws("\0", F.lit(key), kind, attempt.cast("string"), canon)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("second\0"), seed), 256))


def _digit(stream: Column, at: Column) -> Column:
    return F.translate(F.substring(stream, 1 + at % STREAM, 1), "abcdef", "274916")


def _letter(stream: Column, at: Column) -> Column:
    """A lower-case letter; two digits of the stream decide."""
    number = F.conv(F.concat(F.substring(stream, 1 + at % STREAM, 1), F.substring(stream, 1 + (at * 7 + 3) % STREAM, 1)), 16, 10).cast("int")
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), 1 + number % 26, 1)


def _like(form: Column, stream: Column) -> Column:
    """Digit for digit and letter for letter in its case and script; everything else stays.

    The n-th letter or digit gets the n-th draw, so separators do not change the result.
    """

    def one(c: Column, place: Column) -> Column:
        i = F.length(F.regexp_replace(F.substring(form, F.lit(1), place), r"[^\p{L}\d]", ""))
        letter = _letter(stream, i)
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), F.translate(letter, "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувжэыз")).when(
            c.rlike(r"\p{IsGreek}"), F.translate(letter, "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωάέ")
        ).otherwise(letter)
        return F.when(c.rlike(r"\d"), _digit(stream, i)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(form, "(?<=.)(?=.)"), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string modulo ten."""
    backwards = F.split(F.reverse(digits), "(?<=.)(?=.)")
    doubled = F.transform(backwards, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10


def _card(form: Column, stream: Column) -> Column:
    """As ``_like``; a number that passes the Luhn test gets one that passes."""
    new = _like(form, stream)
    plain = F.regexp_replace(F.concat(F.substring(new, 1, F.length(new) - 1), F.lit("0")), r"\D", "")
    return F.when(_luhn(F.regexp_replace(form, r"\D", "")) == 0, F.concat(F.substring(new, 1, F.length(new) - 1), ((10 - _luhn(plain)) % 10).cast("string"))).otherwise(new)


def _name(kind: Column, form: Column, stream: Column) -> Column:
    """A capitalised name of syllables; given names end as the gender's names do."""
    consonants, vowels = "bdfglmnrstvkzphc", "aeiouaeioaeiaeou"

    def syllable(at: int) -> Column:
        c, v = F.substring(stream, at, 1), F.substring(stream, at + 1, 1)
        return F.concat(F.translate(c, "0123456789abcdef", consonants), F.translate(v, "0123456789abcdef", vowels))

    pick = F.substring(stream, 20, 1)
    female = F.when(pick < "8", "na").otherwise("lia")
    male = F.when(pick < "8", "ron").otherwise("mir")
    either = F.when(pick < "8", "ry").otherwise("lin")
    body = F.concat(syllable(1), syllable(3), syllable(5))
    latin = F.initcap(F.concat(body, F.when(kind == "given_f", female).when(kind == "given_m", male).when(kind == "given_n", either).otherwise(F.when(pick < "8", "ner").otherwise("sen"))))
    cyrillic = F.translate(latin, "abcdefghiklmnoprstuvyzABCDEFGHIKLMNOPRSTUVYZ", "абцдефгхиклмнопрстувызАБЦДЕФГХИКЛМНОПРСТУВЫЗ")
    return F.when(form.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)


def surrogate(key: str, kind: Column, canon: Column, form: Column, attempt: Column) -> Column:
    """The replacement of one mention: the same for every mention of the entity under one key and attempt."""
    stream = _stream(key, kind, canon, attempt)
    octets = F.array_join(F.transform(F.array(*[F.lit(i) for i in (1, 5, 9, 13)]), lambda i: (F.conv(F.substring(stream, i, 4), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    country = F.regexp_extract(form, COUNTRY, 0)
    phone = F.concat(country, _like(F.substring(form, F.length(country) + 1, F.length(form)), stream))
    domain = F.substring_index(form, ".", -1)  # the last label of an address stays, so it stays an address
    email = F.concat(_like(F.substring(form, 1, F.length(form) - F.length(domain)), stream), domain)
    secret = F.when(form.rlike(r"^[0-9a-f]+$"), F.substring(stream, 1, F.length(form))).otherwise(
        F.concat(F.substring(form, 1, 4), _like(F.substring(form, 5, F.length(form)), stream))
    )
    iban = F.concat(F.substring(form, 1, 2), _like(F.substring(form, 3, F.length(form)), stream))
    return (
        F.when(kind == "email", email)
        .when(kind == "ipv4", octets)
        .when(kind == "phone", phone)
        .when(kind == "card", _card(form, stream))
        .when(kind == "secret", secret)
        .when(kind == "iban", iban)
        .when(kind == "ssn", _like(form, stream))
        .otherwise(_name(kind, form, stream))
    )


def _canonical_surrogate(key: str, attempt: Column) -> Column:
    """The surrogate in canonical spelling, which is what must not collide."""
    return surrogate(key, F.col("kind"), F.col("canon"), F.col("canon"), attempt)


def _may_hold(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT), F.lit(False))


def attempts(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate another entity has, or is itself an entity.

    All other entities have attempt 0.  Of those that share a surrogate the least keeps it; the others
    draw again until no surrogate equals an entity of the corpus or another surrogate.  Each round
    handles only what the last one left, as joins and groupings over distinct entities.
    """
    found = docs.filter(_may_hold(F.col(text_col))).select(F.explode(F.flatten(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0)), parts_of))).alias("p"))
    entities = stage(found.select("p.kind", "p.canon").distinct(), "entities")
    todo, taken, moved, attempt = entities, None, None, 0
    while True:
        drawn = todo.withColumn("new", _canonical_surrogate(key, F.lit(attempt)))
        free = drawn.join(entities.select("kind", F.col("canon").alias("new")), ["kind", "new"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "new"], "left_anti")
        won = stage(free.groupBy("kind", "new").agg(F.min("canon").alias("canon")), "won")
        if attempt:
            now = won.select("kind", "canon", F.lit(attempt).alias("attempt"))
            moved = now if moved is None else moved.union(now)
        todo = stage(todo.join(won, ["kind", "canon"], "left_anti"), "todo")
        if todo.limit(1).count() == 0:
            break
        taken = won.select("kind", "new") if taken is None else taken.union(won.select("kind", "new"))
        attempt += 1
        if attempt > 64:
            raise ValueError("surrogates of some kind are used up; no distinct ones are left")
    return moved if moved is not None else entities.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)


SMALL = 1000  # moved entities up to which their attempts travel as one literal map


def replace(docs: DataFrame, text_col: str = "text", key: str = "key", count_out: str = "n_entities") -> DataFrame:
    """Replace the personal data in every text and add how many entities were found.

    Replacements depend on the key and the entity alone: all mentions of an entity get the same one in
    every document, different entities never share one, and none equals an entity of the corpus.  Digits
    stay digits, letters keep case and script, separators, country codes, prefixes of account numbers and last
    labels of addresses stay, card numbers keep passing their check sum, and names keep title, gender and
    script.  Texts without entities are unchanged; null texts stay null with 0 entities.  A column named
    as ``count_out`` is replaced; names that start with two underscores are reserved.
    """
    rows = without(docs, count_out)
    text = F.col(text_col)
    moved = stage(attempts(docs, text_col, key), "moved")
    if is_small(moved, SMALL):
        pairs = [(F.lit(f"{r.kind}\0{r.canon}"), F.lit(r.attempt)) for r in moved.collect()]  # at most SMALL rows
        fixed = F.create_map(*[x for p in pairs for x in p]) if pairs else None
        rows = rows.withColumn("__at", F.when(_may_hold(text), F.lit(0)))
    else:
        # texts that mention a moved entity get the attempts of theirs, matched by the text itself
        own = docs.filter(_may_hold(text)).select(F.xxhash64(text).alias("__t"), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), parts_of)).alias("p")).distinct()
        each = own.select("__t", F.explode("p").alias("p")).select("__t", "p.kind", "p.canon").join(moved, ["kind", "canon"]).distinct()
        maps = each.groupBy("__t").agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit("\0"), "canon").alias("k"), "attempt"))).alias("__m"))
        rows = rows.withColumn("__t", F.xxhash64(text)).join(maps, "__t", "left").drop("__t").withColumn("__at", F.when(_may_hold(text), F.lit(0)))
        fixed = F.col("__m")

    def new_text(entity: Column) -> Column:
        def one(part: Column) -> Column:
            moved_to = F.coalesce(F.try_element_at(fixed, F.concat(part["kind"], F.lit("\0"), part["canon"])), F.lit(0)) if fixed is not None else F.lit(0)
            return surrogate(key, part["kind"], part["canon"], part["form"], moved_to)

        done = F.array_join(F.transform(parts_of(entity), one), " ")
        return F.when(kind_of(entity) == "name", F.concat(F.substring_index(entity, " ", 1), F.lit(" "), done)).otherwise(done)

    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, F.transform(found, new_text), lambda b, n: F.concat(b, F.coalesce(n, F.lit("")))), "")
    held = F.col("__at").isNotNull()
    rows = rows.withColumn("__n", F.when(held, F.size(found)).otherwise(0))
    out = rows.withColumn("__new", F.when(F.col("__n") > 0, joined).otherwise(text))
    return out.select(*[F.col("__new").alias(c) if c == text_col else F.col(c) for c in rows.columns if not c.startswith("__")], F.col("__n").alias(count_out))
