"""Secret scans: fixed patterns, and literals that a source or configuration syntax gives to a sensitive name."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Patterns every scan reports, the group whose length counts and its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # runs below 24 characters fail anyway, so only longer ones are matched; a match is a whole run
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
LITERAL = "literal"  # the kind of what the lexer adds
KINDS = [*BASE, LITERAL]
THRESHOLD = 0.6

#: Parts of names, and pairs of neighbouring parts, that make a name sensitive.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "authorization": 0.9}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("master", "key"), ("account", "key"), ("shared", "key"), ("auth", "key"), ("connection", "string")}
#: Last parts of names that describe a secret and do not hold it.
DESCRIBES = set("name id url uri path file length len size count type expiry expires ttl timeout hint policy field label regex pattern format prefix header endpoint min max enabled required".split())
#: Marks of values that stand for a secret still to be filled in.
PLACEHOLDER = re.compile(r"example|changeme|change_me|placeholder|your[-_ ]|dummy|redacted|x{4}|\*{3}|^<.*>$|^(none|null|true|false|undefined|todo)$", re.IGNORECASE)

_TOKEN = re.compile(
    r"""(?P<text>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
    |(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
    |(?P<gives>:=|=>|\?=|===?|=(?![=>~])|:(?![:/]))
    |(?P<line>\n)
    |(?P<mark>[^\s\w])
    |(?P<rest>\w+)""",
    re.VERBOSE | re.DOTALL,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?|%([A-Za-z_]\w*)%|\{\{\s*([\w.]+)\s*\}\}")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]{0,63})>([^<\n]+)</\1>")
_FLAG = re.compile(r"(?<!\S)--([A-Za-z][\w-]{0,63})\x20+([^\s\"'-]\S*)")
_LOGIN = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s/@]+)@")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
_DECLARES = {"var", "const", "let", "val", "final", "static", "private", "public"}
_READS = {"get", "getenv", "env", "getproperty", "setdefault"}  # calls whose first text names what they read


class Literal(NamedTuple):
    """A value's text and its place; ``bare`` if nothing quotes it."""

    value: str
    start: int
    end: int
    bare: bool = False


def name_score(name: str) -> float:
    """How sensitive a name is, from its words: 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    known = max((SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in parts), default=0.0)
    if any(pair in SENSITIVE_PAIRS for pair in zip(parts, parts[1:], strict=False)):
        known = 1.0
    return known * (0.2 if parts and parts[-1] in DESCRIBES else 1.0)


def value_score(literal: Literal) -> float:
    """How much a value looks like a secret: kinds of characters, entropy and length against placeholders and prose."""
    text = literal.value
    if len(text) < 6 or len(set(text)) < 3:
        return 0.0
    kinds = sum(any(test(c) for c in text) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    score = min(1.0, 0.35 + 0.15 * (kinds - 1) + 0.1 * min(entropy, 4) + 0.01 * min(len(text), 20))
    return score * (0.1 if PLACEHOLDER.search(text) else 1) * (0.3 if any(c.isspace() for c in text) else 1) * (0.7 if literal.bare else 1)


def _inside(token: re.Match) -> Literal:
    """A quoted text without its quotes."""
    width = 3 if token[0][:3] in ('"""', "'''") and len(token[0]) >= 6 else 1
    return Literal(token[0][width:-width], token.start() + width, token.end() - width)


def _targets(tokens: list[re.Match], at: int) -> list[str]:
    """Names that the sign at ``at`` gives a value to: a name, a quoted key, an indexed or a declared one."""
    names, i = [], at - 1
    if i >= 0 and tokens[i][0] == "]":
        i -= 1
    if i >= 0 and tokens[i].lastgroup == "text":
        return [_inside(tokens[i]).value]
    if i >= 0 and tokens[i].lastgroup == "name":
        names.append(tokens[i][0])
        if i >= 2 and tokens[i - 1][0] == ":" and tokens[i - 2].lastgroup == "name":  # name: type = value
            names.append(tokens[i - 2][0])
        elif i >= 2 and tokens[i - 1].lastgroup == "name" and tokens[i - 2][0] in _DECLARES:  # var name type = value
            names.append(tokens[i - 1][0])
    return names


def _value(text: str, tokens: list[re.Match], at: int) -> tuple[Literal | None, list[str]]:
    """What stands right of the sign at ``at``: a literal (joined parts are one), and the names it refers to."""
    parts: list[Literal] = []
    names: list[str] = []
    i = at + 1
    while i < len(tokens):
        token = tokens[i]
        if token.lastgroup == "text":
            parts.append(_inside(token))
            i += 1
        elif token.lastgroup == "name" and i + 1 < len(tokens) and tokens[i + 1][0] == "(":
            reads, depth, j, seen = token[0].split(".")[-1].lower() in _READS, 1, i + 2, 0
            while j < len(tokens) and depth and tokens[j].lastgroup != "gives":
                depth += {"(": 1, ")": -1}.get(tokens[j][0], 0)
                if tokens[j].lastgroup == "text":
                    seen += 1
                    if not (reads and seen == 1):
                        parts.append(_inside(tokens[j]))
                j += 1
            i = j
        elif tokens[i][0] in ("(", "+"):
            i += 1
            while i < len(tokens) and tokens[i].lastgroup == "line":
                i += 1
            continue
        elif not parts and token.lastgroup != "line" and (bare := _BARE.match(text, token.start())):
            if bare[0].lower() in ("bearer", "basic", "token") and i + 1 < len(tokens) and (after := _BARE.match(text, tokens[i + 1].start())):
                bare = after
            elif token.lastgroup == "name" and token[0] == bare[0]:
                names.append(token[0])
            parts.append(Literal(bare[0], bare.start(), bare.end(), True))
            break
        elif token.lastgroup == "name":
            names.append(token[0])
            i += 1
        else:
            break
        if i < len(tokens) and tokens[i][0] not in ("+", "\\") and tokens[i].lastgroup != "text":
            break
        i += i < len(tokens) and tokens[i][0] == "\\"
        while i + 1 < len(tokens) and tokens[i].lastgroup == "line" and tokens[i - 1][0] == "\\":
            i += 1
    if not parts:
        return None, names
    whole = Literal("".join(p.value for p in parts), parts[0].start, parts[-1].end, parts[0].bare)
    if reference := _REFERENCE.fullmatch(whole.value):
        return None, [*names, next(filter(None, reference.groups()))]
    return whole, names


def pairs(text: str) -> list[tuple[str, Literal | None, list[str]]]:
    """(name, literal, names referred to) of every assignment, key, element, flag and login of a text."""
    tokens = list(_TOKEN.finditer(text))
    found = []
    for i, token in enumerate(tokens):
        if token.lastgroup == "gives" and (names := _targets(tokens, i)):
            literal, refers = _value(text, tokens, i)
            found += [(name, literal, refers) for name in names if literal or refers]
    found += [(m[1], Literal(m[2], *m.span(2)), []) for m in _ELEMENT.finditer(text)]
    found += [(m[1], Literal(m[2], *m.span(2), True), []) for m in _FLAG.finditer(text)]
    found += [("password", Literal(m[1], *m.span(1)), []) for m in _LOGIN.finditer(text)]
    return found


def literals(text: str) -> dict[tuple[int, int], tuple[float, str]]:
    """Span of every literal that reaches a sensitive name, with its score and that name.

    A name that is given another name takes over all literals that name holds anywhere in the text, in any number of
    steps; a bare word that is such a name is no literal itself.
    """
    given = pairs(text)
    holds: dict[str, list[Literal]] = {}
    refers: dict[str, set[str]] = {}
    targets = {name for name, _, _ in given}
    for name, literal, others in given:
        known = [o for o in others if o in targets and o != name]
        if literal and not known:
            holds.setdefault(name, []).append(literal)
        refers.setdefault(name, set()).update(known)
    out: dict[tuple[int, int], tuple[float, str]] = {}
    for name in targets:
        weight = name_score(name)
        if weight < THRESHOLD:
            continue
        reached, todo = {name}, [name]
        while todo:
            fresh = refers.get(todo.pop(), set()) - reached
            reached |= fresh
            todo += fresh
        for literal in (x for r in reached for x in holds.get(r, [])):
            scored = (weight * value_score(literal), name)
            if scored[0] >= THRESHOLD:
                span = (literal.start, literal.end)
                out[span] = max(out.get(span, scored), scored)
    return out


_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "string", "://")


def scan(text: str) -> list[dict]:
    """All findings of a text by start, then kind; those of the lexer are left out where a base span covers them."""
    low = text.lower()
    found = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += _base(text, "assign")
    if "AKIA" in text:
        found += _base(text, "access")
    found += _base(text, "hex")
    if any(s in low for s in _STEMS) and any(s in text for s in ("=", ":", "</", "--")):
        spans = [(f["start"], f["end"]) for f in found]
        more = literals(text)
        found += [{"kind": LITERAL, "start": a, "end": b, "score": s, "name": n} for (a, b), (s, n) in more.items() if not any(x <= a and b <= y for x, y in spans)]
    return sorted(found, key=lambda f: (f["start"], KINDS.index(f["kind"]), f["end"]))


def _base(text: str, kind: str) -> list[dict]:
    pattern, group, least = BASE[kind]
    return [{"kind": kind, "start": m.start(), "end": m.end(), "score": 1.0, "name": None} for m in pattern.finditer(text) if len(m[group]) >= least]


_FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()), StructField("name", StringType())]))
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("name", pa.string())]))


@F.arrow_udf(_FOUND)
def _scanned(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield pa.array([scan(text.as_py() or "") for text in part], _FOUND_ARROW)


def find_secrets(docs: DataFrame, text_col: str = "text", found_out: str = "secrets") -> DataFrame:
    """Add ``secrets`` (replacing a column of that name): kind, start, end, score and name of all findings of each whole text.

    Places are code points, the end exclusive, ordered by start, then kind as in KINDS.  Kinds assign, access and hex are
    fixed patterns with score 1 and no name.  Kind ``literal`` is the value of an assignment, mapping, element, flag or
    login whose name is sensitive, or that reaches such a name through constants of the text, scored by name and value.  Null and
    empty texts have none.  Rows are independent: no shuffle, repeated rows give equal results, an empty table none.
    """
    found = _scanned(docs[text_col].cast("string"))
    kept = [docs[c] for c in docs.columns if c.lower() != found_out.lower()]
    return docs.select(*kept, found.alias(found_out))
