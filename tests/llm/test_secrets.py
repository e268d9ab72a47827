"""Secret scans: base patterns against a plain reading, and what the lexer makes of many syntaxes."""

import hashlib
import random
import re

import pytest

from priorline.llm import queries, secrets

PAIR = 'Rk9!xQ2#vB7z'  # outside the base patterns' characters, so only the lexer can take it whole


def found(text: str) -> list[str]:
    return [text[f["start"] : f["end"]] for f in secrets.scan(text) if f["kind"] == secrets.LITERAL]


@pytest.mark.parametrize(
    "text",
    [
        f'password = "{PAIR}"',
        f"db_password: '{PAIR}'",
        f'{{"user": "ann", "clientSecret": "{PAIR}"}}',
        f'config["smtp"]["passwd"] = "{PAIR}"',
        f'connect(host="db", password="{PAIR}", port=1)',
        f'API_KEY: str = "{PAIR}"',
        f'const secret string = "{PAIR}"',
        f'private static final String ACCESS_KEY = "{PAIR}";',
        f"export AUTH_TOKEN={PAIR}",
        f"  private_key: {PAIR}\n",
        f'<property><password>{PAIR}</password></property>',
        f"run --password {PAIR} --verbose",
        f"postgres://app:{PAIR}@host:5432/db",
        f"Authorization: Bearer {PAIR}",
        f'secret = os.environ.get("APP_SECRET", "{PAIR}")',
        f'password := `{PAIR}`',
        f'if password == "{PAIR}": pass',
        f'token = """{PAIR}"""',
        f'DEFAULT = "{PAIR}"\nlogin_password = DEFAULT\n',
        f'a = "{PAIR}"\nb = a\nc = b\nsecret_token = c',
        f'secret_token = c\nc = b\nb = a\na = "{PAIR}"',
        f'PW="{PAIR}"\nPASSWORD="${{PW}}"',
    ],
)
def test_literal_of_a_sensitive_name(text):
    assert found(text) == [PAIR], secrets.pairs(text)


@pytest.mark.parametrize(
    "text",
    [
        "",
        f'greeting = "{PAIR}"',
        'password = "<your-password>"',
        "password: please enter the one we sent",
        f'password_hint = "{PAIR}"',
        f'token_url = "{PAIR}"',
        'password = os.environ["DB_PASSWORD"]',
        'password = getpass("Password for the account: ")',
        'secret = "${VAULT_SECRET}"',
        'password = "aaaaaaaaaaaa"',
        f'DEFAULT = "{PAIR}"\ncolour = DEFAULT\n',
        "a = b\nb = a\npassword = a",
        "The key to all of it: don't say the token's name = nothing",
        'unclosed = "password = ' + "x" * 50,
    ],
)
def test_no_literal(text):
    assert found(text) == []


def test_joined_parts_are_one_literal():
    text = 'secret = ("Rk9!xQ" +\n  "2#vB7z")'
    assert found(text) == ['Rk9!xQ" +\n  "2#vB7z'] and secrets.scan(text)[0]["score"] > 0.9


def plain_base(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, written out letter by letter and matched on the whole text."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    out = []
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", m.start(), m.end())] if len(m[2]) >= 6 else []
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_query_against_plain_patterns(spark, tmp_path):
    rnd = random.Random(3)
    bits = ["password", "PassWd", "ſecret", "secret", "toKen", "api_key", "APIKEY", "=", " = ", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abcdef", "é", "x", " ", "\n", "+/_", "a1b2c3", "$"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [None, "", 'token = "' + "ab12" * 200_000, f'note\npassword: "{PAIR}"']
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in queries.QUERIES["op13_secret_scans"](spark, str(tmp_path)).collect()))
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        counts = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        want.append((i or 0, *counts, hashlib.sha256(",".join(listed).encode()).hexdigest(), listed))
    # the lexer only adds spans
    assert [(*g[:5], [s for s in g[5].split(",") if s and not s.startswith(secrets.LITERAL)]) for g in got] == sorted(want, key=lambda w: w[:5])


def test_columns_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "token=abcdef123", 5, "x")], "doc_id long, text string, Secrets int, kind string")
    out = secrets.find_secrets(docs)
    assert out.columns == ["doc_id", "text", "kind", "secrets"] and [f.kind for f in out.first().secrets] == ["assign"]
    assert secrets.find_secrets(docs.limit(0)).count() == 0
