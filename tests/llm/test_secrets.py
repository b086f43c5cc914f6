import hashlib
import random
import re

from chainloom.llm import secrets

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def brute(text):
    spans = [(m.start(), list(BASE).index(k), f"{k}:{m.start()}:{m.end()}", k) for k, (rx, ok) in BASE.items() for m in rx.finditer(text or "") if ok(m)]
    return [s[2] for s in sorted(spans)], [s[3] for s in sorted(spans)]


def test_base_spans_match_plain_expressions(make):
    rng = random.Random(1)
    pieces = ["password", "PassWord = ", "secret:", "token='", "api_key: ", "apikey=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "ſecret=", "İ", " ", "\n", '"', "=", "abcdefgh", "x", "toKen=abc", "K"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(150)] + [(900, None), (901, ""), (None, "token=abcdefghi"), (902, "a" * 100_000 + "secret = abcdefgh1")]
    got = {r.doc_id: r for r in secrets.span_digests(secrets.scan_secrets(make(rows))).collect()}
    for doc_id, text in rows:
        spans, kinds = brute(text)
        r = got[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(filter(None, r.spans.split(","))) >= set(spans)
    assert secrets.scan_secrets(make([])).count() == 0


def test_checksums_decide():
    body = "aB3" * 10
    good = f"ghp_{body}{secrets.base62_crc(body)}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert [s[2] for s in secrets.find_secrets(f"see {good} and {bad}")] == ["github"]
    assert [s[2] for s in secrets.find_secrets("eyJhbGciOiJIUzI1NiJ9.e30.x eyJxxxx.e30.x")] == ["jwt"]
    assert secrets.redact("a token = abcdefgh b", secrets.find_secrets("a token = abcdefgh b")) == "a [assign] b"


def test_redaction_keeps_rows_and_columns(make):
    rows = [(1, "clean"), (2, "x secret=abcdefghij y"), (None, None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact_secrets(make(rows)).collect()}
    assert out == {1: ("clean", 5), 2: ("x [assign] y", 12), None: (None, 0)}


def test_header_tokens_start_at_an_edge():
    import base64

    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    kinds = lambda text: [k for _, _, k in secrets.find_secrets(text)]
    assert kinds(f"({head}.abc.def)") == ["jwt"] and kinds(f"x{head}.abc.def") == []
    assert kinds("eyJ" * 300_000) == []  # one long run without a dot
