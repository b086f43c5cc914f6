"""Secret scan: keyword automaton, anchored expressions at its hits, embedded checksums.

One Aho-Corasick pass over the ASCII-lower-cased text finds every keyword; an expression is tried only
at a hit.  Tokens that carry a checksum or a decodable header count only if it verifies.  Long
hexadecimal runs have no keyword and are found by one expression over the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows

#: Span kinds in the order that breaks ties of equal starts; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = 3
#: Keyword (as it reads in lower case) and the kind whose expression is tried there.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
EXPRESSIONS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"),
    "pem": re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----"),
}
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of the token body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(6, "0")


def holds(kind: str, m: re.Match) -> bool:
    """The length rule or the embedded check of a kind."""
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except (ValueError, binascii.Error):
            return False
        return isinstance(head, dict) and "alg" in head
    return True


def automaton():
    """The keyword machine; built per batch of rows, so that nothing but code travels to the workers."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find_secrets(text: str | None, machine=None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start, then by kind; per kind leftmost without overlap."""
    if not text:
        return []
    machine = machine or automaton()
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, free = [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)], dict.fromkeys(KINDS, 0)
    for start, kind in sorted((end - n + 1, kind) for end, (n, kind) in machine.iter(low)):
        if start >= free[kind] and (m := EXPRESSIONS[kind].match(text, start)):
            free[kind] = m.end()
            if holds(kind, m):
                found.append((start, m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every covered stretch replaced by the kind of its first span."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans array<struct<start, end, kind>>)``, one row per row of ``docs``.

    Narrow: no shuffle, each text is read whole and on its own.  Null and empty texts have no spans;
    null ids, repeated rows and empty tables pass through.  Columns besides doc_id and text are ignored.
    """

    def rows(c):
        machine = automaton()
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            yield doc_id, [{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(text, machine)]

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, spans array<struct<start: int, end: int, kind: string>>")


def redact_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by ``[kind]``; rows and columns stay.

    A ``length`` column of an integer type is brought up to date where the text changed; one of another type, or
    none at all, is left alone.  Null and empty texts, null ids, repeated rows and empty tables pass through.
    """
    names = docs.columns
    at = names.index(text)
    counts = names.index(length) if length in names and docs.schema[length].dataType.typeName() in ("long", "integer") else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            columns = list(batch.columns)
            texts, changed = columns[at].to_pylist(), {}
            for i, value in enumerate(texts):
                if spans := find_secrets(value, machine):
                    changed[i] = redact(value, spans)
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                if counts is not None:
                    columns[counts] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[counts].to_pylist())], columns[counts].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(keep, docs.schema)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as ``kind:start:end`` text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """The base digest of one text, as the query gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in KINDS[:BASE]).encode()).hexdigest()
