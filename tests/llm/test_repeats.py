import hashlib
import random

import numpy as np
import pytest

from chainloom.llm import buckets, hashing, substring, suffix


def words_brute(rows):
    first = {}
    texts = [(buckets.NULL_ID if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    out = []
    for (d, w), (doc_id, _) in zip(texts, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((str(doc_id), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def bytes_brute(rows):
    seen, texts = {}, [(t or "").encode() for _, t in rows]
    for b in texts:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    out = []
    for b, (doc_id, _) in zip(texts, rows, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        gone[-1] = 0
        out.append((str(doc_id), len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(8)
    base = [prose(300, s).split() for s in range(4)]
    out = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            at = rng.randrange(200)
            parts += b[at : at + rng.randrange(5, 120)]
            if rng.random() < 0.5:
                parts.append(f"only{i}")
        out.append((i, " ".join(parts)))
    out += [(90, None), (91, ""), (92, "a " * 300), (93, "é" * 250), (94, "x" * 700), (95, " ".join(base[0])), (96, " ".join(base[0])), (96, " ".join(base[0])), (96, " ".join(base[1])), (None, " ".join(base[2])), (None, " ".join(base[2]))]
    return out


@pytest.mark.parametrize("hot,pack", [(200_000, 1_000), (3, 1_000), (200_000, 1)])  # the others send nearly every group down the way of hot minimisers
def test_word_windows_match_brute_force(make, rows, hot, pack, monkeypatch):
    monkeypatch.setattr(buckets, "HOT", hot)
    monkeypatch.setattr(buckets, "PACK_HOT", pack)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(make(rows), with_text=False).collect())
    assert got == words_brute(rows)


@pytest.mark.parametrize("hot,pack", [(200_000, 1_000), (3, 1_000), (200_000, 1)])
def test_byte_strings_match_brute_force(make, rows, hot, pack, monkeypatch):
    monkeypatch.setattr(buckets, "HOT", hot)
    monkeypatch.setattr(buckets, "PACK_HOT", pack)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(make(rows), with_bytes=False).collect())
    assert got == bytes_brute(rows)


@pytest.mark.parametrize("length", [600_000, 1_100_000])
def test_very_long_words_are_hashed_whole(make, length):
    """A window with one huge word, alone and inside a longer text, on both sides of a segment."""
    long = "w" * length
    window = [f"a{i}" for i in range(6)] + [long] + [f"b{i}" for i in range(6)]
    other = [*window[:6], long[:-1] + "x", *window[7:]]
    rows = [(1, " ".join(window)), (2, " ".join(["start"] * 40 + window + ["end"] * 40)), (3, " ".join(other)), (4, " ".join(window))]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(make(rows), with_text=False).collect())
    assert got == words_brute(rows) and [g[2] for g in got] == [0, 13, 0, 13]
    alone, inside = (hashing.token_hashes(t.split(b" ")) for t in (long.encode(), b"x y " + long.encode() + b" z"))
    assert alone[0] == inside[2]


def test_large_families_go_by_rank(make, rows, monkeypatch):
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 10)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(make(rows), with_bytes=False).collect())
    assert got == bytes_brute(rows)


def test_ranks_of_many_codes():
    codes = np.random.default_rng(1).integers(0, 1 << 20, 3000)
    text = codes.tolist()
    order = np.argsort(suffix.ranks(codes)[384], kind="stable")
    assert [text[i : i + 384] for i in order] == sorted(text[i : i + 384] for i in range(len(text)))


def test_empty_table(make):
    assert substring.remove_repeats(make([])).count() == 0 and suffix.remove_repeats(make([])).count() == 0


def test_segments_do_not_change_the_cut(prose, monkeypatch):
    text = prose(900, 1)
    whole = [(c[0][s:e], int(f), int(n)) for c in substring.cut(text) for s, e, f, n in zip(c[1], c[2], c[3], c[4], strict=True)]
    monkeypatch.setattr(buckets, "SEGMENT_WINDOWS", 100)
    pieces = [(c[0][s:e], int(f), int(n)) for c in substring.cut(text) for s, e, f, n in zip(c[1], c[2], c[3], c[4], strict=True)]
    covered = lambda cut: [w for s, f, n in cut for w in substring.windows(s, n)]
    assert covered(whole) == covered(pieces)


def test_maximal_repeats_are_maximal():
    codes, order, common = suffix.enhanced_array([b"xabcdey", b"zabcdew", b"abcd"])
    found = sorted((n, sorted(w.tolist())) for n, w in suffix.maximal_repeats(codes, order, common, 3))
    assert found == [(4, [1, 9, 16]), (5, [1, 9])]
