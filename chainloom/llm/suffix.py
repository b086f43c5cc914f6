"""Removal of repeated byte strings with an enhanced suffix array per bucket.

A window is 200 bytes.  Windows that share a minimising 16-byte piece travel as one string to that
piece's bucket.  There the distinct strings form a suffix array with common prefixes; a stack scan
turns it into the tree of common-prefix intervals, and every interval whose occurrences differ in
the byte before them is a maximal repeat, given with all its occurrences.  Strings that occur as
they are more than once need no array: all their windows are repeats.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm import buckets as B
from chainloom.llm.hashing import _INVERSES, _MIX, _POWERS
from chainloom.storage import settle

WINDOW, PIECE = 200, 16
#: Super-strings per bucket, and bytes of distinct strings in one suffix array.
BUCKET_STRINGS, ARRAY_BYTES = 20_000, 1 << 20


def cut(text: str | None) -> Iterator[tuple]:
    data = (text or "").encode("utf-8", "surrogatepass")
    total = len(data) - WINDOW + 1
    for at in range(0, total, B.SEGMENT_WINDOWS):
        part = data[at : at + min(B.SEGMENT_WINDOWS, total - at) + WINDOW - 1]
        raw = np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * _POWERS[: len(raw)], dtype=np.uint64)])
        n = len(raw) - PIECE + 1
        pieces = (sums[PIECE:] - sums[:n]) * _INVERSES[:n] * _MIX
        pieces = (pieces ^ (pieces >> np.uint64(32))) * _MIX
        first, count, piece = B.minimisers(pieces, WINDOW - PIECE + 1)
        yield part, first, first + count + WINDOW - 1, first + at, count, piece - first, pieces[piece]


#: Prefix lengths at which ranks are taken, each at most twice the one before; the last is no shorter than any string.
DEPTHS = (4, 8, 16, 32, 64, 128, 256, 384)


def ranks(codes: np.ndarray, depths: tuple[int, ...] = DEPTHS, keep: bool = True) -> dict[int, np.ndarray]:
    """For each depth (or only the last) the rank of every position's prefix of that length; positions past the end rank lowest."""

    def ahead(row: np.ndarray, shift: int) -> np.ndarray:
        return np.concatenate([row[shift:], np.full(min(shift, len(row)), -1, np.int64)]) + 1

    bits = int(codes.max() + 1).bit_length()
    keys, found, depth = ahead(codes, 0), {}, 0
    for i in range(1, 4):
        if bits * (i + 1) > 62:
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            keys = keys * np.int64(int(codes.max()) + 2) + ahead(codes, i)
        else:
            keys = keys << bits | ahead(codes, i)
    for d in depths:
        if depth:
            keys = found[depth] * np.int64(len(codes) + 2) + ahead(found[depth], d - depth)
            if not keep:
                found = {}
        found[d], depth = np.unique(keys, return_inverse=True)[1].astype(np.int64), d
    return found


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as one row of codes, each ending in a separator of its own; and the separators' places."""
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    codes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + len(strings)
    codes[ends] = np.arange(len(strings))
    return codes, ends


def enhanced_array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text codes, suffix array in the order of the first 384 symbols, and neighbours' common prefixes.

    Every string ends in a separator of its own, so no common prefix leaves a string, and none here is longer
    than 384 bytes.
    """
    codes, _ = _joined(strings)
    level = ranks(codes)
    order = np.argsort(level[DEPTHS[-1]], kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(i), np.int64)
    for d, row in [*((d, level[d]) for d in (256, 128, 64, 32, 16, 8, 4)), *[(1, codes)] * 3]:
        row = np.append(row, [-1, -2])  # past the end nothing is equal
        same = (row[np.minimum(i, len(codes))] == row[np.where(j < len(codes), j, len(codes) + 1)]) * d
        common, i, j = common + same, i + same, j + same
    return codes, order, common


def maximal_repeats(codes: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, occurrences)`` of every maximal repeat of at least ``least`` symbols.

    One pass with a stack over the common prefixes closes the intervals of the prefix tree from the
    deepest up; an interval whose occurrences all follow the same symbol is part of a longer repeat
    and is passed over.
    """
    at = np.flatnonzero(common >= least)
    if not len(at):
        return
    before = np.where(order > 0, codes[order - 1], -1)
    turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]).tolist()  # neighbours in the array that follow different symbols
    for stretch in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        base = int(stretch[0])
        stack: list[tuple[int, int]] = []
        for k, depth in enumerate([*common[stretch].tolist(), 0], base):
            low = k
            while stack and stack[-1][0] > depth:
                length, low = stack.pop()
                if turns[k] > turns[low]:
                    yield length, order[low : k + 1]
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, low))


def _candidates(group: list[int], texts: list[bytes], places: np.ndarray) -> list[int]:
    """Strings that can share a window with another one: a common window holds the piece and reaches at
    least (WINDOW - PIECE) / 2 bytes to its left or to its right."""
    reach = (WINDOW - PIECE) // 2
    sides = []
    for s, p in ((texts[k], int(places[k])) for k in group):
        sides.append((s[p - reach : p + PIECE] if p >= reach else None, s[p : p + PIECE + reach] if len(s) >= p + PIECE + reach else None))
    left, right = Counter(a for a, _ in sides if a), Counter(b for _, b in sides if b)
    return [k for k, (a, b) in zip(group, sides, strict=True) if (a and left[a] > 1) or (b and right[b] > 1)]


def repeats_by_rank(strings: list[bytes]) -> list[np.ndarray]:
    """Marks of the windows that occur again, for a family too large for the interval tree: the ranks of the
    suffix array at the depth of a window, without common prefixes (some 40 bytes a symbol)."""
    codes, _ = _joined(strings)
    rank = ranks(codes, (*DEPTHS[:-2], WINDOW), keep=False)[WINDOW]
    ends = np.cumsum([len(s) + 1 for s in strings])
    sizes = np.array([len(s) - WINDOW + 1 for s in strings], np.int64)
    at = B.spread(rank, np.concatenate([[0], ends[:-1]]).astype(np.int64), sizes)
    _, inverse, counts = np.unique(at, return_inverse=True, return_counts=True)
    return np.split(counts[inverse] > 1, np.cumsum(sizes)[:-1])


def mark_repeats(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The windows of one bucket that start in two or more places."""
    strings, c = B.unpack(blobs)
    _, inverse, heads = np.unique(c["low"], return_inverse=True, return_counts=True)
    rows = np.flatnonzero(heads[inverse] > 1)
    if not len(rows):
        return
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(strings[i], len(number)) for i in rows.tolist()), np.int64, len(rows))
    texts, times = list(number), np.bincount(kind)
    one = np.zeros(len(texts), np.int64)
    one[kind] = rows
    groups: dict[int, list[int]] = {}
    for k, low in enumerate(c["low"][one].tolist()):
        groups.setdefault(low, []).append(k)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) - WINDOW + 1
    starts = np.cumsum(sizes) - sizes
    flags = np.repeat(times > 1, sizes)
    held: list[int] = []
    marked: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for group in [*groups.values(), None]:
        if group is not None and len(group) > 1:
            found = _candidates(group, texts, c["place"][one])
            weight = int(sizes[found].sum()) + WINDOW * len(found)
            if weight > 8 * ARRAY_BYTES:
                for k, again in zip(found, repeats_by_rank([texts[k] for k in found]), strict=True):
                    flags[starts[k] : starts[k] + sizes[k]] |= again
                found, weight = [], 0
            held += found
            size += weight
        if held and (group is None or size >= ARRAY_BYTES):
            mine = np.array(held)
            begin = np.cumsum(sizes[mine] + WINDOW) - sizes[mine] - WINDOW
            codes, order, common = enhanced_array([texts[k] for k in held])
            found = list(maximal_repeats(codes, order, common, WINDOW))
            if found:
                where = np.concatenate([w for _, w in found])
                length = np.repeat([n for n, _ in found], [len(w) for _, w in found])
                owner = np.searchsorted(begin, where, "right") - 1
                at = starts[mine[owner]] + where - begin[owner]
                marked.append((at, at + length - WINDOW + 1))
            held, size = [], 0
    if marked:
        opened, closed = (np.bincount(np.concatenate(c), minlength=len(flags) + 1) for c in zip(*marked, strict=True))
        flags |= np.cumsum(opened - closed)[:-1] > 0
    flat = B.spread(flags, starts[kind], sizes[kind])
    yield B.runs_of(c["doc"][rows], c["row"][rows], c["first"][rows], sizes[kind], flat)


#: Into so many families a hot minimiser's windows are dealt, by how far they reach to its left; those of a family share all but 184 / PARTS bytes.
PARTS = 8


def _families(classes: DataFrame) -> DataFrame:
    """Repeated windows of hot distinct super-strings, ``(id, first, count)``.

    A window that holds the piece with so many bytes before it shares at least the fewest such bytes, the piece and
    what must follow with every equal window; that context names its family, which meets in a bucket and
    goes through the suffix array like any other.
    """
    buckets = max(8, PARTS * classes.count() // BUCKET_STRINGS)
    steps = np.linspace(0, WINDOW - PIECE + 1, PARTS + 1).astype(int).tolist()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for name, string, least, n, place in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for few, most in zip(steps, steps[1:], strict=False):  # windows with few..most - 1 bytes before the piece
                    low, high = max(0, place - most + 1), min(n, place - few + 1)
                    if low < high:
                        key = xxhash.xxh64_intdigest(string[place - few : place - most + 1 + WINDOW], few)
                        held.append((least, name, low, high - low, place - low, key, string[low : high + WINDOW - 1]))
                if len(held) > 50_000:
                    yield packed(held)
                    held = []
            if held:
                yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.array(c) for c in list(zip(*held, strict=True))[:5]]
        low, texts = np.array([h[5] for h in held], np.uint64), [h[6] for h in held]
        return B.pack_strings(*columns, low, texts, buckets)

    marks = B.by_bucket(classes.select("id", "string", "least", "windows", "place").mapInArrow(dealt, "bucket int, blob binary"), buckets, mark_repeats, B.RUNS)
    return marks.select(F.col("row").alias("id"), "first", "count")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc, row, runs)``: runs of windows that also start somewhere else."""
    return B.marked_windows(docs, cut, BUCKET_STRINGS, mark_repeats, _families, F.col("n") > 1, across=False)


def _kept(doc_id: int | None, text: str | None, runs: list[tuple[int, int]]) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    gone = np.zeros(len(data) + 1, bool)
    for first, count in runs:
        gone[first : first + count + WINDOW - 1] = True
    gone[-1] = False
    kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes() if runs else data
    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary])``, one row per row of ``docs``.

    Each byte covered by a 200-byte string that also starts anywhere else, in the same text or another,
    goes; strings are judged on the input and never cross texts.  What is kept may start or end
    inside a character, hence bytes.  Null texts are empty; repeated rows repeat each other; null ids
    and other columns do no harm.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    marks = settle(repeated_windows(docs), "repeats")
    if with_bytes:
        return B.with_runs(docs, marks, _kept, schema + ", kept binary")
    return B.with_runs(docs, marks, lambda *a: _kept(*a)[:-1], schema)
