"""Exact substring dedup of word windows over super-k-mers.

A window is 13 consecutive words.  Consecutive windows with the same minimising run of four words travel
as one packed string to the bucket of that run; there the windows are sorted, equal ones lie side by
side, and each group yields the smallest document in which the window starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm import buckets as B
from chainloom.llm.hashing import SEGMENT, token_hashes, word_hashes
from chainloom.storage import settle

WINDOW, PIECE = 13, 4
#: Super-strings per bucket, which a task holds at once.
BUCKET_STRINGS = 60_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def cut(text: str | None) -> Iterator[tuple]:
    words = words_of(text)
    total = len(words) - WINDOW + 1
    for at in range(0, total, B.SEGMENT_WINDOWS):
        part = words[at : at + min(B.SEGMENT_WINDOWS, total - at) + WINDOW - 1]
        line = b" ".join(part)
        h = word_hashes(np.frombuffer(line, np.uint8)) if len(line) <= SEGMENT else token_hashes(part)
        n = len(h) - PIECE + 1
        pieces = h[:n]
        for i in range(1, PIECE):
            pieces = (pieces ^ (pieces >> np.uint64(31))) * _MIX + h[i : i + n]
        pieces = (pieces ^ (pieces >> np.uint64(29))) * _MIX
        first, count, piece = B.minimisers(pieces, WINDOW - PIECE + 1)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        yield line, starts[first], ends[first + count + WINDOW - 2] - 1, first + at, count, piece - first, pieces[piece]


def windows(string: bytes, count: int) -> list[bytes]:
    words = string.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(count)]


def window_least(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string, one after the other, the smallest ``least`` of the strings that hold it; and the windows per string.

    Words are numbered, runs of words ranked by doubling (pairs, fours, eights, then two eights that overlap
    to a window), and the windows sorted by that rank: equal windows lie side by side, nothing is hashed.
    """
    words = b" ".join(strings).split(b" ")
    sizes = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    width = 1
    while 2 * width <= WINDOW:
        rank, width = _ranked(rank[:-width], rank[width:]), 2 * width
    counts = np.maximum(sizes - WINDOW + 1, 0)
    at = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    key = rank[at] * np.int64(len(words) + 1) + rank[at + WINDOW - width]
    order = np.argsort(key)
    sorted_key, owner = key[order], np.repeat(least, counts)[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])[: len(order)])
    found = np.empty(len(order), np.int64)
    if len(order):
        found[order] = np.repeat(np.minimum.reduceat(owner, edges), np.diff(np.append(edges, len(order))))
    return found, counts


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of every pair ``(a, b)``: equal pairs, equal ranks."""
    key = a * np.int64(int(b.max(initial=0)) + 1) + b
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])[: len(key)])
    return out


def count_windows(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The windows of one bucket that also start in a smaller document."""
    strings, c = B.unpack(blobs)
    doc = c["doc"]
    _, inverse, heads = np.unique(c["low"], return_inverse=True, return_counts=True)
    rows = np.flatnonzero(heads[inverse] > 1)
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(strings[i], len(number)) for i in rows.tolist()), np.int64, len(rows))
    if not len(rows):
        return
    least = np.full(len(number), B.NULL_ID)
    np.minimum.at(least, kind, doc[rows])
    found, counts = window_least(list(number), least)
    sizes = counts[kind]
    flat = B.spread(found, (np.cumsum(counts) - counts)[kind], sizes) < np.repeat(doc[rows], sizes)
    yield B.runs_of(doc[rows], c["row"][rows], c["first"][rows], sizes, flat)


def _families(classes: DataFrame) -> DataFrame:
    """Windows of hot distinct super-strings that a smaller document also holds; Spark groups the windows themselves."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, string, least, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(windows(string, n), pa.binary()), pa.array([least] * n, pa.int64())], ["id", "first", "window", "least"])

    each = classes.select("id", "string", "least", "windows").mapInArrow(cut_up, "id long, first int, window binary, least long")
    low = settle(each.groupBy("window").agg(F.min("least").alias("smallest")), "hot_windows")
    return each.join(low, "window").where("smallest < least").select("id", "first", F.lit(1).alias("count"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc, row, runs)``: runs of windows that also start in a document of smaller id."""
    return B.marked_windows(docs, cut, BUCKET_STRINGS, count_windows, _families, F.col("least") < F.col("doc"), across=True)


def _kept(doc_id: int | None, text: str | None, runs: list[tuple[int, int]]) -> tuple:
    words = words_of(text)
    gone = np.zeros(len(words), bool)
    for first, count in runs:
        gone[first : first + count + WINDOW - 1] = True
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if runs else words)
    return doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])``, one row per row of ``docs``.

    Each word covered by a window whose words also start in a document of smaller doc_id goes; windows
    are judged on the input.  Null and short texts lose nothing.  A null doc_id counts as larger than
    any other; rows of one doc_id do not remove from each other.  Whole texts are read; other
    columns are ignored.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        return B.with_runs(docs, settle(repeated_windows(docs), "repeats"), _kept, schema + ", kept string")
    return B.with_runs(docs, settle(repeated_windows(docs), "repeats"), lambda *a: _kept(*a)[:-1], schema)
