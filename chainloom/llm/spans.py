"""Words of whole Arrow text columns as byte spans, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chainloom.llm.hashing import _INVERSES, _MIX, _POWERS, SEGMENT, _long_hash

GAP = 32


def byte_table(gaps: bytes) -> np.ndarray:
    """Per byte what stands for it: A-Z in lower case, every byte of ``gaps`` as the same gap."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[np.frombuffer(gaps, np.uint8)] = GAP
    return table


def word_spans(texts: pa.Array, table: np.ndarray, at_once: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(data, start, end, row)``: translated bytes, the word spans in them, and the row that each word is of.

    A piece has ``at_once`` bytes at most and ends between words, so consecutive pieces hold consecutive words; only a
    word longer than that is a piece of its own.  Nulls are texts without words.
    """
    raw = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    values = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    at, top = (int(offsets[0]), int(offsets[-1])) if len(raw) else (0, 0)
    while at < top:
        to = min(at + at_once, top)
        if to < top:
            gaps = np.flatnonzero(table[values[at:to]] == GAP)
            edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            last = max(edge, at + int(gaps[-1]) + 1 if len(gaps) else at)
            to = last if last > at else _word_end(values, table, to, int(offsets[np.searchsorted(offsets, to, "right")]), at_once)
        data = table[values[at:to]]
        solid = np.concatenate([[False], data != GAP, [False]])
        edges = np.zeros(len(data) + 1, bool)
        edges[offsets[(offsets >= at) & (offsets <= to)] - at] = True
        start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edges[:-1]))
        end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edges[1:])) + 1
        yield data, start, end, np.searchsorted(offsets, start + at, "right") - 1
        at = to


def _word_end(values: np.ndarray, table: np.ndarray, at: int, top: int, step: int) -> int:
    for probe in range(at, top, step):
        gaps = np.flatnonzero(table[values[probe : min(probe + step, top)]] == GAP)
        if len(gaps):
            return probe + int(gaps[0])
    return top


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, a function of its bytes alone."""
    if len(data) > SEGMENT:  # one long word
        return np.array([_long_hash(data[s:e].tobytes()) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], dtype=np.uint64)])
    return (sums[end] - sums[start]) * _INVERSES[start] * _MIX
