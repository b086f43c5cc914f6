"""Vectorised hashed n-grams of byte texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 20
_MULT, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SEGMENT + 4, _MULT)]), dtype=np.uint64)
_INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SEGMENT + 4, np.uint64(pow(int(_MULT), -1, 2**64)))]), dtype=np.uint64)


def segments(data: bytes) -> Iterator[np.ndarray]:
    """A text in consecutive pieces of a million bytes, so that memory does not follow the longest text."""
    for at in range(0, len(data), SEGMENT):
        yield np.frombuffer(data, np.uint8, min(SEGMENT, len(data) - at), at)


def char_grams(data: np.ndarray, lengths: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each length the bucket (``bits`` bits) of every byte n-gram of ``data``."""
    wide = data.astype(np.uint64) + np.uint64(1)
    rolled, out = wide, []
    for n in range(1, max(lengths) + 1):
        if n > 1:
            if len(rolled) < 2:
                break
            rolled = rolled[:-1] * _MULT + wide[n - 1 :]
        if n in lengths:
            out.append(((rolled * _MIX + np.uint64(n)) * _MIX >> np.uint64(64 - bits)).astype(np.int64))
    return out


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of bytes other than ASCII whitespace."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], dtype=np.uint64)])
    return (sums[end] - sums[start]) * _INVERSES[start] * _MIX


def _long_hash(word: bytes) -> int:
    """What :func:`word_hashes` gives for a single word, of any length."""
    total = 0
    for at in range(0, len(word), SEGMENT):
        part = np.frombuffer(word, np.uint8, min(SEGMENT, len(word) - at), at).astype(np.uint64) + np.uint64(1)
        total += int((part * _POWERS[: len(part)]).sum(dtype=np.uint64)) * pow(int(_MULT), at, 1 << 64)
    return total * int(_MIX) % (1 << 64)


def token_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word: a function of the whole word alone, wherever and beside whatever it stands."""
    out, part, size = [], [], 0

    def close() -> None:
        if part:
            out.append(word_hashes(np.frombuffer(b" ".join(part), np.uint8)))
            part.clear()

    for w in words:
        if size + len(w) >= SEGMENT:
            close()
            size = 0
        if len(w) >= SEGMENT:
            out.append(np.array([_long_hash(w)], np.uint64))
        else:
            part.append(w)
            size += len(w) + 1
    close()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_grams(words: np.ndarray, bits: int) -> list[np.ndarray]:
    """Buckets of single words and of neighbouring pairs."""
    top = np.uint64(64 - bits)
    pairs = (words[:-1] * _MULT + words[1:]) * _MIX
    return [((words + np.uint64(11)) * _MIX >> top).astype(np.int64), ((pairs + np.uint64(12)) * _MIX >> top).astype(np.int64)]


def counted(grams: list[np.ndarray], bits: int) -> np.ndarray:
    """How often each bucket occurs."""
    return np.bincount(np.concatenate(grams), minlength=1 << bits) if grams else np.zeros(1 << bits, np.int64)
