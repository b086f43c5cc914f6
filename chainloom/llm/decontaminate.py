"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are joined on shared token seeds (hashes of a few consecutive tokens), of each item
those that are rarest among the items and that a contaminated document cannot all lack.
For every pair whose shared seeds could cover enough of the item, running Karp-Rabin matching marks
the longest common stretches first, without overlap, wherever they stand: a passage whose sentences
were reordered is covered as well as an intact one.  A document is contaminated by an item if the
tiles cover at least ``coverage`` of the item's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows
from chainloom.llm.hashing import token_hashes
from chainloom.storage import settle

#: ASCII letters in lower case, digits, and the bytes of longer characters stay; everything else separates tokens.
TOKENS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEED = 5
COVERAGE = 0.6
#: Up to so many distinct seeds (8 bytes each) go to the executors as a filter; beyond, all document seeds are joined.
FILTER_SEEDS = 4_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TOKENS).split()


def seeds(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` consecutive tokens."""
    n = len(hashes) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for i in range(width if n > 0 else 0):
        out = (out ^ hashes[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _running(row: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of every ``least`` numbers: differences of one running sum, brought to one power."""
    row = (row.astype(np.uint64) + np.uint64(1)) * _STEP
    up, down = (np.cumprod(np.full(len(row), x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(row * down, dtype=np.uint64)])
    return (sums[least:] - sums[:-least]) * up[least - 1 :]


def _matches(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, length)`` of the common stretches of ``least`` or more that can be extended neither way.

    Equal windows are met ``_MEET`` pairs at a time, and only those are kept that begin or end a stretch; along a diagonal
    beginnings and ends alternate, so they pair up in order.  No pair is walked token by token.
    """
    none = np.zeros(0, np.int64)
    if min(len(a), len(b)) < least:
        return none, none, none
    mine, other = _running(a, least), _running(b, least)
    order = np.argsort(mine, kind="stable").astype(np.int32)
    mine = mine[order]
    left = np.searchsorted(mine, other)
    counts = np.searchsorted(mine, other, "right") - left
    some = np.flatnonzero(counts)
    upto = np.concatenate([[0], np.cumsum(counts[some])])
    before_a, before_b = np.concatenate([[-1], a]), np.concatenate([[-2], b])  # what stands before the window at a place
    after_a, after_b = np.concatenate([a[least:], [-1]]), np.concatenate([b[least:], [-2]])  # and after it
    ends: list[list[np.ndarray]] = [[], []]
    low = 0
    while low < len(some):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + _MEET, "right")) - 1)
        take = some[low:high]
        j = np.repeat(take.astype(np.int32), counts[take])
        i = order[np.arange(len(j)) + np.repeat(left[take] - upto[low:high] + upto[low], counts[take])]
        for side, edge in enumerate((before_a[i] != before_b[j], after_a[i] != after_b[j])):
            x, y = i[edge].astype(np.int64), j[edge].astype(np.int64)
            real = np.ones(len(x), bool)
            for t in range(least):
                real &= a[x + t] == b[y + t]
            ends[side].append(np.stack([y - x, x])[:, real])
        low = high
    first, last = (np.concatenate(e, axis=1) if e else np.zeros((2, 0), np.int64) for e in ends)
    first, last = (e[:, np.lexsort((e[1], e[0]))] for e in (first, last))
    return first[1], first[0] + first[1], last[1] - first[1] + least


#: Base of the running hashes (odd, so it has an inverse); pairs of equal windows looked at together.
_BASE, _MEET = 0x9E3779B97F4A7C15, 1 << 20


def tile(item: list, runs: list[list], least: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling: ``(item position, run, position in run, length)``, longest first.

    Every token of the item and of the runs belongs to one tile at most; no tile is shorter than ``least``.  Running
    Karp-Rabin hashes of ``least`` tokens find where matches start and end.  The
    longest match left is marked next, ties by place; one that marked tiles overlap comes back as the stretches
    that are still free.  So the tiles do not depend on how much else the runs hold.  It ends when no ``least`` tokens of the item are free.
    """
    number = {t: i + 1 for i, t in enumerate(dict.fromkeys(item))}
    a, b = np.array([number[t] for t in item], np.int64), [np.array([number.get(t, 0) for t in r], np.int64) for r in runs]
    heap: list[tuple[int, int, int, int]] = []
    for r, row in enumerate(b):
        i, j, n = _matches(a, row, least)
        heap += zip((-n).tolist(), i.tolist(), [r] * len(i), j.tolist(), strict=True)
    heapify(heap)
    free_item, free_runs, left = np.ones(len(a), bool), [np.ones(len(r), bool) for r in b], len(a)
    found: list[tuple[int, int, int, int]] = []
    while heap and left >= least:
        n, i, r, j = heappop(heap)
        n = -n
        free = free_item[i : i + n] & free_runs[r][j : j + n]
        if free.all():
            free_item[i : i + n], free_runs[r][j : j + n], left = False, False, left - n
            found.append((i, r, j, n))
        elif free.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))).tolist()
            for start, end in zip(edges[::2], edges[1::2], strict=True):
                if end - start >= least:
                    heappush(heap, (start - end, i + start, r, j + start))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = SEED) -> DataFrame:
    """``(doc_id, item_id, n_tokens, covered, tiles, coverage)`` for every contaminated pair.

    ``docs`` is ``(doc_id, text, ...)``, ``benchmark`` ``(item_id, text, ...)``; other columns are ignored.  Items
    of fewer than ``width`` tokens match as a whole; items without tokens and documents without text
    match nothing.  Repeated rows, and rows with null ids, are judged one by one and give a row each.
    Documents are read once; what is shuffled are seed hits and the token runs around them.
    """
    return _findings(docs, benchmark, coverage, width).select("doc_id", "item_id", "n_tokens", "covered", "tiles", (F.col("covered") / F.col("n_tokens")).alias("coverage"))


def _row_key() -> Column:
    """Tells documents apart; with doc_id it names a row (equal rows share their findings)."""
    return F.xxhash64("doc_id", "text")


def _findings(docs: DataFrame, benchmark: DataFrame, coverage: float, width: int) -> DataFrame:
    """``(doc_id, doc, item_id, n_tokens, covered, tiles)``: contaminated pairs, ``doc`` being the row's key."""
    named = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text")
    items = settle(map_rows(named, lambda c: _item_rows(c, width), "item_id long, item long, n int, width int, words binary, seeds array<long>"), "items")
    entries = settle(items.select("item", "n", "width", F.posexplode("seeds").alias("pos", "seed")).distinct(), "item_seeds")
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most ``width`` values
    known, distinct = None, entries.select("seed").distinct()
    if distinct.count() <= FILTER_SEEDS:
        known = np.sort(distinct.toArrow()["seed"].to_numpy())
    rows = docs.select("doc_id", _row_key().alias("doc"), "text")
    hits = settle(map_rows(rows, lambda c: _run_rows(c, widths, known), "doc_id long, doc long, runs array<binary>, seeds array<long>"), "seed_hits")
    pairs = hits.select("doc", F.explode("seeds").alias("seed")).join(_telling(entries, coverage), "seed").select("doc", "item").distinct()
    texts = items.select("item", "n", "width", "words").distinct()
    both = hits.select("doc_id", "doc", "runs").join(pairs, "doc").join(texts, "item")  # a row per pair: no list grows with the items of a document
    tiled = map_rows(both, lambda c: _tile_rows(c, coverage), "doc_id long, doc long, item long, covered int, tiles int")
    return tiled.join(items.select("item_id", "item", F.col("n").alias("n_tokens")), "item")


def _telling(entries: DataFrame, coverage: float) -> DataFrame:
    """``(item, seed)``: of each item the seeds that a contaminated document cannot all lack, the rarest among the items.

    A document that covers enough of an item shares at least n * coverage / width of its positions, so it shares one of any set that leaves
    fewer out.  Seeds of a template that many items have are those left out, as far as their items have others.
    """
    spread = entries.groupBy("seed").agg(F.count_distinct("item").alias("items"))
    # the positions of one item, which one row held before
    ranked = entries.join(spread, "seed").withColumn("at", F.row_number().over(W.partitionBy("item", "n", "width").orderBy("items", "pos")))
    needed = F.greatest(F.ceil(F.col("n") * F.lit(coverage) / F.col("width") - 1e-9), F.lit(1))
    return ranked.where(F.col("at") <= F.col("n") - F.col("width") + 1 - needed + 1).select("item", "seed").distinct()


def _item_rows(c: dict, width: int):
    for item_id, item, text in zip(c["item_id"], c["item"], c["text"], strict=True):
        if words := tokens(text):
            k = min(width, len(words))
            yield item_id, item, len(words), k, b" ".join(words), seeds(token_hashes(words), k).tolist()


def _run_rows(c: dict, widths: list[int], known: np.ndarray | None):
    for doc_id, doc, text in zip(c["doc_id"], c["doc"], c["text"], strict=True):
        words = tokens(text)
        hashes, near, found = token_hashes(words), np.zeros(len(words) + 1, np.int64), []
        for k in widths:
            got = seeds(hashes, k)
            if known is not None and len(known):
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, got), len(known) - 1)] == got)
            else:
                at = np.arange(len(got))
            found.append(got[at])
            np.add.at(near, at, 1)
            np.add.at(near, at + k, -1)
        if sum(map(len, found)):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(near) > 0]).astype(np.int8)))
            runs = [b" ".join(words[s:e]) for s, e in zip(edges[::2].tolist(), [*edges[1::2].tolist(), len(words)], strict=False)]
            yield doc_id, doc, runs, np.unique(np.concatenate(found)).tolist()


def _tile_rows(c: dict, coverage: float):
    for doc_id, doc, runs, item, n, width, text in zip(*(c[k] for k in ("doc_id", "doc", "runs", "item", "n", "width", "words")), strict=True):
        words, parts = text.split(), list(map(bytes.split, runs))
        shared = np.isin(seeds(token_hashes(words), width), np.concatenate([seeds(token_hashes(r), width) for r in parts]))
        if shared.sum() * width < coverage * n:
            continue
        wanted = set(words)
        tiles = tile(words, [r for r in parts if not wanted.isdisjoint(r)], width)
        covered = sum(t[3] for t in tiles)
        if covered >= coverage * n:
            yield doc_id, doc, item, covered, len(tiles)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated rows, judged row by row: rows of one doc_id, or of none, go or stay each by its own text.

    Repeated rows go together.  Empty tables, empty texts and a benchmark without items leave ``docs`` as it is.
    """
    found = settle(_findings(docs, benchmark, coverage, SEED).select("doc_id", "doc").distinct(), "contaminated")
    other = found.select(F.col("doc_id").alias("__found_id"), F.col("doc").alias("__found"))
    on = F.xxhash64(docs["doc_id"], docs["text"]).eqNullSafe(F.col("__found")) & docs["doc_id"].eqNullSafe(F.col("__found_id"))
    return docs.join(other, on, "left_anti")
