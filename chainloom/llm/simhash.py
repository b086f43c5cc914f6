"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints meet in buckets: tables keyed by parts of the fingerprint.  Inside a task the bucket's
fingerprints are stored as vertical bit planes, 64 fingerprints to a machine word; a query adds
plane by plane into carry-save counters, so one word operation advances 64 distances, and a word is
abandoned as soon as all its lanes exceed the radius.  A task hands on a spanning forest of the
links it finds, never all pairs.

For a small radius the tables are combinations of bit blocks chosen so that any two fingerprints
within the radius agree on one whole key: no link is lost.  For a large radius (fuzzy matching) the
tables are seeded random bit subsets sized for a documented miss rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows
from chainloom.operators.components import connected_components
from chainloom.storage import settle

#: Fingerprints that one task compares at once; larger buckets are split into pairs of chunks.
CHUNK = 1 << 14
WORDS_AT_ONCE = 1 << 15
#: More tables than ``MANY`` are taken in two passes: what the ``FIRST`` ones have linked is not linked again by the others, where
#: a group of near copies would be handed on once per table.
MANY, FIRST = 20, 4


def shingle_hashes(text: str | None, width: int, words: int, at_once: int = 1 << 14) -> Iterator[np.ndarray]:
    """Hashes of all shingles, in pieces ``[n, words]``: XXH64 with seed 42, then mixes of it for further fingerprint words.

    A-Z are lower-cased, words are runs of bytes other than ASCII whitespace; a text of fewer words
    than ``width`` is one shingle, a text without words none.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    n = len(tokens) - width + 1
    if tokens and n < 1:
        tokens, n, width = [b" ".join(tokens)], 1, 1
    for at in range(0, n, at_once):
        part = tokens[at : at + min(at_once, n - at) + width - 1]
        line, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate([[0], ends[:-1]])[: len(part) - width + 1].tolist()
        cuts = [line[s:e] for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
        first = np.frombuffer(b"".join([xxhash.xxh64_digest(c, 42) for c in cuts]), ">u8").astype(np.uint64)
        yield np.stack([first, *(_mixed(first, w) for w in range(1, words))], axis=1)


def _mixed(h: np.ndarray, w: int) -> np.ndarray:
    """The ``w``-th 64-bit hash that follows from the first: multiply and shift, each input bit reaches all output bits."""
    h = h + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: str | None, width: int = 3, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is set if more than half of the shingles' hashes set it."""
    return _majority(shingle_hashes(text, width, words), words)


def set_fingerprint(shingles: np.ndarray, words: int, at_once: int = 1 << 12) -> np.ndarray:
    """The fingerprint of a set of shingles, from their first hashes: each counts once."""
    pieces = (shingles[at : at + at_once] for at in range(0, len(shingles), at_once))
    return _majority((np.stack([h, *(_mixed(h, w) for w in range(1, words))], axis=1) for h in pieces), words)


def _majority(pieces: Iterator[np.ndarray], words: int) -> np.ndarray:
    ones, n = np.zeros(64 * words, np.int64), 0
    for h in pieces:
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        for low in range(0, len(h), 255):  # so many ones fit in a byte
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
        n += len(h)
    return np.packbits(2 * ones > n).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1) -> DataFrame:
    """``(doc_id, fingerprint binary)``, big-endian, one row per row of ``docs``."""

    def rows(c):
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            yield doc_id, fingerprint(text, width, words).astype(">u8").tobytes()

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, fingerprint binary")


def exact_tables(bits: int, radius: int, rows: int) -> list[np.ndarray]:
    """Bit positions of each table's key; fingerprints within ``radius`` agree on at least one key.

    ``bits`` are cut into radius + 1, + 2 or + 3 blocks; keys are the sets of blocks that ``radius``
    errors can't all touch.  More blocks give longer keys for more tables: taken as the rows grow, to
    keep the expected bucket of random fingerprints below 64.
    """
    for extra in (1, 2, 3):
        blocks = np.array_split(np.arange(bits), radius + extra)
        if rows >> (bits * extra // (radius + extra)) < 64:
            break
    return [np.concatenate(c) for c in combinations(blocks, extra)]


def sampled_tables(bits: int, differing: float, rows: int, miss: float = 0.01, seed: int = 5, bucket: int = 64) -> list[np.ndarray]:
    """Random bit subsets: fingerprints of which a share ``differing`` of the bits differs meet but for ``miss``; a bucket of random ones has ``bucket`` at most, or a key 12 bits."""
    key = max(12, min(32, math.ceil(math.log2(max(2, rows) / bucket))))
    tables = math.ceil(math.log(miss) / math.log(1 - (1 - differing) ** key))
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, key, replace=False)) for _ in range(tables)]


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union in place: the smaller root wins; ``parent`` ends fully compressed."""
    while len(a):
        ra, rb = parent[a], parent[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if len(a):
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (hop := parent[parent]).tolist() != parent.tolist():
                parent[:] = hop


def sliced_links(prints: np.ndarray, upto: np.ndarray, radius: int, linked: np.ndarray | None = None) -> np.ndarray:
    """``parent`` of a spanning forest over the links within ``radius``, grown from the forest ``linked`` (compressed) if given.

    ``prints`` is ``[n, words]`` with the members of a bucket side by side; row i is compared with the
    rows from i + 1 up to ``upto[i]``, and with whatever else lies in the same machine words.
    """
    n, words = prints.shape
    lanes = -(-n // 64)
    spread = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(n, 8 * words), axis=1)
    padded = np.zeros((64 * lanes, 64 * words), np.uint8)
    padded[:n] = spread
    packed = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little")
    planes = np.ascontiguousarray(packed).view("<u8").astype(np.uint64)
    flips = -np.ascontiguousarray(spread.T).view(np.int8)  # -1 widens to a word of ones
    counters = max(3, radius.bit_length())
    start = (np.arange(n) + 1) // 64
    spans = np.maximum((upto + 63) // 64 - start, 0)
    parent = np.arange(n) if linked is None else linked.copy()
    edges = np.concatenate([[0], np.cumsum(spans)])
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + WORDS_AT_ONCE, "right")) - 1)
        for low in range(0, int(spans[row:stop].max(initial=0)), WORDS_AT_ONCE):
            part = np.minimum(spans[row:stop] - low, WORDS_AT_ONCE).clip(0) if stop == row + 1 else spans[row:stop]
            q = np.repeat(np.arange(row, stop), part)
            w = start[q] + low + np.arange(len(q)) - np.repeat(np.cumsum(part) - part, part)
            a, b = _sweep(planes, flips, q, w, radius, counters)
            keep = (b > a) & (b < n)
            join_roots(parent, a[keep], b[keep])
            if stop > row + 1:
                break
        row = stop
    return parent


def _sweep(planes: np.ndarray, flips: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Query rows and lane numbers within the radius, for the pairs (query, machine word)."""
    over = np.zeros(len(q), np.uint64)
    count = [np.zeros(len(q), np.uint64) for _ in range(counters)]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(0, len(planes), 8):
        differ = [planes[i][w] ^ flips[i][q].astype(np.int64).view(np.uint64) for i in range(k, k + 8)]
        fours = []
        for half in (differ[:4], differ[4:]):
            count[0], two = _carry_save(count[0], half[0], half[1])
            count[0], more = _carry_save(count[0], half[2], half[3])
            count[1], four = _carry_save(count[1], two, more)
            fours.append(four)
        count[2], carry = _carry_save(count[2], *fours)
        for c in range(3, counters):
            count[c], carry = count[c] ^ carry, count[c] & carry
        over |= carry
        if k + 8 > 2 * radius and len(q):  # sooner, a block seldom is beyond the radius in all its lanes
            alive = (over | _above(count, radius)) != full
            if alive.sum() < 0.75 * len(q):
                q, w, over, count = q[alive], w[alive], over[alive], [c[alive] for c in count]
    hit = ~(over | _above(count, radius))
    at = np.flatnonzero(hit)
    lane = np.unpackbits(hit[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, j = np.nonzero(lane)
    return q[at[i]], w[at[i]] * 64 + j


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane by lane the sum of three bits: its low bit and its high bit."""
    half = a ^ b
    return half ^ c, a & b | half & c


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``: a bitwise comparison from the top counter down."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], 0xFFFFFFFFFFFFFFFF)
    for c in reversed(range(len(count))):
        if radius >> c & 1:
            equal = equal & count[c]
        else:
            above, equal = above | equal & count[c], equal & ~count[c]
    return above


def _bucket_rows(prints: DataFrame, tables: list[np.ndarray], words: int) -> DataFrame:
    """``(bucket, known, fingerprint)``, a row per table; a bucket is the table's number and the key's bits, 48 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            spread = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 * words), axis=1)
            for t, bits in enumerate(tables):
                key = np.packbits(spread[:, bits[:48]], axis=1)
                wide = np.zeros((len(key), 8), np.uint8)
                wide[:, 8 - key.shape[1] :] = key
                yield pa.RecordBatch.from_arrays([pa.array(wide.view(">i8").ravel().astype(np.int64) + (t << 48)), batch.column(1), column.cast(pa.binary())], names=["bucket", "known", "fingerprint"])

    return prints.select("fingerprint", "known").mapInArrow(run, "bucket long, known long, fingerprint binary")


def links(prints: DataFrame, radius: int, words: int = 1, differing: float | None = None, **sampling) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints, enough to connect all within ``radius``.

    ``prints`` holds each fingerprint once and is read several times: pass a settled table.  Bucket rows
    are made anew for each reading, so only keys and one shuffle of fingerprints touch the disks.
    Buckets of more than ``CHUNK`` fingerprints are compared in pairs of chunks, each pair a group of
    its own, so no task holds an unbounded bucket.
    """
    rows = prints.count()
    tables = exact_tables(64 * words, radius, rows) if differing is None else sampled_tables(64 * words, differing, rows, **sampling)
    if len(tables) <= MANY:
        return _table_links(prints.select("fingerprint", F.lit(None).cast("long").alias("known")), tables, radius, words)
    first = _table_links(prints.select("fingerprint", F.lit(None).cast("long").alias("known")), tables[:FIRST], radius, words)
    stars = settle(connected_components(first, "a", "b"), "first_links")
    both = prints.select("fingerprint").join(stars.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    known = settle(both.select("fingerprint", F.when(F.col("component").isNotNull(), F.xxhash64("component")).alias("known")), "known")
    return stars.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_table_links(known, tables[FIRST:], radius, words))


def _table_links(prints: DataFrame, tables: list[np.ndarray], radius: int, words: int) -> DataFrame:
    """``(a, b)`` from the buckets of ``tables``; rows of ``prints`` (fingerprint, known) with one ``known`` are linked already, those without (null) with none."""
    keyed = _bucket_rows(prints, tables, words)
    chunks = F.ceil(F.col("count") / CHUNK).cast("int")
    large = keyed.groupBy("bucket").count().where(F.col("count") > CHUNK).select("bucket", chunks.alias("chunks"))
    large = settle(large, "large_buckets")  # at most rows * tables / CHUNK of them
    split = not large.isEmpty()
    small = (keyed.join(large, "bucket", "left_anti") if split else keyed).select("bucket", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("part"), "known", "fingerprint")
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    pair = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    big = keyed.join(large, "bucket").withColumn("part", mine).withColumn("other", pair)
    big = big.select("bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "known", "fingerprint")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) >= 2 * CHUNK:
                done, held = _split_last(held)
                yield from _forest(done, words, radius)
        if held is not None:
            yield from _forest(held, words, radius)

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "part").mapInArrow(forest, "a binary, b binary")

    return in_order(small.unionByName(big) if split else small).distinct()


def _split_last(held: pa.Table) -> tuple[pa.Table, pa.Table]:
    """All complete groups of the sorted rows, and the last group, which may go on."""
    key = np.stack([held[c].to_numpy() for c in ("bucket", "x", "y")])
    cut = np.flatnonzero((key != key[:, -1:]).any(axis=0))
    at = int(cut[-1]) + 1 if len(cut) else 0
    return held.slice(0, at), held.slice(at)


def _forest(held: pa.Table, words: int, radius: int) -> Iterator[pa.RecordBatch]:
    if not len(held):
        return
    key = np.stack([held[c].to_numpy() for c in ("bucket", "x", "y")])
    prints = held["fingerprint"].to_pylist()
    bits = np.frombuffer(b"".join(prints), ">u8").reshape(-1, words).astype(np.uint64)
    ends = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, len(held))
    linked, given = np.arange(len(held)), np.flatnonzero(held["known"].is_valid().to_numpy())
    _, first, group = np.unique(held["known"].drop_null().to_numpy(), return_index=True, return_inverse=True)
    linked[given] = given[first[group]]
    parent = sliced_links(bits, ends[np.searchsorted(ends, np.arange(len(held)), "right")], radius, linked)
    at = np.flatnonzero((linked == np.arange(len(held))) & (parent != linked))  # what was linked before is handed on once, by its first row
    yield pa.RecordBatch.from_pydict({"a": pa.array([prints[i] for i in at], pa.binary()), "b": pa.array([prints[i] for i in parent[at]], pa.binary())})


def near_duplicates(docs: DataFrame, width: int = 3, words: int = 1, radius: int = 3, differing: float | None = None) -> DataFrame:
    """``(doc_id, fingerprint hex string, component_id)``, one row per row of ``docs``.

    Documents of equal fingerprints, and those linked within ``radius`` bits, directly or through
    others, are one component, named by its smallest doc_id.  Texts without words have fingerprint
    zero and link like any other.  A null doc_id takes part but names a component only if no other id
    is in it (then null).  Columns besides doc_id and text are ignored.
    """
    prints = settle(fingerprints(docs, width, words), "fingerprints")
    distinct = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fingerprint"), radius, words, differing), "a", "b")
    roots = roots.select(F.col("node").alias("fingerprint"), "component")
    named = distinct.join(roots, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(names, "component").select("fingerprint", "component_id")
    return prints.join(found, "fingerprint").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


#: Near-duplicates of a similarity of about 0.8 or more over five-word shingles by fingerprints alone: 512 bits, of which such texts differ in 78 on average
#: (share 0.152: the angle of a cosine of 2 * 0.8 / 1.8), standard deviation 8.1; unrelated texts differ in 256.
FUZZY = {"width": 5, "words": 8, "radius": 92, "differing": 0.152}


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; all columns stay.

    Components are those of five-word shingle sets of exact similarity 0.8 or more; with options (as
    ``FUZZY``) those of fingerprints.  Of rows that repeat a doc_id one stays.  Rows with a null doc_id
    stay only where no row of the component has an id, and then one per text.
    """
    from chainloom.llm import jaccard

    found = settle(near_duplicates(docs, **how) if how else jaccard.near_duplicates(docs), "components")
    shape = {k: v for k, v in how.items() if k in ("width", "words")}
    name = (lambda t: fingerprint(t, **shape).astype(">u8").tobytes().hex()) if how else (lambda t: jaccard.text_digest(t).hex())
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi")
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if not again.isEmpty():
        once = once.join(again, "doc_id", "left_anti").unionByName(once.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    if not docs.where("doc_id is null").isEmpty():
        alone = found.where("doc_id is null and component_id is null").select(F.col("fingerprint").alias("__f")).distinct()
        nameless = docs.where("doc_id is null")
        prints = map_rows(nameless.select("text").distinct(), lambda c: ((t, name(t)) for t in c["text"]), "__t string, __f string")
        chosen = prints.join(alone, "__f").groupBy("__f").agg(F.min(F.struct(F.col("__t").isNull(), "__t")).alias("t")).select(F.col("t.__t").alias("__t"))
        once = once.unionByName(nameless.join(chosen, nameless["text"].eqNullSafe(chosen["__t"]), "left_semi").dropDuplicates(["text"]))
    return once.select(*docs.columns)
