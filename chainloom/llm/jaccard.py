"""Near-duplicates by SimHash, checked by the exact Jaccard similarity of shingle sets.

SimHash fingerprints of the sets, compared bit-sliced (:mod:`chainloom.llm.simhash`), propose: texts whose fingerprints are
linked fall into one candidate component.  Inside a component tasks compare the shingle sets themselves and hand on a spanning
forest of the pairs whose similarity reaches the threshold, so no group rests on an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows
from chainloom.llm.simhash import join_roots, links, set_fingerprint, shingle_hashes
from chainloom.operators.components import connected_components
from chainloom.storage import settle

WIDTH, THRESHOLD = 5, 0.8
#: Fingerprints of 512 bits.  Sets of similarity 0.8 differ in 78 bits on average (standard deviation 8.1), the smallest, 4 shingles of 5, in 96 (8.8): the radius is
#: 3.6 deviations beyond; unrelated sets differ in 256.  Tables are sized to miss one in 1,000 pairs that differ in 96 bits, with keys that stay short as rows grow.
FUZZY = {"words": 8, "radius": 128, "differing": 0.1875, "miss": 0.001, "bucket": 4096}
#: MinHash bands, beside which the tests hold the fingerprints.  So many rows each: (1 - 0.8 ** 5) ** 24 = 7e-5 of the pairs at 0.8 share no band.
BANDS, ROWS = 24, 5
FACTORS = np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that one chunk of a component holds; larger components are compared in pairs of chunks.
CHUNK = 1 << 21
HELD_BYTES = 1 << 26
#: Bits of the filter that says which texts are wanted in the second reading: 8 MB whatever the input.  Where it fills up
#: more texts pass it, none is missed.
FILTER_BITS = 1 << 26


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text without words has none."""
    parts = [h[:, 0] for h in shingle_hashes(text, width, 1)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a shingle set; equal sets, equal digests."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_digest(text: str | None) -> bytes:
    return set_digest(shingle_set(text))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, from the smallest hashes under ``ROWS`` orders; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def text_key(text: str | None) -> int:
    """64 bits of the text itself, cheaper than its shingles."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"), 3) - 2**63


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with the bit of every ``key`` set; built in pieces of 4 KB by Spark."""
    bit = (F.pmod("key", F.lit(FILTER_BITS)) + 1).alias("bit")
    pieces = keys.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    found = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in pieces.collect():  # FILTER_BITS / 32768 pieces at most
        at = (r.piece - 1) * 4096
        found[at : at + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return found


def in_filter(found: np.ndarray, key: int) -> bool:
    bit = key % FILTER_BITS
    return bool(found[bit >> 3] >> (bit & 7) & 1)


def jaccard_forest(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """``parent`` of a spanning forest over all pairs of sets whose Jaccard similarity reaches ``threshold``."""
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    seen, parent = np.zeros(int(ids.max(initial=0)) + 1, bool), np.arange(n)
    last = np.searchsorted(sizes, sizes / threshold + 1e-9, "right")  # no larger set can reach the threshold
    for i in range(n):
        others = np.arange(i + 1, last[i])
        if not sizes[i] or not (parent[others] != parent[i]).any():
            continue
        mine = ids[starts[i] : ends[i]]
        seen[mine] = True
        low = starts[i + 1]
        both = np.add.reduceat(seen[ids[low : ends[last[i] - 1]]], starts[others] - low, dtype=np.int64)
        seen[mine] = False
        near = others[both >= threshold * (sizes[i] + sizes[others] - both) - 1e-9]
        join_roots(parent, np.full(len(near), i), near)
    found = np.empty(n, np.int64)
    found[order] = order[parent]
    return found


def _compared(held: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges of the forests of all groups in ``held``."""
    key = np.stack([held[c].to_numpy() for c in ("bucket", "x", "y")])
    cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(held)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        names = held["digest"].slice(low, high - low).to_pylist()
        parent = jaccard_forest([np.frombuffer(s, np.uint64) for s in held["shingles"].slice(low, high - low).to_pylist()])
        at = np.flatnonzero(parent != np.arange(high - low))
        yield pa.RecordBatch.from_pydict({"a": pa.array([names[i] for i in at], pa.binary()), "b": pa.array([names[i] for i in parent[at]], pa.binary())})


def _split_last(held: pa.Table) -> tuple[pa.Table, pa.Table]:
    """All complete groups of the sorted rows, and the last group, which may go on."""
    key = np.stack([held[c].to_numpy() for c in ("bucket", "x", "y")])
    cut = np.flatnonzero((key != key[:, -1:]).any(axis=0))
    at = int(cut[-1]) + 1 if len(cut) else 0
    return held.slice(0, at), held.slice(at)


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        parts.append(batch)
        if sum(p.nbytes for p in parts) >= HELD_BYTES:
            done, rest = _split_last(pa.Table.from_batches(parts))
            if len(done):
                yield from _compared(done)
            parts = rest.to_batches()
    if parts:
        yield from _compared(pa.Table.from_batches(parts))


def verified_links(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """``(a, b)`` digests: links between distinct shingle sets, each of similarity 0.8 or more, enough to connect all such pairs that meet.

    One text of every set that met another is read again; a filter of fixed size passes over the others before they are
    cut into shingles or shuffled.
    """
    prints = settle(sketched.groupBy("fingerprint").agg(F.count("*").alias("n")), "fingerprints")
    roots = connected_components(links(prints.select("fingerprint"), **FUZZY), "a", "b").select(F.col("node").alias("fingerprint"), "component")
    met = prints.join(roots, "fingerprint", "left").where("component is not null or n > 1").select("fingerprint", F.xxhash64(F.coalesce("component", "fingerprint")).alias("bucket"))
    member = settle(met.join(sketched.select("digest", "size", "key", "fingerprint"), "fingerprint").select("digest", "bucket", "size", "key"), "members")
    weight = member.groupBy("bucket").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")
    placed = member.join(weight, "bucket").withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("digest", "bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(member.select("key")))

    def rows(c):
        for text in c["text"]:
            if in_filter(wanted.value, text_key(text)):
                found = shingle_set(text)
                yield set_digest(found), found.tobytes()

    sets = map_rows(docs.select("text"), rows, "digest binary, shingles binary", flush=500)
    once = sets.join(member.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    grouped = once.join(placed, "digest").select("bucket", "x", "y", "digest", "shingles")
    return grouped.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(_compare_groups, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint hex string, component_id)``, one row per row of ``docs``; the fingerprint is the set's digest.

    Documents of equal five-word shingle sets, and those linked by a similarity of 0.8 or more, directly
    or through others, are one component, named by its smallest doc_id.  Texts without words are equal.
    A null doc_id takes part but names a component only if no other id is in it (then null).
    """

    def rows(c):
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            found = shingle_set(text)
            yield doc_id, set_digest(found), text_key(text), len(found), set_fingerprint(found, FUZZY["words"]).astype(">u8").tobytes()

    prints = settle(map_rows(docs.select("doc_id", "text"), rows, "doc_id long, digest binary, key long, size long, fingerprint binary"), "sketches")
    sketched = settle(prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("fingerprint").alias("fingerprint")), "distinct")
    roots = connected_components(verified_links(docs, sketched), "a", "b")
    named = sketched.select("digest", F.col("least")).join(roots.select(F.col("node").alias("digest"), "component"), "digest", "left")
    named = named.select("digest", "least", F.coalesce("component", "digest").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(names, "component").select("digest", "component_id")
    return prints.select("doc_id", "digest").join(found, "digest").select("doc_id", F.lower(F.hex("digest")).alias("fingerprint"), "component_id")
