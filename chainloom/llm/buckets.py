"""Minimiser buckets: how equal windows of all documents meet without shipping every window.

Every window (so many consecutive words or bytes) contains a minimiser, the piece of smallest hash.
Consecutive windows with one minimiser form a super-string, and equal windows always lie in super-strings
of one minimiser, as it is a function of the window alone.

1. Only the minimisers' hashes go to buckets, a few bytes per super-string, and come back as the list of
   super-strings of each document whose minimiser occurs again.  A minimiser that one map pack holds more than
   ``PACK_HOT`` times goes as one head, so a bucket gets few rows of the most common ones.
2. Those super-strings travel, packed, to the bucket of their minimiser, where windows are compared.
3. A minimiser with more than ``HOT`` super-strings stays out of step 2.  Spark first groups its equal
   super-strings (with a map-side combine, by their bytes), so copies count once; the distinct ones are then
   compared by the operator in families that share more than the minimiser.  No digest stands for a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.llm.common import NULL_ID, as_batch, to_arrow_schema
from chainloom.storage import settle

#: A cutter turns one text, segment by segment, into (data, start, end, first window, windows, place of the minimiser,
#: minimiser hash): one entry per super-string ``data[start:end]``.
Cutter = Callable[[str | None], Iterator[tuple]]
#: Windows that are cut at once, so that memory does not follow the longest text.
SEGMENT_WINDOWS = 1 << 16
PACK_BYTES, PACK_ROWS = 16 << 20, 1 << 20
HOT = 200_000
#: Heads of one minimiser in one map pack beyond which the pack sends a single head for all of them.
PACK_HOT = 1_000
#: Documents per bucket of the first step, which holds some 24 bytes per super-string; only memory depends on it.
ROWS_PER_BUCKET = 2_000
RUNS = "doc long, row long, first int, count int"
_PLACE = np.uint64(20)


def minimisers(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows over ``span`` consecutive pieces: (first window, windows, piece) of every stretch that
    shares one minimising piece; ties go to the first piece."""
    n = len(hashes) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)  # at most 2**20 pieces come at once
    width = 1
    while 2 * width <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[:n], low[span - width : span - width + n])
    piece = (low & np.uint64(2**20 - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1])
    return first, np.diff(np.append(first, n)), piece[first]


def row_key(text: str | None) -> int:
    """Tells rows of one doc_id but different texts apart."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"), 9) - 2**63


def _zip(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _blobs(bucket: np.ndarray, columns: list[np.ndarray], strings: list[bytes] | None = None) -> pa.RecordBatch:
    """One compressed row per bucket: the length, the columns, then the strings."""
    order = np.argsort(bucket, kind="stable")
    names, blobs = [], []
    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        parts = [np.array([len(at)], np.int64).tobytes(), *(c[at].tobytes() for c in columns)]
        names.append(int(bucket[at[0]]))
        blobs.append(_zip(parts + ([strings[i] for i in at.tolist()] if strings else [])))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _columns(data: bytes, kinds: list[type]) -> tuple[list[np.ndarray], int]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out, at


def by_bucket(packed: DataFrame, buckets: int, work: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs ``work`` on the blobs of each bucket; a task holds one bucket at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from work(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from work(held)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(rows, schema)


def zipped(docs: DataFrame) -> DataFrame:
    """``(doc, row, doc_id, text binary)``: what a shuffle of whole texts carries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
            blobs = [None if t is None else _zip([t.encode("utf-8", "surrogatepass")]) for t in texts]
            doc = [NULL_ID if i is None else i for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(map(row_key, texts), pa.int64()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["doc", "row", "doc_id", "zip"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc long, row long, doc_id long, zip binary")


def text_of(blob: bytes | None) -> str | None:
    return None if blob is None else _unzip(blob).decode("utf-8", "surrogatepass")


_HEADS = [np.uint32, np.int64, np.int64, np.int32, np.int8]


def repeated_heads(docs: DataFrame, cut: Cutter, buckets: int, across: bool) -> DataFrame:
    """``(doc, row, seqs array<int>, hot array<int>)``: super-strings whose minimiser occurs again.

    ``seq`` counts the super-strings of a text.  With ``across`` it must occur in another document.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seq, key = 0, row_key(text)
                for *_, low in cut(text):
                    held.append((low, NULL_ID if doc_id is None else doc_id, key, seq))
                    seq += len(low)
                    n += len(low)
                if n >= PACK_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        low, sizes = np.concatenate([h[0] for h in held]), [len(h[0]) for h in held]
        doc, row = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (1, 2))
        seq = np.concatenate([np.arange(h[3], h[3] + len(h[0]), dtype=np.int32) for h in held])
        _, inverse, counts = np.unique(low, return_inverse=True, return_counts=True)
        # heads of a minimiser that fills the pack are settled as hot at once, dealt to any bucket; its own bucket learns of them from one
        many = counts[inverse] > PACK_HOT
        told = np.zeros(len(low), bool)
        told[np.unique(np.where(many, inverse, -1), return_index=True)[1]] = True
        told &= many
        own = (low % np.uint64(buckets)).astype(np.int64)
        dealt = np.where(many & ~told, (row ^ seq) % buckets, own)
        kind = np.where(many, np.where(told, 2, 1), 0).astype(np.int8)
        return _blobs(dealt, [(low >> np.uint64(32)).astype(np.uint32), doc, row, seq, kind])

    def again(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        low, doc, row, seq, kind = (np.concatenate(c) for c in zip(*(_columns(_unzip(b), _HEADS)[0] for b in blobs), strict=True))
        asks = kind != 1
        _, inverse, counts = np.unique(low[asks], return_inverse=True, return_counts=True)
        full = np.zeros(len(counts), bool)
        np.logical_or.at(full, inverse, kind[asks] == 2)
        keep, hot = np.ones(len(low), bool), np.ones(len(low), bool)
        hot[asks] = ((counts > HOT) | full)[inverse]
        if across:
            least, most = np.full(len(counts), 2**63 - 1), np.full(len(counts), -(2**63))
            np.minimum.at(least, inverse, doc[asks])
            np.maximum.at(most, inverse, doc[asks])
            keep[asks] = (full | (least < most))[inverse]
        else:
            keep[asks] = (full | (counts > 1))[inverse]
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep], pa.int64()), pa.array(row[keep], pa.int64()), pa.array(seq[keep], pa.int32()), pa.array(hot[keep], pa.bool_())], ["doc", "row", "seq", "hot"])

    found = by_bucket(docs.select("doc_id", "text").mapInArrow(heads, "bucket int, blob binary"), buckets, again, "doc long, row long, seq int, hot boolean")
    pick = lambda c: F.collect_set(F.when(c, F.col("seq")))
    return found.groupBy("doc", "row").agg(pick(~F.col("hot")).alias("seqs"), pick(F.col("hot")).alias("hot"))


_STRINGS = [np.int64, np.int64, np.int32, np.int32, np.int32, np.uint32, np.int32]
NAMES = ("doc", "row", "first", "count", "place", "low")


def pack_strings(doc: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, low: np.ndarray, texts: list[bytes], buckets: int) -> pa.RecordBatch:
    """One row per bucket, dealt by ``low``, that :func:`unpack` reads."""
    numbers = [doc.astype(np.int64), row.astype(np.int64), *(c.astype(np.int32) for c in (first, count, place)), (low >> np.uint64(32)).astype(np.uint32)]
    return _blobs((low % np.uint64(buckets)).astype(np.int64), [*numbers, np.fromiter(map(len, texts), np.int32, len(texts))], texts)


def unpack(blobs: list[bytes]) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """The super-strings of a bucket with doc, row, first, count, place and low (32 bits of the minimiser hash)."""
    strings, columns = [], []
    for blob in blobs:
        data = _unzip(blob)
        (*mine, length), at = _columns(data, _STRINGS)
        ends = np.cumsum(length, dtype=np.int64) + at
        strings += [data[s:e] for s, e in zip((ends - length).tolist(), ends.tolist(), strict=True)]
        columns.append(mine)
    return strings, {n: np.concatenate(c) for n, c in zip(NAMES, zip(*columns, strict=True), strict=True)}


def marked_windows(
    docs: DataFrame,
    cut: Cutter,
    per_bucket: int,
    compare: Callable[[list[bytes]], Iterator[pa.RecordBatch]],
    families: Callable[[DataFrame], DataFrame],
    whole: Column,
    across: bool,
) -> DataFrame:
    """``(doc, row, runs array<struct<first, count>>)``: runs of marked windows, a row per super-string and run or per hot super-string.

    ``compare`` marks the windows of one bucket, which gets about ``per_bucket`` super-strings.  ``families``
    gives ``(id, first, count)`` for the distinct super-strings of hot minimisers, a table ``(id, string, least,
    n, windows, place)`` with the smallest document and the number of their occurrences; ``whole`` says on
    such a row and ``doc`` whether all windows of an occurrence are marked.
    """
    lists = settle(repeated_heads(docs, cut, max(8, docs.count() // ROWS_PER_BUCKET), across), "heads")
    found = lists.agg(F.coalesce(F.sum(F.size("seqs")), F.lit(0))).first()[0]
    buckets = max(8, int(found // per_bucket))
    joined = zipped(docs).join(lists, ["doc", "row"]).select("doc", "row", "zip", "seqs", "hot")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, row, blob, seqs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for *some, texts in chosen(blob, seqs):
                    size += sum(map(len, texts))
                    held.append((doc, row, *some, texts))
                    if size >= PACK_BYTES:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    def chosen(blob: bytes, seqs: list[int]) -> Iterator[tuple]:
        wanted, seq = np.sort(np.array(seqs, np.int64)), 0
        for data, start, end, first, count, place, low in cut(text_of(blob)) if len(wanted) else ():
            at = wanted[np.searchsorted(wanted, seq) : np.searchsorted(wanted, seq + len(low))] - seq
            seq += len(low)
            if len(at):
                yield first[at], count[at], place[at], low[at], [data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]

    def packed(held: list[tuple]) -> pa.RecordBatch:
        sizes, texts = [len(h[6]) for h in held], [t for h in held for t in h[6]]
        doc, row = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (0, 1))
        return pack_strings(doc, row, *(np.concatenate([h[i] for h in held]) for i in (2, 3, 4, 5)), texts, buckets)

    def hot_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, blob, seqs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held: dict[bytes, tuple[int, int, list[int]]] = {}  # a string that a text repeats is one row
                for first, count, place, _, texts in chosen(blob, seqs):
                    for f, n, p, t in zip(first.tolist(), count.tolist(), place.tolist(), texts, strict=True):
                        held.setdefault(t, (n, p, []))[2].append(f)
                if held:
                    count, place, firsts = zip(*held.values(), strict=True)
                    kinds = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(held), pa.int64()), pa.array([row] * len(held), pa.int64()), *(pa.array(c, k) for c, k in zip((firsts, count, place, list(held)), kinds, strict=True))], ["doc", "row", "firsts", "windows", "place", "string"])

    cold = by_bucket(joined.select("doc", "row", "zip", "seqs").mapInArrow(strings, "bucket int, blob binary"), buckets, compare, RUNS).select("doc", "row", F.array(F.struct("first", "count")).alias("runs"))
    hot_lists = lists.where(F.size("hot") > 0)
    if hot_lists.isEmpty():
        return cold
    asked = joined.where(F.size("hot") > 0).select("doc", "row", "zip", "hot")
    each = settle(asked.mapInArrow(hot_strings, "doc long, row long, firsts array<int>, windows int, place int, string binary"), "hot")
    classes = each.groupBy("string").agg(F.min("doc").alias("least"), F.sum(F.size("firsts")).alias("n"), F.first("windows").alias("windows"), F.first("place").alias("place"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "hot_strings")
    runs = families(classes).groupBy("id").agg(F.collect_set(F.struct(F.col("first").alias("at"), F.col("count").alias("many"))).alias("runs"))
    told = settle(classes.join(runs, "id", "left").select("string", "least", "n", "runs"), "hot_runs")  # settled, so that the join below may be split where it is skewed
    all_of_it = F.transform("firsts", lambda f: F.struct(f.alias("first"), F.col("windows").alias("count")))
    some_of_it = F.flatten(F.transform("firsts", lambda f: F.transform("runs", lambda r: F.struct((f + r["at"]).alias("first"), r["many"].alias("count")))))
    marks = each.join(told, "string").select("doc", "row", F.when(whole, all_of_it).otherwise(some_of_it).alias("runs")).where("runs is not null")
    return cold.unionByName(marks)


def runs_of(doc: np.ndarray, row: np.ndarray, first: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    """Marked windows as ``(doc, row, first window, windows)``; ``flat`` has the marks of all super-strings, ``sizes`` of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined = flat[1:] & flat[:-1] & (owner[1:] == owner[:-1])
    begin = np.flatnonzero(flat & ~np.concatenate([[False], joined])[: len(flat)])
    end = np.flatnonzero(flat & ~np.concatenate([joined, [False]])[: len(flat)])
    who = owner[begin]
    return pa.RecordBatch.from_arrays([pa.array(doc[who], pa.int64()), pa.array(row[who], pa.int64()), pa.array(first[who] + inside[begin], pa.int32()), pa.array(end - begin + 1, pa.int32())], ["doc", "row", "first", "count"])


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``values[start : start + size]`` one after the other."""
    return values[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


def with_runs(docs: DataFrame, marks: DataFrame, work: Callable[[int | None, str | None, list], tuple], schema: str) -> DataFrame:
    """``work(doc_id, text, runs)`` for every row of ``docs``; runs is empty for documents without marks."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    runs = marks.groupBy("doc", "row").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    joined = zipped(docs).join(runs, ["doc", "row"], "left").select("doc_id", "zip", "runs")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if out := [work(doc_id, text_of(blob), sorted((r["first"], r["count"]) for r in found or ())) for doc_id, blob, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]:
                yield as_batch(out, kind)

    return joined.mapInArrow(rows, schema)
