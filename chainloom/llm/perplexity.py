"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs.

Counting runs in Spark in two rounds.  First words: every task sums its word hashes, shards of the hash range merge them
into sorted hash arrays, and a word's number is its place in them.  Then pairs: a task sums pairs of
numbers, buckets merge them into sorted arrays of pairs with counts and tell the words how many pairs of
each count follow them and how many words stand before them.  All arrays are files of the
shared folder.  The tasks that score map them into memory, look their n-grams up in sorted order, so that pages are
read one after the other and shared between workers, and hold no copy.

The model: ``p(w | v) = (c(v w) - D2(c)) / c(v) + g(v) * p(w)``, ``p(w) = (b(w) - D1(b)) / B + g / (V + 1)``, where b(w)
counts the different words before w and B sums them, g is the mass that the discounts leave, and the discounts D of
1, 2 and more follow from the counts of counts.  A text begins behind a start mark and ends with an end token; what
training never met shares the V + 1st part of the last term, so the probabilities over the words, the end
and the unknown sum to 1.

A null or empty text is its end alone; null ids are never learned from and count as held out; repeated rows count
as often as they occur; an empty table gives an empty result, and without training texts every probability is 1.
Words are told apart by 64-bit hashes; a vocabulary has 2^32 - 2 words at most, beyond which fitting raises.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import held_out
from chainloom.llm.spans import byte_table, span_hashes, word_spans
from chainloom.storage import settle, shared_dir

GAPS = b"\t\n\x0b\x0c\r "
#: Stands for the end token among word hashes.
END = np.uint64(0x9D5C0F3B7A1E2468)
#: Keys that a task holds before it sums them and hands them on, and that one bucket of pairs merges on average.
HANDED, HELD = 1 << 21, 1 << 22
#: Tokens that a task looks up at once, some 80 bytes each, and pairs whose logarithms it takes at once, some 200 bytes each.
AT_ONCE, LOGS = 1 << 18, 1 << 16
RECORD = np.dtype([("count", "<u8"), ("before", "<u4"), ("once", "<u4"), ("twice", "<u4"), ("more", "<u4")])
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def put_array(uri: str, array: np.ndarray) -> None:
    """Writes the file under a name of its own first, so that a task that runs twice leaves a whole one."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data if len(array) else b"")
    store.move(part, path)


def map_array(uri: str, dtype: np.dtype) -> np.ndarray:
    """The file as a mapped array; where the shared folder is no mounted one, by way of an unnamed local file."""
    store, path = pafs.FileSystem.from_uri(uri)
    if not store.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with tempfile.TemporaryFile() as own, store.open_input_stream(path) as found:
        while block := found.read(1 << 24):
            own.write(block)
        own.flush()
        return np.memmap(own, dtype, "r")


class Arrays:
    """Consecutive files as one array; each is mapped when it is first needed."""

    def __init__(self, folder: str, name: str, sizes: list[int], dtype: np.dtype) -> None:
        self.uris, self.dtype = [f"{folder}/{name}-{i}" for i in range(len(sizes))], dtype
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.open: dict[int, np.ndarray] = {}

    def part(self, i: int) -> np.ndarray:
        if i not in self.open:
            self.open[i] = map_array(self.uris[i], self.dtype)
        return self.open[i]

    def take(self, places: np.ndarray) -> np.ndarray:
        """The entries at ``places``, which must rise; places beyond the end give zeros."""
        out = np.zeros(len(places), self.dtype)
        cuts = np.searchsorted(places, self.starts)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = cuts[i], cuts[i + 1]
            out[lo:hi] = self.part(i)[places[lo:hi] - self.starts[i]]
        return out


def find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(found, place)`` of each key in a sorted array."""
    place = np.searchsorted(array, keys)
    there = np.zeros(len(keys), bool)
    inside = np.flatnonzero(place < len(array))
    there[inside] = array[place[inside]] == keys[inside]
    return there, place


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and their total counts (1 each where none are given: then ``keys`` is sorted in place)."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.uint64)
        del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], total


def planes(array: np.ndarray) -> bytes:
    """Bytes of equal rank side by side: those of high rank hardly differ in sorted keys, so the shuffle packs them."""
    return array.view(np.uint8).reshape(len(array), -1).T.tobytes()


def unplaned(blob: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).ravel()


PIECES = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PIECES_DDL = "bucket int, keys binary, counts binary"


def dealt(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row per bucket of sorted keys and their counts."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order].astype(np.uint32), bucket[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(keys)).tolist()
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_pydict({"bucket": [int(bucket[lo]) for lo, _ in spans], "keys": [planes(keys[lo:hi]) for lo, hi in spans], "counts": [planes(counts[lo:hi]) for lo, hi in spans]}, PIECES)


def gathered(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """``(bucket, keys, counts)`` of all rows of a bucket."""
    keys = np.concatenate([unplaned(b.as_py(), "<u8") for b in group["keys"]])
    counts = np.concatenate([unplaned(b.as_py(), "<u4") for b in group["counts"]])
    return group["bucket"][0].as_py(), *summed(keys, counts)


def pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys * _SPREAD
    return ((mixed ^ mixed >> np.uint64(32)) * _SPREAD >> np.uint64(32)).astype(np.int64) % buckets


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more from how many n-grams occur 1, 2, 3 and 4 times; k / 2 where these do not tell."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0
        out.append(d if 0 < d < k else k / 2)
    return np.array(out)


@dataclass
class Model:
    """Where the arrays lie and what is known of the whole: a few numbers for each file."""

    folder: str
    words: list[int]  # per shard of the hash range, how many
    pairs: list[int]  # per bucket
    tokens: int
    texts: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    left: float  # mass that the words' discounts leave, of all

    @property
    def size(self) -> int:
        return sum(self.words)

    @property
    def start(self) -> int:
        """The number of the start mark; the next one stands for the unknown."""
        return self.size

    def opened(self) -> Reader:
        return Reader(self)


class Reader:
    """A model with its arrays mapped, in one task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.hashes = Arrays(model.folder, "hashes", model.words, np.dtype("<u8"))
        self.records = Arrays(model.folder, "records", model.words[:-1] + [model.words[-1] + 1], RECORD) if model.pairs else None
        self.keys = Arrays(model.folder, "keys", model.pairs, np.dtype("<u8"))
        self.counts = Arrays(model.folder, "counts", model.pairs, np.dtype(np.uint8))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; one beyond the start mark if it is unknown."""
        different, which = np.unique(hashes, return_inverse=True)
        out = np.full(len(different), self.model.start + 1, np.uint64)
        shards = len(self.model.words)
        edges = np.append(np.searchsorted(different, shard_edges(shards)), len(different))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[i], edges[i + 1]
            there, place = find(self.hashes.part(i), different[lo:hi])
            out[lo:hi][there] = (place[there] + self.hashes.starts[i]).astype(np.uint64)
        return out[which]

    def pairs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(row, key)`` of every token with the one before it, ends last."""
        last = np.full(len(texts), self.model.start, np.uint64)
        for data, start, end, row in word_spans(texts, byte_table(GAPS)):
            if not len(start):
                continue
            now = self.numbers(span_hashes(data, start, end))
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            before = np.concatenate([now[:1], now[:-1]])
            before[first] = last[row[first]]
            ends = np.append(first[1:], len(row)) - 1
            last[row[ends]] = now[ends]
            yield row, before << np.uint64(32) | now
        end_number = self.numbers(np.array([END]))[0]
        yield np.arange(len(texts)), last << np.uint64(32) | end_number

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """How often each of the keys, which must rise, was met in training."""
        out = np.zeros(len(keys), np.int64)
        if self.model.pairs:
            bucket = pair_bucket(keys, len(self.model.pairs))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(len(self.model.pairs) + 1))
            for i in np.flatnonzero((np.diff(cuts) > 0) & (np.array(self.model.pairs) > 0)).tolist():
                mine = order[cuts[i] : cuts[i + 1]]
                there, place = find(self.keys.part(i), keys[mine])
                counts = self.counts.part(i)
                out[mine[there]] = counts.view(f"<u{len(counts) // len(self.keys.part(i))}")[place[there]]
        return out

    def records_of(self, numbers: np.ndarray) -> np.ndarray:
        different, which = np.unique(numbers, return_inverse=True)
        found = self.records.take(different.astype(np.int64)) if self.records else np.zeros(len(different), RECORD)
        return found[which]

    def logs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(log10 of the model, log10 of the base, known)`` of different keys in order."""
        met, out = self.pair_counts(keys), (np.empty(len(keys)), np.empty(len(keys)), np.empty(len(keys), bool))
        for low in range(0, len(keys), LOGS):
            for whole, part in zip(out, self._logs(keys[low : low + LOGS], met[low : low + LOGS]), strict=True):
                whole[low : low + LOGS] = part
        return out

    def _logs(self, keys: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = self.model
        first, second = self.records_of(keys >> np.uint64(32)), self.records_of(keys & np.uint64(0xFFFFFFFF))
        count, before = second["count"].astype(float), second["before"].astype(np.int64)
        total = sum(m.pairs)
        alone = np.full(len(keys), 1 / (m.size + 1)) if not total else (before - m.word_discounts[np.minimum(before, 3)]) / total + m.left / (m.size + 1)
        context = np.where(first["count"] > 0, first["count"], 1).astype(float)
        rest = (m.pair_discounts[1] * first["once"] + m.pair_discounts[2] * first["twice"] + m.pair_discounts[3] * first["more"]) / context
        p = (met - m.pair_discounts[np.minimum(met, 3)]) / context + np.where(first["count"] > 0, rest, 1.0) * alone
        return np.log10(p), np.log10((count + 1) / (m.tokens + 1 * (m.size + 1))), count > 0


def shard_edges(shards: int) -> np.ndarray:
    """The lowest hash of every shard."""
    return np.array([(i << 64) // shards for i in range(shards)], np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def count_words(texts: DataFrame, folder: str) -> tuple[list[int], int, int]:
    """Writes the sorted hashes and counts of all words and the end; ``(words per shard, tokens, texts)``."""
    shards = 1 << math.ceil(math.log2(2 * math.sqrt(texts.rdd.getNumPartitions() + 1)))  # a vocabulary grows slower than its text

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((np.array([END]), np.array([batch.num_rows], np.uint64)))
            for data, start, end, _ in word_spans(batch.column(0), byte_table(GAPS)):
                different, counts = summed(span_hashes(data, start, end))
                held.append((different, counts.astype(np.uint64)))
                n += len(different)
                if n >= HANDED // 2:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n >= HANDED // 4:
                        yield from handed_on(held)
                        held, n = [], 0
        yield from handed_on(held)

    def handed_on(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            keys, counts = summed(*map(np.concatenate, zip(*held, strict=True)))
            if len(keys):
                yield dealt(keys, counts, np.searchsorted(shard_edges(shards)[1:], keys, "right"))

    def merge(group: pa.Table) -> pa.Table:
        shard, keys, counts = gathered(group)
        put_array(f"{folder}/hashes-{shard}", keys)
        put_array(f"{folder}/numbers-{shard}", counts)
        ends = int(counts[keys == END].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": [len(keys)], "tokens": [int(counts.sum())], "texts": [ends]})

    found = texts.mapInArrow(tally, PIECES_DDL).groupBy("bucket").applyInArrow(merge, "shard int, size long, tokens long, texts long").collect()  # a row per file
    sizes = {r["shard"]: r["size"] for r in found}
    for i in set(range(shards)) - set(sizes):
        put_array(f"{folder}/hashes-{i}", np.zeros(0, np.uint64))
        put_array(f"{folder}/numbers-{i}", np.zeros(0, np.uint64))
    return [sizes.get(i, 0) for i in range(shards)], sum(r["tokens"] for r in found), sum(r["texts"] for r in found)


def count_pairs(texts: DataFrame, model: Model) -> DataFrame:
    """Writes the sorted pairs with their counts; returns ``(shard, kind, numbers, values)`` of what they tell the words.

    Kind 0 counts the pairs after a word that occur once, twice, more often, kind 1 the words before it; kind 2 has how many
    pairs of a bucket (shard) occur 1, 2, 3 and 4 times, and how many there are.
    """
    buckets, starts = len(model.pairs), np.concatenate([[0], np.cumsum(model.words)])
    starts[-1] += 1  # the start mark is with the last shard

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, n = model.opened(), [], 0
        for batch in batches:
            for _, keys in reader.pairs(batch.column(0)):
                held.append(keys)
                n += len(keys)
                if n >= HANDED:
                    yield handed_on(held)
                    n = 0
        if n:
            yield handed_on(held)

    def handed_on(held: list[np.ndarray]) -> pa.RecordBatch:
        joined = np.concatenate(held)
        held.clear()
        keys, counts = summed(joined)
        del joined
        return dealt(keys, counts, pair_bucket(keys, buckets))

    def by_shard(kind: int, numbers: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
        cuts = np.searchsorted(numbers, starts)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = cuts[i], cuts[i + 1]
            yield i, kind, planes((numbers[lo:hi] - starts[i]).astype("<u4")), planes(values[:, lo:hi].astype("<u4").ravel())

    def merge(group: pa.Table) -> pa.Table:
        bucket, keys, counts = gathered(group)
        put_array(f"{model.folder}/keys-{bucket}", keys)
        put_array(f"{model.folder}/counts-{bucket}", counts.astype("<u4" if counts.max() < 2**32 else "<u8"))
        first = keys >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        after = np.array([np.add.reduceat(test.astype(np.int64), at) for test in (counts == 1, counts == 2, counts > 2)])
        second, before = summed(keys & np.uint64(0xFFFFFFFF))
        of_counts = np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [len(keys)], "<i8")
        rows = [*by_shard(0, first[at].astype(np.int64), after), *by_shard(1, second.astype(np.int64), before[None, :]), (bucket, 2, None, of_counts.tobytes())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "kind", "numbers", "values"])

    return texts.mapInArrow(tally, PIECES_DDL).groupBy("bucket").applyInArrow(merge, "shard int, kind int, numbers binary, values binary")


def finish_words(told: DataFrame, model: Model) -> list[tuple[int, ...]]:
    """Writes a record per word; returns per shard how many words have 1, 2, 3 and 4 different words before them."""
    last = len(model.words) - 1

    def merge(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        records = np.zeros(model.words[shard] + (shard == last), RECORD)
        records["count"][: model.words[shard]] = map_array(f"{model.folder}/numbers-{shard}", np.dtype("<u8"))
        if shard == last:
            records["count"][-1] = model.texts
        for kind, numbers, values in zip(*(group[n] for n in ("kind", "numbers", "values")), strict=True):
            at = unplaned(numbers.as_py(), "<u4")
            cells = unplaned(values.as_py(), "<u4").reshape(-1, len(at))
            for name, row in zip(("once", "twice", "more") if kind.as_py() == 0 else ("before",), cells, strict=True):
                records[name][at] += row
        put_array(f"{model.folder}/records-{shard}", records)
        return pa.table({"shard": pa.array([shard], pa.int32()), **{f"n{k}": [int((records["before"] == k).sum())] for k in (1, 2, 3, 4)}})

    found = told.where("kind < 2").groupBy("shard").applyInArrow(merge, "shard int, n1 long, n2 long, n3 long, n4 long").collect()  # a row per file
    for i in set(range(len(model.words))) - {r["shard"] for r in found}:
        records = np.zeros(model.words[i] + (i == last), RECORD)
        records["count"][-1:] = model.texts if i == last else 0
        put_array(f"{model.folder}/records-{i}", records)
    return [tuple(r)[1:] for r in found]


def fit(docs: DataFrame, held: int = HELD) -> Model:
    """The model of all ``docs``: reads the texts twice, writes its arrays to the shared folder."""
    spark, texts = docs.sparkSession, _texts(docs)
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/kneser-ney-{uuid.uuid4().hex}"
    words, tokens, count = count_words(texts, folder)
    none = np.zeros(4)
    model = Model(folder, words, [], tokens, count, none, none, 0.0)
    if not tokens:
        return model
    if model.size >= 2**32 - 2:
        raise ValueError("more different words than pairs of numbers can hold")
    model.pairs = [0] * -(-tokens // held)
    told = settle(count_pairs(texts, model), "told")
    of_counts = {r["shard"]: np.frombuffer(r["values"], "<i8") for r in told.where("kind = 2").collect()}  # a row per file
    model.pairs = [int(of_counts[i][4]) if i in of_counts else 0 for i in range(len(model.pairs))]
    for i in set(range(len(model.pairs))) - set(of_counts):
        put_array(f"{folder}/keys-{i}", np.zeros(0, np.uint64))
    before = np.sum(finish_words(told, model), axis=0)
    model.pair_discounts = discounts([int(sum(v[k] for v in of_counts.values())) for k in range(4)])
    model.word_discounts = discounts([int(n) for n in before])
    d, more = model.word_discounts, model.size - int(before[0]) - int(before[1])  # every word that was met has one before it
    model.left = float(d[1] * before[0] + d[2] * before[1] + d[3] * more) / sum(model.pairs)
    return model


def text_sums(reader: Reader, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Per text its tokens, those known, and the sums of both logarithms; ``AT_ONCE`` tokens and a piece of text are looked up at once."""
    rows = len(texts)
    sums = tuple(np.zeros(rows) for _ in range(4))
    held, size = [], 0

    def close() -> None:
        row, keys = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        different, which = np.unique(keys, return_inverse=True)
        logs, plain, met = reader.logs(different)
        for out, values in zip(sums, (None, met, plain, logs), strict=True):
            out += np.bincount(row, None if values is None else values[which], minlength=rows)

    for row, keys in reader.pairs(texts):
        held.append((row, keys))
        size += len(keys)
        if size >= AT_ONCE:
            close()
            size = 0
    if held:
        close()
    return sums


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score, perplexity)`` of every row: a narrow pass over mapped arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.opened()
        for batch in batches:
            n, known, base, total = text_sums(reader, batch.column(1))
            columns = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / np.maximum(n, 1), 300))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def score_with_folds(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Learns from rows outside ``fold``; scores every row, marked with ``held_out``."""
    mine = held_out(F.col("doc_id"), folds, fold)
    model = fit(docs.where(~mine))
    found = score(docs, model).withColumns({"held_out": mine, "train_tokens": F.lit(model.tokens).cast("long")})
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
