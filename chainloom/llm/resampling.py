"""Importance resampling towards the distribution of a target table.

Texts become bags of hashed word n-grams.  A bucket's gain is the scaled log ratio of its smoothed shares in target
and source; a document's weight is the sum of its features' gains; Gumbel noise that follows from the id
turns the largest scores into a sample without replacement.

Buckets are CRC-32 remainders.  The checksum is linear, so it is the XOR of one table entry per byte, looked up by
the byte and its distance from the end of the feature, and of a constant for the length: one gather
and one ``bitwise_xor.reduceat`` over the feature spans of a piece.  Spans longer than the table are cut into blocks
from their end, which are folded from the first on by advancing the register over a block of zeros.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.spans import byte_table, word_spans
from chainloom.operators.results import ranked
from chainloom.storage import settle

#: Bytes other than digits, letters and those of characters beyond ASCII.
GAPS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
BLOCK = 64
POLYNOMIAL = 0xEDB88320


def _advance(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers after one more zero byte."""
    return (register >> np.uint32(8)) ^ table[register & np.uint32(255)]


def position_table(size: int = BLOCK) -> np.ndarray:
    """``[distance from the end, byte]``: what a byte there adds to the checksum."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = (register >> np.uint32(1)) ^ np.where(register & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    rows = [register]
    while len(rows) < size:
        rows.append(_advance(rows[0], rows[-1]))
    return np.array(rows, np.uint32)


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of each non-empty span of ``data``; spans may overlap."""
    size, block = end - start, len(table)
    if not len(size):
        return np.zeros(0, np.uint32)
    blocks = -(-size // block)
    parts = np.repeat(np.arange(len(size)), blocks)  # of each span its blocks, the first of which may be short
    place = np.arange(len(parts)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    hi = end[parts] - (blocks[parts] - 1 - place) * block
    lo = np.maximum(start[parts], hi - block)
    length = hi - lo
    first = np.cumsum(length) - length
    byte = np.arange(int(length.sum())) - np.repeat(first - lo, length)
    linear = np.bitwise_xor.reduceat(table[np.repeat(hi, length) - 1 - byte, data[byte]], first)
    found = linear[np.cumsum(blocks) - blocks]
    for step in range(1, int(blocks.max())):
        more = np.flatnonzero(blocks > step)
        register = found[more]
        for _ in range(block):
            register = _advance(table[0], register)
        found[more] = register ^ linear[(np.cumsum(blocks) - blocks)[more] + step]
    lengths, which = np.unique(size, return_inverse=True)
    return found ^ np.array([zlib.crc32(bytes(n)) for n in lengths.tolist()], np.uint32)[which]


def features(texts: pa.Array, least: int, most: int, table: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row of each word, row of each feature, CRC-32 of each feature)``, piece by piece of a text column."""
    held, of = [], -1  # the last words of the text that the next piece may go on with
    for data, start, end, row in word_spans(texts, gaps):
        if not len(start):
            continue
        if most == 1:
            yield row, row, crc_spans(data, start, end, table)
            continue
        words = [data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        before = held if of == row[0] else []
        words, rows = before + words, np.concatenate([np.full(len(before), row[0]), row])
        line = np.frombuffer(b" ".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size + 1) - size - 1
        of_row, crc = [], []
        for n in range(least, most + 1):
            last = np.arange(max(n - 1, len(before)), len(words))
            last = last[rows[last] == rows[last - n + 1]]
            of_row.append(rows[last])
            crc.append(crc_spans(line, begin[last - n + 1], begin[last] + size[last], table))
        yield row, np.concatenate(of_row), np.concatenate(crc)
        of = int(rows[-1])
        held = words[max(int(np.searchsorted(rows, of)), len(words) - most + 1) :]


def bucket_counts(docs: DataFrame, least: int, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    table, gaps = position_table(), byte_table(GAPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc in features(batch.column(0), least, most, table, gaps):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["bucket", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row per bucket
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 * ln(smoothed share in the target / smoothed share in the source))``."""
    n = len(source)
    up, down = (target + 1.0) * (source.sum() + float(n)), (source + 1.0) * (target.sum() + float(n))
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, least: int = 1, most: int = 1) -> DataFrame:
    """``(doc_id, words, n_features, weight)`` of every row: a narrow pass."""
    table, gaps, buckets = position_table(), byte_table(GAPS), np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for of_word, of_feature, crc in features(batch.column(1), least, most, table, gaps):
                words += np.bincount(of_word, minlength=len(words))
                n += np.bincount(of_feature, minlength=len(n))
                np.add.at(weight, of_feature, gain[crc % buckets])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, n, weight))], names=["doc_id", "words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, runs: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` numbers those that are drawn.

    Texts without words have weight 0 and, like all below ``least_words``, are not drawn.  A null text has no words; null
    ids share the noise of the word null and come last among ties; repeated rows are rows of their own.
    An empty target gives every bucket the gain of an unseen one; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, *runs, buckets), bucket_counts(target, *runs, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed(docs, gain, *runs).select("doc_id", "words", "n_features", "weight", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("__row"))
    scored = settle(scored, "scored")
    able = scored.where(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    placed = ranked(able, order, "rank", "long").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: Words and checksums in SQL: bytes from hexadecimal digits, the checksum's table from its polynomial.
RESAMPLE_SQL = r"""
WITH RECURSIVE crc(b, step, r) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT b, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM crc WHERE step < 8
),
tab AS (SELECT list(r ORDER BY b) AS t FROM crc WHERE step = 8),
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, item_id, text FROM benchmark
),
numbered AS (SELECT side, id, row_number() OVER () AS n, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM texts),
words AS (SELECT side, n, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM numbered),
distinct_words AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM distinct_words, tab
),
cells AS (SELECT side, n, bucket, count(*) AS k FROM words JOIN hashed USING (w) GROUP BY ALL),
sides AS (SELECT b.i AS bucket, coalesce(sum(k) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 1), 0)::DOUBLE AS t FROM range(10000) b(i) LEFT JOIN cells ON bucket = b.i GROUP BY b.i),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sides),
bags AS (SELECT n, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM cells JOIN gains USING (bucket) WHERE side = 0 GROUP BY n),
scored AS (
  SELECT d.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(d.id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM numbered d LEFT JOIN bags USING (n) WHERE d.side = 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= eligible * 10 // 100 THEN r END AS rank FROM placed
"""
