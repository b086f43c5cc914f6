import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from chainloom.llm import resampling, spans

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text, least, most):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(raw)
    return words, [b" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, targets, least=1, most=1, percent=10, least_words=20, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in bag(t, least, most)[1])
    s, t = count(x for _, x in docs), count(targets)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for doc_id, text in docs:
        words, features = bag(text, least, most)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in features)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(4)
    texts = [prose(rng.choice([0, 5, 19, 20, 21, 60]), i) for i in range(150)]
    texts += ["Ä ÄÖ ü" * 40, "A-B_c9" * 50, "x" * 700 + " " + "日本語" * 300, None, "", "\n\t --", "Word " * 20_000, texts[5], texts[5]]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(None, texts[5]), (None, texts[5]), (3, texts[9])]


@pytest.mark.parametrize("runs", [(1, 1), (1, 2), (2, 3)])
def test_equals_brute_force(spark, make, prose, rows, runs):
    targets = [prose(40, 7), None, "", prose(30, 9), "日本語" * 300]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = resampling.resample(make(rows).repartition(5), target, runs=runs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, targets, *runs)


def test_twin(prose, rows):
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841
    benchmark = pa.table({"item_id": [1, 2], "text": [prose(40, 7), None]})  # noqa: F841
    assert sorted(duckdb.sql(resampling.RESAMPLE_SQL).fetchall(), key=str) == brute(rows, [prose(40, 7)])


def test_checksums_by_position():
    rng = random.Random(1)
    words = [rng.randbytes(rng.choice([1, 2, 5, 63, 64, 65, 127, 128, 129, 1000])) for _ in range(300)]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    found = resampling.crc_spans(data, end - [len(w) for w in words], end, resampling.position_table())
    assert found.tolist() == [zlib.crc32(w) for w in words]
    assert resampling.crc_spans(data, end[:0], end[:0], resampling.position_table()).tolist() == []


@pytest.mark.parametrize("at_once", [1, 7, 50, 1 << 20])
def test_pieces_hold_whole_words_of_one_text(at_once):
    texts = ["ab cd", None, "", "ef", "ghghghghghghghghgh i", " ", "j" * 40 + "  k", "é ü"]
    table = spans.byte_table(b" \t\n\r\x0b\x0c")
    column = pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts))
    got = [(int(r), data[s:e].tobytes().decode()) for data, start, end, row in spans.word_spans(column, table, at_once) for s, e, r in zip(start, end, row, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]


def test_empty_tables(spark, make, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(make([]), none).count() == 0
    got = resampling.resample(make(rows), none).collect()
    assert len(got) == len(rows) and sum(r["rank"] is not None for r in got) == sum(len(bag(t, 1, 1)[0]) >= 20 for _, t in rows) // 10
