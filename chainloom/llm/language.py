"""Language identification by error-correcting output codes.

Each language owns a codeword; one linear classifier per code bit reads the hashed character
n-grams of a text and predicts that bit.  Decoding adds the logistic loss of every bit against
every codeword and takes the nearest word, so single wrong bits are outvoted; a small gap between
the two nearest words marks the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import hash_order_sample, held_out, map_rows
from chainloom.llm.hashing import char_grams, counted, segments

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
#: A text of n n-grams belongs to no learned language if its smallest loss, per code bit, is beyond FAR + NOISE / sqrt(n);
#: ln 2 is the loss of a text that says nothing.  Set on the labelled rows of the small ``documents`` table.
FAR, NOISE = 0.4, 2.0
LENGTHS = (2, 3, 4)
#: Bytes that are no ASCII letter and no part of a longer character read as a blank.
BLANKED = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +-1.  Up to 7 classes: the exhaustive code; more: the best of 200 random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(200)]
    return min(tries, key=lambda m: np.max(m @ m.T - 2 * bits * np.eye(n)))


def grams(text: str, bits: int) -> Iterator[list[np.ndarray]]:
    """Buckets of the byte 2- to 4-grams of a lower-cased text, segment by segment."""
    for part in segments(text.lower().encode("utf-8", "replace")):
        yield char_grams(BLANKED[part], LENGTHS, bits)


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


@dataclass
class LanguageModel:
    """classes; +-1 codewords [class, bit]; weights [bucket, bit]; bias [bit]."""

    classes: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Loss-weighted decoding: class, its softmax share, and whether the runner-up is close."""
        loss = np.logaddexp(0, -self.code * margins).sum(axis=1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(np.argmax(share))
        rest = np.delete(share, best)
        return self.classes[best], float(share[best]), bool(rest.size and share[best] - rest.max() < 0.2)


def _features(texts: list, bits: int) -> Iterator[tuple[bytes, bytes]]:
    for text in texts:
        total = sum((counted(g, bits) for g in grams(text, bits)), np.zeros(1 << bits, np.int64))
        ids = np.flatnonzero(total)
        yield ids.astype(np.uint16).tobytes(), (total[ids] / max(1, total.sum())).astype(np.float32).tobytes()


def train(labelled: DataFrame, max_rows: int = 1500, bits: int = 15, epochs: int = 6, rate: float = 60.0, seed: int = 7) -> LanguageModel:
    """Fit on ``(doc_id, text, lang)``.

    At most ``max_rows`` rows take part, chosen by the hash of doc_id; the set of languages comes from
    all rows.  Texts are turned into n-gram counts on the executors; stochastic gradient descent on
    those sparse rows runs in numpy.  No rows at all give a model without classes.
    """
    clean = labelled.where("lang is not null and text is not null")
    classes = sorted(r[0] for r in clean.select("lang").distinct().collect())
    code = codewords(len(classes))

    def rows(c):
        yield from zip(c["lang"], *zip(*_features(c["text"], bits), strict=True), strict=True)

    picked = hash_order_sample(clean.select("doc_id", "lang", "text"), "doc_id", max_rows)
    data = map_rows(picked, rows, "lang string, ids binary, parts binary").collect()
    weights, bias = np.zeros((1 << bits, code.shape[1])), np.zeros(code.shape[1])
    data = sorted(((r.lang, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.parts, np.float32)) for r in data), key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(len(data)):
            lang, ids, parts = data[i]
            target = code[classes.index(lang)]
            margin = parts @ weights[ids] + bias
            pull = target / (1 + np.exp(target * margin))
            weights[ids] += rate / (1 + epoch) * parts[:, None] * pull
            bias += 0.05 / (1 + epoch) * pull
    return LanguageModel(classes, code, weights.astype(np.float32), bias)


def margins(text: str, model: LanguageModel) -> tuple[np.ndarray, int]:
    """The margin of every code bit, and how many n-grams they average."""
    total, n = np.zeros(model.code.shape[1]), 0
    for g in (g for part in grams(text, model.weights.shape[0].bit_length() - 1) for g in part):
        total += np.ones(len(g), np.float32) @ model.weights.take(g, axis=0)
        n += len(g)
    return total / max(1, n) + model.bias, n


def verdict(text: str | None, model: LanguageModel) -> tuple[str, float, bool]:
    """Language, score and ambiguity of one text."""
    if not model.classes or not has_letter(text):
        return UNDETERMINED, 0.0, False
    return model.decode(margins(text, model)[0])


def is_recognised(text: str | None, model: LanguageModel) -> bool:
    """Whether the text has a letter and, if the model has classes, lies near the codeword of one of them."""
    if not has_letter(text) or not model.classes:
        return has_letter(text)
    found, n = margins(text, model)
    loss = np.logaddexp(0, -model.code * found).mean(axis=1).min()
    return bool(loss <= FAR + NOISE / np.sqrt(max(1, n)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)``, one row per row of ``docs``; reads doc_id and text only.

    Null texts and texts without a letter are ``und`` with score 0.  Texts of any length are read whole
    and in one pass.  Repeated rows get
    repeated results, an empty table an empty one; a null doc_id stays null.
    """


    def rows(c):
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            yield doc_id, *verdict(text, model)

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows whose text is null, has no letter or is far from every learned language; narrow, all columns stay.

    Ambiguous texts stay: short clean documents are often ambiguous.  A model without classes knows only
    the rule of letters.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([is_recognised(t, model) for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify_with_folds(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the rows outside ``fold`` and predict every row, marked with ``held_out``."""
    model = train(docs.where(~held_out(F.col("doc_id"), folds, fold)).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "ambiguous")
