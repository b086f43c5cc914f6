"""Quality scores from supervised subword embeddings.

A text is the mean of learned vectors of its hashed words, word pairs and character n-grams; a softmax
layer on that mean gives the class.  Fitting is plain stochastic gradient descent in numpy on a
bounded labelled sample; scoring is a narrow pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import hash_order_sample, held_out, map_rows
from chainloom.llm.hashing import char_grams, counted, segments, word_grams, word_hashes

LENGTHS = (3, 4, 5)


def grams(text: str | None, bits: int) -> Iterator[list[np.ndarray]]:
    """Buckets of the words, word pairs and byte 3- to 5-grams of a text, segment by segment."""
    for part in segments((text or "").encode("utf-8", "replace")):
        yield word_grams(word_hashes(part), bits) + char_grams(part, LENGTHS, bits)


@dataclass
class QualityModel:
    """vectors [bucket, dim], output [dim, 2], bias [2]; a text without words scores by the bias."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def lean(self) -> np.ndarray:
        """Per bucket the pull of class 1 over class 0: the softmax of two classes needs only that."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])


def _counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    total = sum((counted(g, bits) for g in grams(text, bits)), np.zeros(1 << bits, np.int64))
    ids = np.flatnonzero(total)
    return ids.astype(np.uint16), (total[ids] / max(1, total.sum())).astype(np.float32)


def train(labelled: DataFrame, max_rows: int = 1500, bits: int = 15, dim: int = 12, epochs: int = 8, rate: float = 2.0, seed: int = 3) -> QualityModel:
    """Fit on ``(doc_id, text, quality)``; at most ``max_rows`` rows, chosen by the hash of doc_id.

    Rows with a null label are left out.  Without any row the model scores 0.5 everywhere.
    """

    def rows(c):
        for label, text in zip(c["quality"], c["text"], strict=True):
            ids, parts = _counts(text, bits)
            yield int(label), ids.tobytes(), parts.tobytes()

    picked = hash_order_sample(labelled.where("quality in (0, 1)").select("doc_id", "quality", "text"), "doc_id", max_rows)
    found = map_rows(picked, rows, "label int, ids binary, parts binary").collect()
    data = sorted(((r.label, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.parts, np.float32)) for r in found), key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))
    rng = np.random.default_rng(seed)
    vectors, output, bias = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)), np.zeros((dim, 2)), np.zeros(2)
    steps, step = max(1, epochs * len(data)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            label, ids, parts = data[i]
            mean = parts @ vectors[ids]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            now = rate * (1 - step / steps)
            pull = output @ p
            output -= now * mean[:, None] * p
            bias -= 0.05 * now * p
            vectors[ids] -= now * 20 * parts[:, None] * pull
            step += 1
    return QualityModel(vectors, output, bias)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` per row of ``docs``; reads doc_id and text only.

    Null and empty texts score by the bias alone.  Whole texts of any length count; repeated rows,
    null ids and empty tables pass through unchanged in number.
    """
    lean, bias = model.lean(), float(model.bias[1] - model.bias[0])  # travel with the task: as many floats as buckets

    bits = len(lean).bit_length() - 1

    def rows(c):
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            pull, n = 0.0, 0
            for g in (g for part in grams(text, bits) for g in part):
                pull, n = pull + float(lean.take(g).sum()), n + len(g)
            p = float(1 / (1 + np.exp(-np.clip(pull / max(n, 1) + bias, -60, 60))))
            yield doc_id, p, int(p >= threshold)

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, score double, predicted int")


def score_with_folds(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, max_rows: int = 1500) -> DataFrame:
    """Learn from labelled rows outside ``fold``; score every document, marked with ``held_out``.

    A document with several label rows counts once, with the smaller label.
    """
    marks = labels.where(~held_out(F.col("doc_id"), folds, fold)).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = hash_order_sample(marks, "doc_id", max_rows)  # bounds the broadcast; texts of other documents are not moved
    model = train(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"), max_rows)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
