"""Whitening of embeddings by singular values of their centred rows.

Blocks of centred rows are reduced to triangular factors, those in a tree of fixed fan-in to one R, whose size is
that of the dimensions.  Householder reflections bring R to an upper bidiagonal B; dqds finds its singular
values from the smallest on, each to high relative accuracy; a twisted factorisation of B'B - s^2
gives the right singular vector of each leading value.  The covariance itself is never formed, so small
variances do not drown in the squares of large ones.

Null vectors, empty vectors and vectors with a null or non-finite entry are left out; vectors of another length than
most (of equally many the longer) have no place in one covariance and are left out too.  Repeated rows
and null ids count as rows.  A component without variance has null ``whitened`` and explained 0; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.storage import settle

SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond this count as this.
EXTREME = 2**40
#: Triangular factors that one task folds in a round of the reduction.
FAN_IN = 64
EPS = np.finfo(float).eps


def rows_of(batch: pa.RecordBatch, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, x)`` per vector length in the batch (or of length ``dim`` only): x as whole numbers, rows with gaps left out."""
    lists = batch.column(batch.schema.get_field_index("embedding"))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    for length in [dim] if dim else np.unique(size[size > 0]):
        here = np.flatnonzero(size == length)
        c = values[first[here][:, None] + np.arange(length)]
        whole = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            yield here[whole], np.clip(np.floor(SCALE * c[whole]), -EXTREME, EXTREME).astype(np.int64) + SHIFT


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def moments(embeddings: DataFrame) -> tuple[int, list[int]]:
    """``(n, sums)`` over the fit list, exact; its length is the number of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        as_rows = lambda: pa.RecordBatch.from_pydict({"length": list(held), "n": [h[0] for h in held.values()], "sums": [h[1] for h in held.values()]}, schema)
        for batch in batches:
            for at, x in rows_of(batch):
                n, sums = held.get(x.shape[1], (0, 0))
                held[x.shape[1]] = [n + len(at), sums + x.sum(axis=0)]
            if sum(h[0] for h in held.values()) >= 1 << 20:  # so many rows of extreme entries fit a long
                yield as_rows()
                held = {}
        if held:
            yield as_rows()

    schema = pa.schema([("length", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    parts = _vectors(embeddings).mapInArrow(run, "length int, n long, sums array<long>")
    cells = parts.select("length", "n", F.posexplode("sums").alias("at", "part"))
    total = settle(cells.groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("sum")), "moments")
    best = total.where("at = 0 and n > 0").orderBy(F.desc("n"), F.desc("length")).limit(1).select("length")
    found = sorted(total.join(F.broadcast(best), "length").collect(), key=lambda r: r["at"])  # one row per dimension
    return (found[0]["n"], [int(r["sum"]) for r in found]) if found else (0, [])


@dataclass
class Centre:
    """The mean as whole numbers: ``x - S/n`` is ``(n * (x - whole) - rest) / n``."""

    n: int
    sums: list[int]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.parts()
        return (x - whole) - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of ``(n * x - S)^2``; null beyond a long."""
        whole, rest = self.parts()
        near = ((self.n * (x - whole).astype(float) - rest) ** 2).sum(axis=1)
        out: list[int | None] = [None] * len(x)
        small = np.flatnonzero(near < 2.0**62)
        for i, d in zip(small.tolist(), ((self.n * (x[small] - whole) - rest) ** 2).sum(axis=1).tolist(), strict=True):
            out[i] = d
        for i in np.flatnonzero((near >= 2.0**62) & (near < 2.0**64)).tolist():
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums, strict=True))
            out[i] = exact if exact < 2**63 else None
        return out


def folded(r: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The triangular factor of ``r`` on top of ``block``, padded to be square."""
    found = np.linalg.qr(np.vstack([r, block]), mode="r")
    out = np.zeros((block.shape[1], block.shape[1]))
    out[: len(found)] = found
    return out


def triangular(embeddings: DataFrame, centre: Centre) -> np.ndarray:
    """R of all centred rows: ``R'R / n`` is their covariance."""
    dim = centre.dim

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, n = np.zeros((dim, dim)), [], 0
        for batch in batches:
            for _, x in rows_of(batch, dim):
                held.append(centre.centred(x))
                n += len(x)
            if n >= 4 * dim:
                r, held, n = folded(r, np.vstack(held)), [], 0
        yield from packed(folded(r, np.vstack(held)) if n else r)

    def reduce_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((dim, dim))
        for batch in batches:
            for blob in batch.column(0):
                r = folded(r, np.frombuffer(blob.as_py()).reshape(dim, dim))
        yield from packed(r)

    def packed(r: np.ndarray) -> Iterator[pa.RecordBatch]:
        if r.any():
            yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]}, pa.schema([("r", pa.binary())]))

    rows = _vectors(embeddings)
    parts, now = rows.rdd.getNumPartitions(), rows.mapInArrow(reduce_rows, "r binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        now = now.repartition(parts).mapInArrow(reduce_factors, "r binary")
    found = now.collect()  # one factor
    return np.frombuffer(found[0]["r"]).reshape(dim, dim) if found else np.zeros((dim, dim))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, w)``: diagonal, superdiagonal and right factor of ``r = u @ bidiag(a, b) @ w.T``, by Householder reflections."""
    m = r.astype(float).copy()
    n = len(m)
    w = np.eye(n)

    def mirror(x: np.ndarray) -> tuple[np.ndarray, float]:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        return v, 2 / (v @ v) if v.any() else 0.0

    for k in range(n):
        v, beta = mirror(m[k:, k])
        m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k < n - 2:
            v, beta = mirror(m[k, k + 1 :])
            m[k:, k + 1 :] -= beta * np.outer(m[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= beta * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step with a shift: ``(q, e, d)``; ``d`` below zero means the shift was too large."""
    n, d = len(q), q[0] - shift
    nq, ne, ds = [0.0] * n, [0.0] * (n - 1), [d] * n
    for k in range(n - 1):
        nq[k] = d + e[k]
        t = q[k + 1] / nq[k] if nq[k] else 0.0
        ne[k] = e[k] * t
        d = (d * t if nq[k] else q[k + 1]) - shift
        ds[k + 1] = d
    nq[-1] = d
    return nq, ne, ds


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal, falling.

    A step without shift tells how far the smallest lies above zero (the trace of the inverse bounds it from below), the
    next takes that bound as its shift, so no value is ever lost to a shift beyond it.  What has come
    to rest at the end is split off.
    """
    out: list[float] = []
    todo = [((a**2).tolist(), (b**2).tolist(), 0.0)]
    while todo:
        q, e, base = todo.pop()
        while len(q) > 1:
            tiny = [k for k in range(len(e)) if e[k] <= EPS**2 * (base + q[k] + q[k + 1]) or e[k] == 0.0]
            if tiny:
                k = tiny[-1]
                todo.append((q[: k + 1], e[:k], base))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            q, e, d = _transform(q, e, 0.0)
            least = min(d)
            if least <= 0.0:
                continue  # a zero has moved to the end; the next step splits it off
            shift = (1 - 8 * EPS) / sum(1 / x for x in d)
            if shift <= EPS**2 * base:
                continue
            nq, ne, d = _transform(q, e, shift)
            if min(d) >= 0.0:
                q, e, base = nq, ne, base + shift
        out.append(base + max(0.0, q[0]))
    return np.array(sorted(out, reverse=True))


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray]:
    """``(order, vector)`` of ``B'B - value``: twist positions from the smallest residual on, and a function from one to its vector.

    A factorisation from the top and one from the bottom meet at the twist, where the residual is smallest; the
    vector follows from there outwards by products alone.
    """
    n, floor = len(a), EPS * max(value, np.finfo(float).tiny)
    d, l = a**2, np.append(b / a[:-1], 0.0)  # noqa: E741
    s, plus, down = np.empty(n), np.empty(n - 1), -value
    for k in range(n - 1):
        s[k] = down
        pivot = down + d[k]
        plus[k] = d[k] * l[k] / (pivot if abs(pivot) > floor * EPS else floor * EPS)
        down = plus[k] * l[k] * down - value
    s[-1] = down
    p, minus, up = np.empty(n), np.empty(n - 1), d[-1] - value
    p[-1] = up
    for k in range(n - 2, -1, -1):
        pivot = d[k] * l[k] ** 2 + up
        t = d[k] / (pivot if abs(pivot) > floor * EPS else floor * EPS)
        minus[k] = l[k] * t
        up = up * t - value
        p[k] = up
    gamma = s + p + value
    order = np.argsort(np.where(np.isfinite(gamma), np.abs(gamma), np.inf), kind="stable")

    def vector(r: int) -> np.ndarray:
        z = np.zeros(n)
        z[r] = 1.0
        for k in range(r - 1, -1, -1):
            z[k] = -plus[k] * z[k + 1]
        for k in range(r, n - 1):
            z[k + 1] = -minus[k] * z[k]
        return z / np.linalg.norm(z)

    return order, vector


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(squared singular values, right singular vectors as columns)`` of ``r``, the ``count`` largest.

    Where values lie close together their vectors are made orthogonal to those found before, from the first twist
    that leaves enough of a vector; a block that the bidiagonal falls into is solved by itself.
    """
    a, b, w = bidiagonal(r)
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < EPS**2 * size, EPS**2 * size, a)  # keeps quotients finite
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * 1e-3 * size) + 1).tolist(), len(a)]
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        ab, bb = a[lo:hi], b[lo : hi - 1]
        values, near = dqds(ab, bb)[:count], []
        for value in values.tolist():
            near = [(v, z) for v, z in near if v - value <= 1e-3 * v]
            best = np.ones(1)
            if hi - lo > 1 and value > 0:
                order, vector = twisted(ab, bb, value)
                best, most = None, -1.0
                for twist in order[: len(near) + 2].tolist():
                    z = vector(twist)
                    for _ in range(2):
                        for _, y in near:
                            z = z - (z @ y) * y
                    left = np.linalg.norm(z)
                    if left > most:
                        best, most = z / max(left, np.finfo(float).tiny), left
                    if most > 0.5:
                        break
            elif hi - lo > 1:
                best = np.zeros(hi - lo)  # without variance: no direction is asked for
            near.append((value, best))
            found.append((value, lo, best))
    found = sorted(found, key=lambda x: (-x[0], x[1]))[:count]
    columns = np.zeros((len(a), len(found)))
    for i, (_, lo, z) in enumerate(found):
        columns[lo : lo + len(z), i] = z
    return np.array([f[0] for f in found]), w @ columns


@dataclass
class Whitening:
    """centre, eigenvalues of the covariance and unit directions as columns; ``trace`` is that of the covariance."""

    centre: Centre
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def known(self) -> np.ndarray:
        """Which components have a variance that is more than rounding."""
        return self.values > self.trace * (len(self.directions) * EPS) ** 2

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions / np.sqrt(np.where(self.known(), self.values, np.nan))


def fit(embeddings: DataFrame, components: int = 8) -> Whitening | None:
    """The leading components of the table's covariance; None without any usable vector.  Reads the vectors twice."""
    n, sums = moments(embeddings)
    if not n:
        return None
    centre = Centre(n, sums)
    r = triangular(embeddings, centre)
    values, directions = leading(r, components)
    return Whitening(centre, values / n, directions, float((r**2).sum() / n))


def identity_error(embeddings: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; None without a component that has variance."""
    known = np.flatnonzero(model.known())
    width = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + width * width)
        for batch in batches:
            for _, x in rows_of(batch, model.centre.dim):
                y = model.project(x)[:, known]
                total += np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_pydict({"sums": [total.tolist()]}, pa.schema([("sums", pa.list_(pa.float64()))]))

    if not width:
        return None
    cells = _vectors(embeddings).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "part"))
    found = sorted(cells.groupBy("at").agg(F.sum("part").alias("sum")).collect())  # a row per pair of components
    sums = np.array([r["sum"] for r in found]) / model.centre.n
    mean = sums[:width]
    return float(np.abs(sums[width:].reshape(width, width) - np.outer(mean, mean) - np.eye(width)).max())


def whiten(embeddings: DataFrame, model: Whitening | None = None, components: int = 8) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row per usable vector and component.

    ``deviation`` is exact and null beyond a long; ``identity_error`` is measured on all whitened rows.
    """
    model = model or fit(embeddings, components)
    spark = embeddings.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], kind)
    error, centre, width = identity_error(embeddings, model), model.centre, len(model.values)
    explained = np.where(model.known(), model.values / max(model.trace, np.finfo(float).tiny), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in rows_of(batch, centre.dim):
                rows = len(at)
                whitened = model.project(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, width))),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * width, centre.n, np.int64)),
                        pa.array([d for d in centre.deviations(x) for _ in range(width)], pa.int64()),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(np.tile(explained, rows)),
                        pa.array([error] * (rows * width), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return _vectors(embeddings).mapInArrow(run, kind)
