"""Embedding near-duplicates by dual traversal of cover trees: exact threshold pairs.

Vectors of unit length are grouped around centres into cells, cells too large for a block around centres of their own, and so on; a cell is
a block, neighbouring blocks are a tile.  Blocks and tiles carry a centre and a covering radius.  Every block gets its cover tree once, nested levels of
centres with halving radii, and travels with it.  Two tiles meet in a task only if the radii of two of their blocks leave room
for a pair within the distance; there two blocks are compared only if theirs do, by descending both trees
together and dropping a pair of nodes when the distance of their points exceeds the threshold plus both
covering radii.  Equal vectors are one point with a multiplicity, and a task hands on link counts and a
spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.simhash import join_roots
from chainloom.operators.components import connected_components
from chainloom.storage import settle

#: Numbers (vectors times dimension) and vectors per block; neighbouring cells per tile; centres that attract vectors, at each division.
BLOCK_VALUES, BLOCK, CELLS, CENTRES = 1 << 18, 4096, 8, 64
#: Vectors of a cell from which the centres of its division come; vectors that a task gives their centre; divisions by centres.
PICKED, DEALT, DIVISIONS = 256, 512, 16
#: Blocks that a wide cell makes at most where it falls into clumps, and the radius from which a cell counts as wide.
CLUMPS, NARROW = 8, 0.25
#: Tile heads that one task compares with as many others.
HEADS = 64
#: Slack of the pruning in single precision; every link is decided in double precision.
SLACK = 1e-4
#: What sums of products in single precision may lack.
ROUNDING = 1e-5
#: Bytes of vectors gathered for pairs at once.
GATHERED = 1 << 27


class CoverTree:
    """Levels 0..L over the rows of ``points``: level l has centres no two of which are within ``radius[l]``.

    ``nodes[l]`` are point indices (nested: a centre stays one on all deeper levels), ordered so that the
    children of node k on level l are ``nodes[l + 1][begin[l][k]:begin[l][k + 1]]``; ``cover[l][k]`` is the
    distance from the node to its farthest descendant.  The last level holds every point.
    """

    @classmethod
    def packed(cls, points: np.ndarray, data: bytes) -> CoverTree:
        """The tree over ``points`` that :meth:`pack` wrote down."""
        self, at = cls.__new__(cls), 0

        def read(kind: type, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(data, kind, n, at - n * np.dtype(kind).itemsize)

        sizes = read(np.int32, int(read(np.int32, 1)[0])).tolist()
        self.points, self.nodes = points, [read(np.int32, n) for n in sizes]
        self.begin = [read(np.int32, n + 1) for n in sizes[:-1]]
        self.cover = [read(np.float32, n) for n in sizes]
        return self

    def pack(self) -> bytes:
        """Nodes, children and covering radii; these are rounded up to single precision."""
        cover = [np.nextafter(c.astype(np.float32), np.float32(np.inf)) for c in self.cover]
        head = np.array([len(self.nodes), *map(len, self.nodes)], np.int32)
        return b"".join(c.tobytes() for c in [head, *(c.astype(np.int32) for c in self.nodes + self.begin), *cover])

    def __init__(self, points: np.ndarray, top: float = 2.0, bottom: float = 0.1) -> None:
        n = len(points)
        self.points, parents, levels, radius = points, [], [np.zeros(min(n, 1), np.int64)], top
        while radius / 2 >= bottom:
            radius /= 2
            nodes, parent = self._refine(levels[-1], radius)
            levels.append(nodes)
            parents.append(parent)
        rest = np.setdiff1d(np.arange(n), levels[-1])
        owner = self._nearest(rest, levels[-1])[0]
        parents.append(np.concatenate([np.arange(len(levels[-1])), owner]))
        levels.append(np.concatenate([levels[-1], rest]))
        self.nodes, self.begin = [levels[0]], []
        place = np.arange(len(levels[0]))
        for nodes, parent in zip(levels[1:], parents, strict=True):
            moved = place[parent]
            order = np.argsort(moved, kind="stable")
            self.begin.append(np.searchsorted(moved[order], np.arange(len(self.nodes[-1]) + 1)))
            self.nodes.append(nodes[order])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
        reach = [np.zeros(len(self.nodes[-1]))]
        for k in range(len(self.begin) - 1, -1, -1):
            mine = np.repeat(np.arange(len(self.nodes[k])), np.diff(self.begin[k]))
            step = np.linalg.norm(points[self.nodes[k]][mine] - points[self.nodes[k + 1]], axis=1) + reach[0]
            far = np.zeros(len(self.nodes[k]))
            np.maximum.at(far, mine, step)
            reach.insert(0, far)
        self.cover = reach

    def _nearest(self, some: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, dist = np.zeros(len(some), np.int64), np.full(len(some), np.inf)
        for s in range(0, len(some), 1024):
            d2 = 2 - 2 * self.points[some[s : s + 1024]] @ self.points[centres].T
            at[s : s + 1024] = d2.argmin(axis=1)
            dist[s : s + 1024] = np.sqrt(np.maximum(d2.min(axis=1), 0))
        return at, dist

    def _refine(self, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The next level: old centres stay, points farther than ``radius`` from all become centres; with parents."""
        n, nodes = len(self.points), list(centres)
        fresh = np.setdiff1d(np.arange(n), centres)
        for s in range(0, len(fresh), 512):
            part = fresh[s : s + 512]
            far = self._nearest(part, np.array(nodes))[1] > radius
            part = part[far]
            close = 2 - 2 * self.points[part] @ self.points[part].T <= radius * radius
            open_ = np.ones(len(part), bool)
            for i in range(len(part)):
                if open_[i]:
                    nodes.append(part[i])
                    open_ &= ~close[i]
                    open_[i] = False
        nodes = np.array(nodes)
        parent = np.concatenate([np.arange(len(centres)), self._nearest(nodes[len(centres) :], centres)[0]])
        return nodes, parent


def _expand(begin: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of the listed nodes, and which entry each comes from."""
    count = begin[nodes + 1] - begin[nodes]
    entry = np.repeat(np.arange(len(nodes)), count)
    return np.repeat(begin[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum()), entry


def dual_pairs(a: CoverTree, b: CoverTree, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of points (row of a, row of b) within about ``threshold``; with ``same`` each pair once."""

    at_once = max(1024, GATHERED // (8 * max(1, a.points.shape[1])))

    def descend(level: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        last = len(a.nodes) - 1
        while len(x):
            if level == last:
                if same:
                    x, y = x[x < y], y[x < y]
                yield a.nodes[level][x], b.nodes[level][y]
                return
            one, two = np.diff(a.begin[level])[x], np.diff(b.begin[level])[y]
            if len(x) > 1 and int((one.astype(np.int64) * two).sum()) > at_once:
                half = len(x) // 2
                yield from descend(level, x[:half], y[:half])
                x, y = x[half:], y[half:]
                continue
            level += 1
            if len(x) == 1:  # two large families: one matrix product
                found = [(cx[cx <= cy], cy[cx <= cy]) if same else (cx, cy) for cx, cy in self_product(level, int(x[0]), int(y[0]))]
                x, y = (np.concatenate(c) for c in zip(*found, strict=True))
                continue
            cx, entry = _expand(a.begin[level - 1], x)
            cy, other = _expand(b.begin[level - 1], y[entry])
            x, y = cx[other], cy
            dot = np.einsum("ij,ij->i", a.points[a.nodes[level][x]], b.points[b.nodes[level][y]])
            bound = threshold + a.cover[level][x] + b.cover[level][y] + SLACK
            keep = np.maximum(2 - 2 * dot, 0) <= bound * bound
            if same:
                keep &= x <= y
            x, y = x[keep], y[keep]

    def self_product(level: int, x: int, y: int):
        """Children of two nodes that leave room for a pair within the threshold: ``dot + bound ** 2 / 2 >= 1``, of which the square of the two nodes' sum is three more columns."""
        ra, rb = np.arange(a.begin[level - 1][x], a.begin[level - 1][x + 1]), np.arange(b.begin[level - 1][y], b.begin[level - 1][y + 1])
        own, far = threshold + a.cover[level][ra] + SLACK, b.cover[level][rb]
        left = np.column_stack([a.points[a.nodes[level][ra]], own, own**2 / 2, np.ones(len(ra))]).astype(a.points.dtype)
        right = np.column_stack([b.points[b.nodes[level][rb]], far, np.ones(len(rb)), far**2 / 2]).astype(b.points.dtype).T
        for s in range(0, len(ra), 1024):
            i, j = np.divmod(np.flatnonzero(left[s : s + 1024] @ right >= 1 - ROUNDING), len(rb))
            yield ra[s + i], rb[j]

    yield from descend(0, np.zeros(min(1, len(a.points)), np.int64), np.zeros(min(1, len(b.points)), np.int64))


def usable(embedding: str) -> F.Column:
    """Not null, no null or non-finite component, and not all zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda v: v != 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _centres(points: DataFrame, most: int) -> list[np.ndarray]:
    """Up to ``most`` vectors per dimension, by hash order, neighbours in a row: where blocks gather is a matter of speed only."""
    picked = points.orderBy(F.xxhash64(F.lit(3), F.col("point"))).limit(8 * most).select("embedding").collect()
    groups: dict[int, list] = {}
    for r in picked:
        groups.setdefault(len(r[0]), []).append(r[0])
    out = []
    for rows in groups.values():
        unit, chosen = _unit(np.array(rows, np.float64)), [0]
        gap = 2 - 2 * unit @ unit[0]
        while len(chosen) < min(most, len(unit)) and gap.max() > 1e-6:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, 2 - 2 * unit @ unit[chosen[-1]])
        row, left = [chosen[0]], chosen[1:]
        while left:
            row.append(left.pop(int((unit[left] @ unit[row[-1]]).argmax())))
        out.append(unit[row])
    return out


BLOCKS = "tile long, block long, dim int, n int, ids binary, weights binary, vectors binary, tree binary, centre binary, radius double"


def _named_tile(dim: str, *within: F.Column) -> F.Column:
    """A tile's name: its dimension, and 40 bits for the neighbouring cells that it holds; tiles of equal bits become one."""
    return F.shiftleft(F.col(dim).cast("long"), 40) + F.xxhash64(*within).bitwiseAND(F.lit((1 << 40) - 1))


def _in_cells(points: DataFrame, centres: list[np.ndarray], element: str) -> DataFrame:
    """Every vector in the cell of the nearest of its dimension's ``centres``, in one pass without a shuffle."""
    by_dim = {c.shape[1]: c for c in centres}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            cell = [0] * len(vectors)
            for dim in set(map(len, vectors)):
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                if dim in by_dim:
                    for i, c in zip(at, (_unit(np.array([vectors[i] for i in at], np.float64)) @ by_dim[dim].T).argmax(axis=1).tolist(), strict=True):
                        cell[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(map(len, vectors), pa.int32())], ["point", "weight", "embedding", "cell", "dim"])

    placed = points.select("point", "weight", "embedding").mapInArrow(cells, f"point long, weight long, embedding array<{element}>, cell long, dim int")
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"{BLOCK_VALUES} div dim"))).cast("int")
    return placed.withColumn("most", most).withColumn("tile", _named_tile("dim", F.floor(F.col("cell") / CELLS)))


def _picked(unit: np.ndarray, ways: int) -> np.ndarray:
    """Up to ``ways`` rows as centres, neighbours in a row: half of them far from each other, which halves radii, half as they come, which halves crowds."""
    chosen, gap = [0], 2 - 2 * unit @ unit[0]
    while len(chosen) < ways and gap.max() > 1e-9:
        crowd = np.flatnonzero(gap > 1e-9)[0] if 2 * len(chosen) >= ways else gap.argmax()
        chosen.append(int(crowd))
        gap = np.minimum(gap, 2 - 2 * unit @ unit[chosen[-1]])
    row, left = [chosen[0]], chosen[1:]
    while left:
        row.append(left.pop(int((unit[left] @ unit[row[-1]]).argmax())))
    return unit[row]


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch's stretches of equal first ``keys`` columns, and those columns' values."""
    key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
    cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            yield tuple(key[:, low].tolist()), batch.slice(low, high - low)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _divide(full: DataFrame, level: int, element: str) -> DataFrame:
    """Cells of over ``most`` vectors (``n`` of them) divided around vectors of their own, whatever the size of the cell or their number.

    Some ``PICKED`` vectors of a cell, chosen by hash, give its centres.  The cell's vectors are dealt to tasks ``DEALT`` at a time, and the
    centres go to each of these tasks ahead of them.  Vectors that nothing parts (equal but for their length) are dealt by
    hash, and so are cells that ``DIVISIONS`` divisions left too large.
    """
    by_hash = level >= DIVISIONS
    full = full.withColumn("ways", F.greatest(F.lit(2), F.least(F.lit(CENTRES), F.ceil(3 * F.col("n") / F.col("most")))).cast("int"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            dim, cell, n, ways = now
            centres = _picked(np.concatenate(held), ways)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([cell], pa.int64()), pa.array([n], pa.int64()), pa.array([centres.tobytes()], pa.binary())], ["dim", "cell", "n", "centres"])

        for batch in batches:
            for key, rows in _runs(batch, 4):
                if key != now:
                    if now:
                        yield out()
                    now, held = key, []
                held.append(_matrix(rows.column(4), key[0]))
        if now:
            yield out()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centres = None, None
        for batch in batches:
            for key, rows in _runs(batch, 3):
                if key != now:
                    now, centres = key, None
                head = rows.column(6)[0].as_py()
                if head is not None:
                    centres, rows = np.frombuffer(head, np.float64).reshape(-1, key[0]), rows.slice(1)
                if not rows.num_rows:
                    continue
                child = rows.column(7)
                if not by_hash and centres is not None and len(centres) > 1:
                    child = pa.array((_matrix(rows.column(5), key[0]) @ centres.T).argmax(axis=1), pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4), rows.column(5), rows.column(1), rows.column(0), rows.column(8), child], ["point", "weight", "embedding", "cell", "dim", "most", "child"])

    some = full.where(F.pmod(F.xxhash64(F.lit(level), "point"), F.col("n")) < PICKED).select("dim", "cell", "n", "ways", "embedding", "point")
    centres = some.repartition("dim", "cell").sortWithinPartitions("dim", "cell", "point").mapInArrow(pick, "dim int, cell long, n long, centres binary")
    deals = F.expr(f"n div {DEALT} + 1")
    heads = centres.select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("deal"), "centres")
    spread = F.pmod(F.xxhash64(F.lit(level), F.lit(1), "point"), "ways").cast("int").alias("spread")
    rows = full.select("dim", "cell", F.pmod(F.xxhash64(F.lit(level), F.lit(2), "point"), deals).alias("deal"), "point", "weight", "embedding", spread, "most")
    both = rows.unionByName(heads, allowMissingColumns=True).select("dim", "cell", "deal", "point", "weight", "embedding", "centres", "spread", "most")
    ordered = both.repartition("dim", "cell", "deal").sortWithinPartitions("dim", "cell", "deal", F.col("point").asc_nulls_first())
    given = ordered.mapInArrow(assign, f"point long, weight long, embedding array<{element}>, cell long, dim int, most int, child int")
    return given.select("point", "weight", "embedding", F.xxhash64("cell", "child").alias("cell"), "dim", "most", _named_tile("dim", F.col("cell"), F.floor(F.col("child") / CELLS)).alias("tile"))


def _fitting_cells(placed: DataFrame, element: str) -> DataFrame:
    """``placed`` in cells of at most ``most`` vectors; larger ones are divided level by level, which takes about the logarithm of their size."""
    fitting, level = [], 0
    while True:
        sizes = placed.groupBy("dim", "cell", "most").agg(F.count("*").alias("n")).where("n > most")
        full = settle(sizes.select("dim", "cell", "n"), "full_cells")
        if full.isEmpty():
            break
        fitting.append(placed.join(full, ["dim", "cell"], "left_anti"))
        placed, level = settle(_divide(placed.join(full, ["dim", "cell"]), level, element), "cells"), level + 1
    for some in fitting:
        placed = placed.unionByName(some)
    return placed


def _pack_blocks(points: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """One row per block: the vectors of one cell, at most ``BLOCK`` of them and ``BLOCK_VALUES`` numbers."""
    element = points.schema["embedding"].dataType.elementType.typeName()
    kind = np.float32 if element == "float" else np.float64
    fitting = _fitting_cells(settle(_in_cells(points, centres, element), "cells"), element)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if held and (row[:2] != held[0][:2] or len(held) >= row[3]):
                    yield from _blocks(held, kind)
                    held = []
                held.append(row)
        if held:
            yield from _blocks(held, kind)

    return fitting.select("dim", "cell", "tile", "most", "point", "weight", "embedding").repartition("dim", "cell").sortWithinPartitions("dim", "cell", "point").mapInArrow(blocks, BLOCKS)


def _clumps(unit: np.ndarray) -> np.ndarray:
    """Which part each row belongs to, where up to ``CLUMPS`` parts of at most half the radius cover all; otherwise they are one part."""
    middle = unit.mean(axis=0)
    radius, part = float(np.linalg.norm(unit - middle, axis=1).max()), np.zeros(len(unit), np.int64)
    if radius <= NARROW:
        return part
    gap = np.maximum(2 - 2 * unit @ unit[0], 0)
    for k in range(1, CLUMPS):
        if np.sqrt(gap.max()) <= radius / 2:
            break
        fresh = np.maximum(2 - 2 * unit @ unit[int(gap.argmax())], 0)
        part[fresh < gap] = k
        gap = np.minimum(gap, fresh)
    return part if np.sqrt(gap.max()) <= radius / 2 else np.zeros(len(unit), np.int64)


def _blocks(held: list[tuple], kind: type) -> Iterator[pa.RecordBatch]:
    """A cell's block, or one for each of its clumps: a wide block over two far clumps would meet every tile."""
    part = _clumps(_unit(np.array([r[6] for r in held], np.float64)))
    for k in np.unique(part):
        yield _block([held[i] for i in np.flatnonzero(part == k)], kind)


def _block(held: list[tuple], kind: type) -> pa.RecordBatch:
    raw = np.array([r[6] for r in held], kind)
    unit = _unit(raw.astype(np.float64))
    middle = unit.mean(axis=0)
    radius = float(np.linalg.norm(unit - middle, axis=1).max())
    ids, weights = np.array([r[4] for r in held], np.int64), np.array([r[5] for r in held], np.int64)
    dim, _, tile = held[0][:3]
    values = [tile, int(ids[0]), dim, len(held), ids.tobytes(), weights.tobytes(), raw.tobytes(), CoverTree(unit.astype(np.float32)).pack(), middle.tobytes(), radius]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


class _Block:
    """A block in a task: ids, weights, unit vectors in double precision, and its tree over them in single precision."""

    def __init__(self, row: tuple, kind: type) -> None:
        self.name, dim, n, ids, weights, vectors, tree, centre, self.radius = row
        self.ids, self.weights = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
        self.unit = _unit(np.frombuffer(vectors, kind).reshape(n, dim).astype(np.float64))
        self.tree, self.centre = CoverTree.packed(self.unit.astype(np.float32), tree), np.frombuffer(centre, np.float64)


def _meet(one: _Block, two: _Block, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Link weights per point and a spanning forest between two blocks (or within one)."""
    same, a, b = one is two, one.unit, two.unit
    counts_a, counts_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    parent, shift = np.arange(len(a) + (0 if same else len(b))), 0 if same else len(a)
    step = max(256, GATHERED // (32 * a.shape[1]))
    for i, j in dual_pairs(one.tree, two.tree, float(np.sqrt(max(0.0, 2 - 2 * cosine))), same):
        for s in range(0, len(i), step):
            x, y = i[s : s + step], j[s : s + step]
            hit = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            x, y = x[hit], y[hit]
            np.add.at(counts_a, x, two.weights[y])
            np.add.at(counts_a if same else counts_b, y, one.weights[x])
            join_roots(parent, x, y + shift)
    everyone = one.ids if same else np.concatenate([one.ids, two.ids])
    counts = counts_a if same else np.concatenate([counts_a, counts_b])
    at = np.flatnonzero(counts)
    tied = np.flatnonzero(parent != np.arange(len(parent)))
    return dict(zip(everyone[at].tolist(), counts[at].tolist(), strict=True)), list(zip(everyone[tied].tolist(), everyone[parent[tied]].tolist(), strict=True))


def _near_heads(centre: np.ndarray, radius: np.ndarray, other: np.ndarray, reach: np.ndarray, gap: float) -> bool:
    """Whether two balls, one of each side, leave room for a pair within ``gap``."""
    squares = (centre**2).sum(axis=1)[:, None] + (other**2).sum(axis=1) - 2 * centre @ other.T
    return bool((np.sqrt(np.maximum(squares, 0)) <= gap + radius[:, None] + reach + SLACK).any())


def _tile_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """``(low, high)``: which tiles can hold a link, each pair once, a tile with itself too.

    A tile's head is its centre and covering radius and those of its blocks, some kilobytes for tens of thousands of vectors.  Tiles whose
    own radii leave room meet if those of two of their blocks do.  Heads are packed ``HEADS`` to a row and packs joined in pairs, so no row, task or driver holds all of them.
    """
    gap = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, dim, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = np.frombuffer(b"".join(p["centre"] for p in parts), np.float64).reshape(-1, dim)
                middle = c.mean(axis=0)
                radius = float((np.linalg.norm(c - middle, axis=1) + np.array([p["radius"] for p in parts])).max())
                own = np.array([p["radius"] for p in parts])
                head = (tile, pa.int64()), (dim, pa.int32()), (middle.tobytes(), pa.binary()), (radius, pa.float64()), (c.tobytes(), pa.binary()), (own.tobytes(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in head], ["tile", "dim", "centre", "radius", "centres", "radii"])

    parts = blocks.groupBy("tile", "dim").agg(F.collect_list(F.struct("centre", "radius")).alias("parts"))  # CELLS * CLUMPS blocks
    tiles = settle(parts.mapInArrow(heads, "tile long, dim int, centre binary, radius double, centres binary, radii binary"), "tiles")
    number = tiles.groupBy("dim").agg(F.ceil(F.count("*") / HEADS).cast("int").alias("packs"))
    dealt = tiles.join(number, "dim").withColumn("pack", F.pmod(F.xxhash64("tile"), F.col("packs")).cast("int"))
    packs = settle(dealt.groupBy("dim", "packs", "pack").agg(F.collect_list(F.struct("tile", "centre", "radius", "centres", "radii")).alias("some")), "tile_packs")
    right = packs.select("dim", F.col("pack").alias("other"), F.col("some").alias("others"))
    pairs = packs.withColumn("other", F.explode(F.sequence("pack", F.col("packs") - 1))).join(right, ["dim", "other"]).select("dim", "some", "others")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *sides in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                centre = [np.frombuffer(b"".join(h["centre"] for h in side), np.float64).reshape(-1, dim) for side in sides]
                radius = [np.array([h["radius"] for h in side]) for side in sides]
                name = [np.array([h["tile"] for h in side], np.int64) for side in sides]
                squares = (centre[0] ** 2).sum(axis=1)[:, None] + (centre[1] ** 2).sum(axis=1) - 2 * centre[0] @ centre[1].T
                i, j = np.nonzero(np.sqrt(np.maximum(squares, 0)) <= gap + radius[0][:, None] + radius[1] + SLACK)
                part = [[(np.frombuffer(h["centres"], np.float64).reshape(-1, dim), np.frombuffer(h["radii"], np.float64)) for h in side] for side in sides]
                meets = np.array([_near_heads(*part[0][x], *part[1][y], gap) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                one, two = name[0][i[meets]], name[1][j[meets]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["low", "high"])

    return pairs.mapInArrow(near, "low long, high long").distinct()


def link_summary(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors`` (``vec_id``, ``embedding``).

    Links join vectors of one dimension whose cosine, in double precision, is at least ``cosine`` (positive).
    Null and zero vectors and those with null or non-finite components link with nothing; a null vec_id takes part but is
    never the smallest of a component.  Repeated rows link with each other, and rows of one vec_id are
    vectors of their own; other columns are ignored, an empty table gives an empty one.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = np.float32 if element == "float" else np.float64
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{'float' if element == 'float' else 'double'}>").alias("embedding"))
    rows = rows.withColumn("usable", usable("embedding"))
    ident = F.coalesce("vec_id", F.lit(2**63 - 1))
    points = rows.where("usable").groupBy("embedding").agg(F.min(ident).alias("least"), F.count("*").alias("weight"))
    points = settle(points.withColumn("point", F.monotonically_increasing_id()), "points")
    blocks = settle(_pack_blocks(points, _centres(points, CENTRES)), "blocks")
    pairs = settle(_tile_pairs(blocks.select("tile", "dim", "centre", "radius"), cosine), "tile_pairs")
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("tile"))
    columns = ("low", "high", "tile", *(c.split()[0] for c in BLOCKS.split(", ")[1:]))
    visits = blocks.join(sides, "tile").select(*columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                low, high, tile, *row = (batch.column(k)[i].as_py() for k in range(len(columns)))
                if (low, high) != now:
                    now, held = (low, high), []
                mine, out = _Block(tuple(row), kind), []
                if tile == low:
                    held.append(mine)
                if tile == high:  # the blocks of the lower tile are held, those of the higher pass by
                    for other in held:
                        if np.linalg.norm(mine.centre - other.centre) <= np.sqrt(max(0.0, 2 - 2 * cosine)) + mine.radius + other.radius + SLACK:
                            counts, forest = _meet(other, mine, cosine)
                            out += [(None, 1, None), *((k, v, None) for k, v in counts.items()), *((a, 0, b) for a, b in forest)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "n", "b"])

    found = settle(visits.repartition(F.col("low"), F.col("high")).sortWithinPartitions("low", "high", "tile", "block").mapInArrow(meet, "a long, n long, b long"), "links")
    counts = found.where("a is not null and b is null").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null"), "a", "b").select(F.col("node").alias("point"), "component")
    classes = points.join(counts, "point", "left").join(roots, "point", "left")
    classes = settle(classes.select("embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "point").alias("component")), "classes")
    names = settle(classes.groupBy("component").agg(F.min("least").alias("name")), "names")
    classes = classes.join(names, "component").select("embedding", "n", "name")
    named = rows.where("usable").join(classes, "embedding").select("vec_id", F.col("n").alias("n_links"), F.nullif("name", F.lit(2**63 - 1)).alias("component_id"))
    lone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(lone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
