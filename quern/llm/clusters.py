"""Similarity clusters by k-means cells on hashed weighted features, and exact comparison of vectors.

A vector's components are weighted by the inverse deviation of their dimension and hashed with random
signs into SLOTS slots. Distributed k-means runs on these features: parallel oversampled seeding, reclustering of the
weighted candidates, then STEPS centroid updates. Every vector is in the OVERLAP cells with the nearest centroids, and the
vectors of a cell are compared with each other. There are FIRST_ROUNDS such rounds with
other hashes and other seeds, and more until a round brings nothing new, so a pair is lost only if it shares no cell in any round.

Cells are sent codes of one byte a component and the length of the rest that the code leaves out. This bounds a cosine from both sides;
pairs that the bounds leave open, and whose items no other links join, are compared by their original components after the rounds.

Pairs at the least cosine or more link items. A round's links become components, which later rounds join; and a component is a cluster if all its pairs
reach the least cosine. This is settled by the angle to the centroid where that suffices, otherwise
by comparison of all pairs, over the whole component. Cells and components of more than CELL vectors are cut into pieces, and
each pair of pieces is a task of its own; the result doesn't depend on CELL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.vectors import MODALITIES, mixed, packed, unit_vectors, unpacked
from quern.runtime import dropped, small, staged, union_all

#: Most vectors of a piece of a cell or component, vectors per centroid, most centroids.
CELL, CELL_MEAN, MOST_CELLS = 8_192, 1_000, 16_384
SLOTS, OVERLAP, STEPS = 64, 2, 2
#: Rounds before the first look at whether the last of them brought anything new, and between further looks.
FIRST_ROUNDS, MORE_ROUNDS = 5, 2
#: Rounds are compared together while their cells have at most so many rows for a vector.
TOGETHER = 8
#: Rows compared with a piece at once, and twice the error of a product of 32-bit unit vectors.
CHUNK, ERROR = 256, 4e-5
#: Pairs are held as rows up to one in so many of a group's.
FEW = 32


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the id and the salt only, so a repeated task draws the same."""
    return (mixed(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _by_modality(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(m, rows, vectors) of each run of one modality; m is the first column, the vector the last."""
    for b in batches:
        m = b.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, m[1:] != m[:-1])).tolist() + [b.num_rows] if len(m) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = b.slice(lo, hi - lo)
            yield int(m[lo]), part, unpacked(part.column(part.num_columns - 1), np.float32)


_MOST_MODALITIES = 16
_SUMS = "m int, key bigint, number double, v binary"


def _sums(m: int, keys: np.ndarray, number: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """One row for each key: sums of the numbers and of the rows of v."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    total = np.add.reduceat(v[order].astype(np.float64), starts, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), m, np.int32)), pa.array(keys[order][starts]), pa.array(np.add.reduceat(number[order].astype(np.float64), starts)), packed(total)], names=["m", "key", "number", "v"])


def _summed_by_key(df: DataFrame) -> DataFrame:
    """Sums numbers and vectors of equal (m, key), after a partial sum for each batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.RecordBatch] = []
        for m, b, v in _by_modality(batches):
            keys, number, v = b.column(1).to_numpy(), b.column(2).to_numpy(), v.view(np.float64)
            if last and (last[0].column(0)[0].as_py(), last[0].column(1)[0].as_py()) == (m, int(keys[0])):
                # the key of the batch before goes on
                keys, number = np.append(last[0].column(1), keys), np.append(last[0].column(2), number)
                v = np.concatenate([unpacked(last[0].column(3), np.float64), v])
            else:
                yield from last
            part = _sums(m, keys, number, v)
            if part.num_rows > 1:
                yield part.slice(0, part.num_rows - 1)
            last = [part.slice(part.num_rows - 1)]
        yield from last

    return df.repartition("m", "key").sortWithinPartitions("m", "key").mapInArrow(add, _SUMS)


def feature_hash(m: int, weights: np.ndarray, salt: int) -> np.ndarray:
    """(dimensions, SLOTS): every dimension's weight with a random sign in a random slot."""
    dims = np.arange(len(weights), dtype=np.int64) + (m << 20)
    out = np.zeros((len(weights), SLOTS), np.float32)
    sign = np.where(_uniform(dims, 2 * salt + 1) < 0.5, -1.0, 1.0)
    out[np.arange(len(weights)), (_uniform(dims, 2 * salt) * SLOTS).astype(int)] = sign * weights
    return out


def _features(x: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    f = x @ hashed
    return f / np.maximum(np.sqrt((f * f).sum(1, keepdims=True)), 1e-12)


def nearest(f: np.ndarray, centres: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, squared distance to the nearest) of the ``count`` nearest centres of every feature row."""
    cells, far = np.empty((len(f), count), np.int64), np.empty(len(f))
    half = (centres * centres).sum(1) / 2
    step = max(1, (1 << 24) // len(centres))
    for at in range(0, len(f), step):
        s = f[at : at + step] @ centres.T
        np.subtract(half, s, out=s)
        row = np.arange(len(s))
        for c in range(count):
            # a few passes for the least cost less than a partial sort
            cells[at : at + step, c] = cell = s.argmin(1)
            if c == 0:
                far[at : at + step] = 2 * s[row, cell] + (f[at : at + step] ** 2).sum(1)
            s[row, cell] = np.inf
    return cells, np.maximum(far, 0)


def reclustered(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of the weighted candidates: seeds drawn by weight and distance in batches, then two updates."""
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    chosen = rng.choice(len(x), 1, p=weight / weight.sum())
    d = nearest(x, x[chosen], 1)[1]
    while len(chosen) < k:
        p = weight * d
        some = np.flatnonzero(p > 0)
        if not len(some):
            break
        more = rng.choice(some, min(max(1, k // 16), k - len(chosen), len(some)), replace=False, p=p[some] / p[some].sum())
        chosen = np.append(chosen, more)
        d = np.minimum(d, nearest(x, x[more], 1)[1])
    centres = x[chosen]
    for _ in range(2):
        cell = nearest(x, centres, 1)[0][:, 0]
        total, w = np.zeros_like(centres, dtype=np.float64), np.bincount(cell, weight, len(centres))
        np.add.at(total, cell, x * weight[:, None])
        centres = np.where(w[:, None] > 0, total / np.maximum(w, 1e-12)[:, None], centres).astype(np.float32)
    return centres


class Cells:
    """K-means of several rounds at once, each with its own hash and seeds: the hashed features and centres of every (modality, round)."""

    def __init__(self, vectors: DataFrame, counts: dict[int, int], weights: dict[int, np.ndarray], rounds: list[int]):
        self.rounds, self.hashed = rounds, {(m, r): feature_hash(m, w, r) for m, w in weights.items() for r in rounds}
        self.wanted = {m: min(MOST_CELLS, -(-n // CELL_MEAN)) for m, n in counts.items()}
        self.centres: dict[tuple[int, int], np.ndarray] = {}
        if all(k == 1 for k in self.wanted.values()):
            # one cell each: any centre is the nearest
            self.centres = {u: np.zeros((1, SLOTS), np.float32) for u in self.hashed}
            self.sizes = {u: np.array([counts[u[0]]]) for u in self.hashed}
            return
        # parallel oversampling: rows by hash, then rows by their share in the cost
        self._sample(vectors, lambda u, ids, f: _uniform(ids, 16 * u[1]) < self.wanted[u[0]] / counts[u[0]])
        cost = {u: n[0] for u, _, n, _ in self._read(self._summed(vectors, lambda u, f: (np.zeros(len(f), np.int64), nearest(f, self.centres[u], 1)[1])))}
        self._sample(vectors, lambda u, ids, f: _uniform(ids, 16 * u[1] + 1) * max(cost[u], 1e-300) < 2 * self.wanted[u[0]] * nearest(f, self.centres[u], 1)[1])
        for u, at, n, _ in self._read(self._summed(vectors, lambda u, f: (nearest(f, self.centres[u], 1)[0][:, 0], np.ones(len(f))))):
            weight = np.zeros(len(self.centres[u]))
            weight[at] = n
            self.centres[u] = reclustered(self.centres[u][weight > 0], weight[weight > 0], self.wanted[u[0]], u[1])
        for _ in range(STEPS):
            for u, at, n, v in self._read(self._summed(vectors, lambda u, f: (nearest(f, self.centres[u], 1)[0][:, 0], np.ones(len(f))), True)):
                moved = self.centres[u].copy()
                moved[at] = (v / n[:, None]).astype(np.float32)
                self.centres[u] = moved
        self.sizes = self._counted(vectors)

    def _sample(self, vectors: DataFrame, takes: Callable) -> None:
        """Adds the rows that ``takes`` to the centres, a few times as many as cells are wanted; where there is none, a centre at 0."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m, b, x in _by_modality(batches):
                for r in self.rounds:
                    f = _features(x, self.hashed[m, r])
                    rows = np.flatnonzero(takes((m, r), b.column(1).to_numpy(), f))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), _unit_of(m, r), np.int32)), b.column(1).take(pa.array(rows)), packed(f[rows])], names=["m", "item_id", "f"])

        drawn = vectors.mapInArrow(run, "m int, item_id bigint, f binary").toArrow().sort_by([("m", "ascending"), ("item_id", "ascending")])
        for u, _, f in _by_modality(iter(drawn.combine_chunks().to_batches())):
            key = (u % _MOST_MODALITIES, u // _MOST_MODALITIES)
            self.centres[key] = np.concatenate([self.centres[key], f]) if key in self.centres else f
        for key in self.hashed:
            self.centres.setdefault(key, np.zeros((1, SLOTS), np.float32))

    def _summed(self, vectors: DataFrame, key_and_number: Callable, with_features: bool = False) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m, _, x in _by_modality(batches):
                for r in self.rounds:
                    f = _features(x, self.hashed[m, r])
                    keys, number = key_and_number((m, r), f)
                    yield _sums(_unit_of(m, r), keys, number, f if with_features else np.zeros((len(f), 1), np.float32))

        return _summed_by_key(vectors.mapInArrow(run, _SUMS))

    @staticmethod
    def _read(sums: DataFrame) -> list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
        """((m, round), keys, numbers, vectors) of every modality and round: one row per candidate or cell."""
        out = []
        t = sums.toArrow()
        for o in np.unique(t.column("m").to_numpy()).tolist():
            part = t.filter(pc.equal(t.column("m"), o)).combine_chunks()
            out.append(((o % _MOST_MODALITIES, o // _MOST_MODALITIES), part.column("key").to_numpy(), part.column("number").to_numpy(), unpacked(part.column("v").chunk(0), np.float64)))
        return out

    def _counted(self, vectors: DataFrame) -> dict[tuple[int, int], np.ndarray]:
        """How many vectors are in each cell of every modality and round."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m, _, x in _by_modality(batches):
                for r in self.rounds:
                    cell, n = np.unique(self.of(m, r, x), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), _unit_of(m, r), np.int32)), pa.array(cell), pa.array(n)], names=["m", "cell", "n"])

        sizes = {u: np.zeros(len(c), np.int64) for u, c in self.centres.items()}
        t = vectors.mapInArrow(run, "m int, cell bigint, n bigint").groupBy("m", "cell").agg(F.sum("n").alias("n")).toArrow()
        unit, cell, n = (t.column(c).to_numpy() for c in range(3))
        for o in np.unique(unit).tolist():
            sizes[o % _MOST_MODALITIES, o // _MOST_MODALITIES][cell[unit == o]] = n[unit == o]
        return sizes

    def rows(self, r: int) -> int:
        """Rows that the pairs of pieces of a round's cells have."""
        return sum(int((n * -(-n // CELL)).sum()) for (_, o), n in self.sizes.items() if o == r)

    def together(self, rounds: list[int], most: int) -> list[list[int]]:
        """The rounds in groups of at most so many rows, or of one round."""
        out: list[list[int]] = []
        for r in rounds:
            if out and sum(map(self.rows, out[-1])) + self.rows(r) <= most:
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def of(self, m: int, r: int, x: np.ndarray) -> np.ndarray:
        """(n, OVERLAP) of the cells that a vector is in."""
        return nearest(_features(x, self.hashed[m, r]), self.centres[m, r], min(OVERLAP, len(self.centres[m, r])))[0]


def _unit_of(m: int, r: int) -> int:
    return r * _MOST_MODALITIES + m


_GROUPED = "m int, g bigint, cell bigint, part bigint, item_id bigint, x binary"


def _in_pieces(m: int, cell: np.ndarray, size: np.ndarray, items: pa.Array, x: pa.Array, row: np.ndarray) -> pa.RecordBatch:
    """Rows for all pairs of pieces p <= q of their cell: a cell of ``size`` vectors has one piece for every CELL of them."""
    ids = items.to_numpy()[row]
    pieces = -(-size // CELL)
    piece = (_uniform(ids, 77) * pieces).astype(np.int64)
    at = np.repeat(np.arange(len(row)), pieces)
    other = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    p, q = np.minimum(piece[at], other), np.maximum(piece[at], other)
    part = p * pieces[at] + q
    g = mixed(cell[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m)) + part.astype(np.uint64)
    take = pa.array(row[at])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, np.int32)), pa.array(g.view(np.int64)), pa.array(cell[at]), pa.array(part), items.take(take), x.take(take)], names=["m", "g", "cell", "part", "item_id", "x"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (m, cell, part), by item_id; rows of equal g are next to each other, and two groups may share a g."""

    def sorted_groups(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        t = pa.Table.from_batches(held).combine_chunks()
        m, cell, part, ids = (t.column(c).to_numpy() for c in ("m", "cell", "part", "item_id"))
        order = np.lexsort((ids, part, cell, m)) if (m != m[0]).any() or (cell != cell[0]).any() or (part != part[0]).any() else np.argsort(ids)
        m, cell, part = m[order], cell[order], part[order]
        edges = np.flatnonzero((m[1:] != m[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        t = t.take(pa.array(order)).combine_chunks()
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(m)]):
            yield t.slice(lo, hi - lo)

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        g = b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and g[lo] != last:
                yield from sorted_groups(held)
                held = []
            last = g[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from sorted_groups(held)


def coded(x: np.ndarray) -> pa.Array:
    """Unit vectors as binary values: 32-bit step and length of the rest, then a signed byte for each component."""
    step = np.maximum(np.abs(x).max(1), np.float32(1e-30)) / np.float32(127)
    q = np.rint(x / step[:, None]).astype(np.int8)
    rest = np.sqrt(((x.astype(np.float64) - q * step[:, None].astype(np.float64)) ** 2).sum(1)) * (1 + 1e-6)
    return packed(np.concatenate([np.stack([step, rest], axis=1).astype(np.float32).view(np.uint8), q.view(np.uint8)], axis=1))


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as 32-bit numbers, lengths of the rests) of coded()."""
    raw = unpacked(column, np.uint8)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1].astype(np.float64)


def _reaching(s: np.ndarray, least: float) -> np.ndarray:
    """Flat positions of the numbers in ``s`` that are ``least`` or more, looked for eight at a time."""
    hit = np.zeros(-(-s.size // 8) * 8, bool)
    np.greater_equal(s, np.float32(least), out=hit[: s.size].reshape(s.shape))
    words = np.flatnonzero(hit.view(np.uint64))
    if 8 * len(words) > len(hit) // 2:
        return np.flatnonzero(hit)
    flat = (words[:, None] * 8 + np.arange(8)).ravel()
    return flat[hit[flat]]


def _near(column: pa.Array, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, i, j, sure) of a group of codes in chunks of rows: the pairs i < j of rows, by i and then j, whose cosine may be ``least`` or more; whether it surely is. Every pair is looked at once."""
    x, rest = decoded(column)
    far = float(rest.max()) if len(rest) else 0.0
    for at in range(0, len(x), CHUNK):
        s = x[at : at + CHUNK] @ x[at:].T
        flat = _reaching(s, least - ERROR - far * (2 + far))
        i, j = np.divmod(flat, s.shape[1])
        later = i < j
        i, j, flat = i[later] + at, j[later] + at, flat[later]
        a, b = rest[i], rest[j]
        width = a + b + a * b + ERROR
        s = s.ravel()[flat].astype(np.float64)
        may = s >= least - width
        yield at, min(CHUNK, len(x) - at), i[may], j[may], (s >= least + width)[may]


def _similar(t: pa.Table, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, i, j) of a group in chunks of rows: the pairs i, j of rows at a cosine of ``least`` or more, by i and then j, in double precision where 32 bits don't decide."""
    x = unpacked(t.column("x").chunk(0), np.float32)
    for at in range(0, len(x), CHUNK):
        s = (x[at : at + CHUNK] @ x.T).ravel()
        flat = np.flatnonzero(s >= least - ERROR)
        i, j = np.divmod(flat, len(x))
        open_ = np.flatnonzero(s[flat] <= least + ERROR)
        if len(open_):
            a, b = x[i[open_] + at].astype(np.float64), x[j[open_]].astype(np.float64)
            under = np.round((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)), 9) < least
            i, j = np.delete(i, open_[under]), np.delete(j, open_[under])
        yield at, min(CHUNK, len(x) - at), i, j


def linked_labels(t: pa.Table, least: float) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """For each row of a group of codes the first row of its component by sure links, every row being linked to itself; and the pairs i > j of rows of two components that may be links."""
    n, held, open_ = t.num_rows, [], []
    for at, rows, i, j, sure in _near(t.column("x").chunk(0), least):
        # many are found again when the labels are known
        few = (rows * (n - at)) // FEW
        open_.append((j[~sure], i[~sure]) if len(sure) - np.count_nonzero(sure) < few else None)
        i, j = i[sure], j[sure]
        if len(i) < few:
            held.append((at, rows, i.astype(np.int32), j.astype(np.int32)))
        else:
            # many: a bit each
            bits = np.zeros((rows, n - at), bool)
            bits[i - at, j - at] = True
            held.append((at, rows, None, np.packbits(bits, axis=1)))
    label = np.arange(n)
    while True:
        new = label.copy()
        for at, rows, i, v in held:
            if i is None:
                bits = np.unpackbits(v, axis=1, count=n - at).view(bool)
                own, later = new[at : at + rows], new[at:]
                np.minimum(later, np.where(bits, label[at : at + rows, None], n).min(0), out=later)
                np.minimum(own, np.where(bits, label[None, at:], n).min(1), out=own)
            else:
                np.minimum.at(new, i, label[v])
                np.minimum.at(new, v, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new

    def across() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        again = _near(t.column("x").chunk(0), least) if any(o is None for o in open_) else [None] * len(open_)
        for o, more in zip(open_, again):
            if o is None:
                _, _, i, j, sure = more
                o = j[~sure], i[~sure]
            two = label[o[0]] != label[o[1]]
            if two.any():
                yield o[0][two], o[1][two]

    return label, across()


def _spread(grouped: DataFrame, rows: int) -> DataFrame:
    """Groups next to each other, in about two partitions a core or one for 65,536 rows."""
    parts = max(2 * grouped.sparkSession.sparkContext.defaultParallelism, -(-rows // 65_536))
    return grouped.repartition(parts, "g").sortWithinPartitions("g")


def _links(vectors: DataFrame, cells: Cells, rounds: list[int], least: float) -> DataFrame:
    """(m, a, b, sure): items a > b of one cell of one of the rounds that are linked there, b being the smallest of its component in the cell; and unsure, pairs of two components that may be linked."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, b, x in _by_modality(batches):
            codes = coded(x)
            for r in rounds:
                of = cells.of(m, r, x)
                row = np.repeat(np.arange(len(of)), of.shape[1])
                yield _in_pieces(m, of.ravel() + (r << 32), cells.sizes[m, r][of.ravel()], b.column(1), codes, row)

    def rows_of(m: int, a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), m, np.int32)), pa.array(a), pa.array(b), pa.array(np.full(len(a), sure))], names=["m", "a", "b", "sure"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            m, ids = t.column("m")[0].as_py(), t.column("item_id").to_numpy()
            label, across = linked_labels(t, least)
            some = np.flatnonzero(label != np.arange(len(label)))
            yield rows_of(m, ids[some], ids[label[some]], True)
            for i, j in across:
                yield rows_of(m, ids[i], ids[j], False)

    grouped = vectors.mapInArrow(place, _GROUPED)
    return staged(_spread(grouped, sum(cells.rows(r) for r in rounds)).mapInArrow(link, "m int, a bigint, b bigint, sure boolean"))


def _settled(vectors: DataFrame, pairs: DataFrame, n: int, least: float) -> DataFrame:
    """Of the n pairs (m, a, b) those at a cosine of ``least`` or more, in double precision."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, b, x in _by_modality(batches):
            x, y = x.astype(np.float64), unpacked(b.column(3), np.float32).astype(np.float64)
            ok = np.round((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), 9) >= least
            yield pa.RecordBatch.from_arrays(b.columns[:3], names=["m", "a", "b"]).filter(pa.array(ok))

    ends = union_all(pairs.select("m", F.col("a").alias("item_id")), pairs.select("m", F.col("b").alias("item_id"))).distinct()
    near = vectors.join(small(ends, 2 * n, 16), ["m", "item_id"], "left_semi")
    both = pairs.join(small(near.toDF("m", "a", "xa"), 2 * n, 450), ["m", "a"]).join(small(near.toDF("m", "b", "xb"), 2 * n, 450), ["m", "b"])
    return staged(both.select("m", "a", "b", "xa", "xb").mapInArrow(test, "m int, a bigint, b bigint"), done=[pairs])


def joined_with(vectors: DataFrame, labels: DataFrame | None, links: list[DataFrame], least: float) -> tuple[DataFrame | None, int]:
    """(labels after the links (m, a, b, sure) of rounds have joined components, links between components that were new): the sure ones, then those of the others that turn out as links. ``links`` are used up."""
    across = staged(_across(labels, union_all(*links).distinct()), done=links)
    number = {r.sure: r.n for r in across.groupBy("sure").agg(F.count(F.lit(1)).alias("n")).collect()}
    new, unsure = number.get(True, 0), number.get(False, 0)
    if new:
        labels = joined_by(vectors, labels, across.filter("sure"), new)
    if unsure:
        pairs = staged(_across(labels, across.filter("not sure").select("m", "a", "b"), unsure).select("m", "a", "b"))
        if n := pairs.count():
            near = _settled(vectors, pairs, n, least)
            if n := near.count():
                labels = joined_by(vectors, labels, _across(labels, near, n), n)
                new += n
            dropped(near)
    dropped(across)
    return labels, new


def components(links: DataFrame) -> DataFrame:
    """(m, item_id, label): the smallest item of the component of every item of the links (m, a, b), each of two items and there once. Labels spread along links and shortcuts until nothing changes."""
    both = staged(union_all(links, links.select("m", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = staged(both.groupBy("m", "a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select("m", F.col("a").alias("b"), "label"), ["m", "b"]).select("m", "a", "label", F.lit(None).cast("bigint").alias("before"))
        least = union_all(near, labels.withColumn("before", F.col("label"))).groupBy("m", "a").agg(F.min("label").alias("label"), F.max("before").alias("before"))
        # a shortcut: the label's own label
        jumped = least.join(labels.select("m", F.col("a").alias("label"), F.col("label").alias("beyond")), ["m", "label"], "left")
        new = jumped.select("m", "a", F.least("label", F.coalesce("beyond", "label")).alias("label"), "before")
        step = staged(new.select("m", "a", "label", (F.col("label") != F.col("before")).alias("changed")))
        dropped(labels)
        labels = step
        if not step.filter("changed").limit(1).count():
            dropped(both)
            return _dropping(labels.select("m", F.col("a").alias("item_id"), "label"), labels)
        labels = _dropping(labels.select("m", "a", "label"), labels)


def _dropping(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which dropped() removes with the table it selects from."""
    df.stage_folder = table.stage_folder
    return df


def _across(labels: DataFrame | None, links: DataFrame, n: int | None = None) -> DataFrame:
    """The links between two components, with their labels la and lb; without labels every item is a component. n: how many links there are, if they have been counted."""
    if labels is None:
        return links.withColumns({"la": F.col("a"), "lb": F.col("b")})
    of = labels.select("m", F.col("item_id").alias("a"), F.col("label").alias("la"))
    first = (links if n is None else small(links, n, 64)).join(of, ["m", "a"])
    return (first if n is None else small(first, n, 64)).join(of.toDF("m", "b", "lb"), ["m", "b"]).filter("la <> lb")


def joined_by(vectors: DataFrame, labels: DataFrame | None, across: DataFrame, n: int) -> DataFrame:
    """Labels of all items after n links between components (m, la, lb) have joined these."""
    ends = across.select("m", F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b"))
    found = components(ends if labels is None else ends.distinct())
    joined = found.select("m", F.col("item_id").alias("label"), F.col("label").alias("to"))
    # the first links grow with the table, later ones are few
    old, joined = (vectors.select("m", "item_id", F.col("item_id").alias("label")), joined) if labels is None else (labels, small(joined, 2 * n, 64))
    return staged(old.join(joined, ["m", "label"], "left").select("m", "item_id", F.coalesce("to", "label").alias("label")), done=[found] if labels is None else [found, labels])


def _centred(members: DataFrame) -> DataFrame:
    """(m, cluster_id, size, item_id, near, x) of members (m, cluster_id, item_id, x): near is the cosine to the mean of the cluster's vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, b, x in _by_modality(batches):
            yield _sums(m, b.column(1).to_numpy(), np.ones(len(x)), x)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, b, x in _by_modality(batches):
            v, y = unpacked(b.column(4), np.float64), x.astype(np.float64)
            near = (y * v).sum(1) / np.sqrt(np.maximum((y * y).sum(1) * (v * v).sum(1), 1e-300))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near), b.column(5)], names=["m", "cluster_id", "size", "item_id", "near", "x"])

    ordered = members.select("m", "cluster_id", "item_id", "x")
    centre = _summed_by_key(ordered.mapInArrow(partial, _SUMS)).select("m", F.col("key").alias("cluster_id"), F.col("number").cast("bigint").alias("size"), "v")
    joined = ordered.join(centre, ["m", "cluster_id"]).select("m", "cluster_id", "size", "item_id", "v", "x")
    return joined.mapInArrow(measure, "m int, cluster_id bigint, size bigint, item_id bigint, near double, x binary")


_CLUSTERED = "m int, cluster_id bigint, size bigint, item_id bigint, near double"


def similarity_clusters(df: DataFrame, item: str = "item_id", modalities: tuple = MODALITIES, least: float = 0.8) -> DataFrame:
    """(m, cluster_id, size, item_id, near): the members of all clusters, near being the cosine to the cluster's mean.

    A cluster is a set of at least two items with all pairs at a cosine of ``least``
    or more and no item outside that near to one inside; its id is its smallest
    item. Items without a valid vector are in none; an item that is present
    several times counts once. Neighbourhoods that aren't clean give no cluster, an empty table gives none.
    """
    spark = df.sparkSession
    vectors = staged(unit_vectors(df, item, modalities).groupBy("m", "item_id").agg(F.min("x").alias("x")).sortWithinPartitions("m", "item_id"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, _, x in _by_modality(batches):
            yield _sums(m, np.zeros(len(x), np.int64), np.ones(len(x)), np.concatenate([x, x * x], axis=1))

    counts, weights = {}, {}
    for (m, _), _, n, v in Cells._read(_summed_by_key(vectors.mapInArrow(moments, _SUMS))):
        mean, square = np.split(v[0] / n[0], 2)
        counts[m], weights[m] = int(n[0]), 1 / np.sqrt(np.maximum(square - mean * mean, 1e-6))
    if not counts:
        return spark.createDataFrame([], _CLUSTERED)
    labels, r = None, 0
    while True:
        rounds = list(range(r, r + (MORE_ROUNDS if r else FIRST_ROUNDS)))
        cells = Cells(vectors, counts, weights, rounds)
        if max(cells.wanted.values()) == 1:
            # one cell holds all, so one round sees all pairs
            labels, _ = joined_with(vectors, labels, [_links(vectors, cells, [0], least)], least)
            break
        links = [_links(vectors, cells, some, least) for some in cells.together(rounds[:-1], TOGETHER * sum(counts.values()))]
        labels, _ = joined_with(vectors, labels, links, least)
        labels, new = joined_with(vectors, labels, [_links(vectors, cells, rounds[-1:], least)], least)
        if not new:
            break
        r = rounds[-1] + 1
    if labels is None:
        return spark.createDataFrame([], _CLUSTERED)
    sized = labels.groupBy("m", "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m", "label")
    linked = labels.join(sized, ["m", "label"]).withColumnRenamed("label", "cluster_id")
    members = staged(_centred(linked.join(vectors, ["m", "item_id"])), done=[vectors, labels])
    # two vectors within half the angle of the mean are within the whole angle of each other
    half = math.cos(math.acos(least) / 2) + ERROR
    open_ = members.groupBy("m", "cluster_id").agg(F.min("near").alias("lo")).filter(F.col("lo") < half).select("m", "cluster_id")
    rest = members.join(open_, ["m", "cluster_id"], "left_semi").select("m", "cluster_id", "size", "item_id", "x")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, b, _ in _by_modality(batches):
            yield _in_pieces(m, b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3), b.column(4), np.arange(b.num_rows))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            if any(len(i) < rows * t.num_rows for _, rows, i, _ in _similar(t, least)):
                yield pa.RecordBatch.from_arrays([t.column("m").chunk(0).slice(0, 1), t.column("cell").chunk(0).slice(0, 1)], names=["m", "cluster_id"])

    unclean = staged(_spread(rest.mapInArrow(place, _GROUPED), sum(counts.values())).mapInArrow(check, "m int, cluster_id bigint").distinct())
    return members.join(unclean, ["m", "cluster_id"], "left_anti").select("m", "cluster_id", "size", "item_id", "near")


def _named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.element_at(F.array(*[F.lit(name) for name, _, _ in MODALITIES]), F.col("m") + 1).alias("modality"), *columns)


def found_clusters(df: DataFrame, least: float = 0.8) -> DataFrame:
    """(modality, cluster_id, item_id) over both modalities of item_features."""
    return _named(similarity_clusters(df, least=least), "cluster_id", "item_id")


def described_clusters(df: DataFrame, least: float = 0.8, typical: int = 3) -> DataFrame:
    """(modality, cluster_id, size, item_id, typicality, rank): each cluster's size and its ``typical`` members nearest to the centroid.

    Typicality is the cosine to the mean of the members' unit vectors, rounded to 5 digits; ties go to the smaller item.
    """
    scored = similarity_clusters(df, least=least).withColumn("typicality", F.round("near", 5))
    order = Window.partitionBy("m", "cluster_id").orderBy(F.col("typicality").desc(), "item_id")
    return _named(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= typical), "cluster_id", "size", "item_id", "typicality", "rank")
