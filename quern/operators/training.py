"""Training of small models: matrix factorisation and light graph convolution by BPR, and ALS.

The linear models' gradients have a closed form. train_mf() keeps embeddings as a table, als() ratings, and both are for
catalogues of any size; train_bpr() applies Adam on the driver, where embeddings are kept, and only samples in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.operators.losses import unseen
from quern.runtime import dropped, staged


def sampled_triplets(inter: DataFrame, n_items: int, per_user: int, seed: int) -> DataFrame:
    """(u, pos, neg): ``per_user`` hashed positives of each user and one uniform item each that isn't theirs; draws are functions of ids and the seed. Only users of the whole catalogue have no row."""
    return _drawn(inter.groupBy("u").agg(F.array_sort(F.collect_set("i")).alias("items")), n_items, per_user, seed)


def _drawn(lists: DataFrame, n_items: int, per_user: int, seed: int) -> DataFrame:
    t = lists.select("u", "items", F.explode(F.sequence(F.lit(0), F.lit(per_user - 1))).alias("t"))
    pos = F.element_at("items", (F.pmod(F.xxhash64("u", "t", F.lit(seed)), F.size("items")) + 1).cast("int"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda d: F.pmod(F.xxhash64("u", "t", d, F.lit(seed + 1)), F.lit(n_items)))
    neg = F.try_element_at(F.filter(draws, lambda d: ~F.array_contains("items", d)), F.lit(1))
    neg = F.coalesce(neg, unseen("items", n_items, F.xxhash64("u", "t", F.lit(seed + 2))))
    return t.select("u", pos.alias("pos"), neg.alias("neg")).filter("neg is not null")


#: Nodes whose first embedding comes from one generator.
NODES = 65_536


def first_embedding(lo: int, hi: int, dim: int, seed: int, size: int) -> np.ndarray:
    """Rows lo to hi - 1 of the first embedding: normal numbers of deviation 0.1, by a generator for each ``size`` nodes."""
    parts = []
    for at in range(lo // size, -(-hi // size)):
        rng = np.random.default_rng(seed if at == 0 else [seed, at])
        start = at * size
        parts.append(rng.standard_normal((min(hi, start + size) - start, dim))[max(lo - start, 0) :] * 0.1)
    return np.concatenate(parts) if parts else np.zeros((0, dim))


def train_mf(inter: DataFrame, n_users: int, n_items: int, dim: int = 16, epochs: int = 5, rate: float = 0.01, regs: float = 1e-4, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """(embeddings, loss per epoch) of train_bpr() without layers, for catalogues of any size: nothing of the size of users, items or triplets reaches the driver.

    Embeddings are (node, e, m, v), items being nodes n_users + i; m and v are Adam's moments. An epoch brings the
    vectors to the triplets by joins, sums the gradients by node and updates all nodes.
    """
    spark, n, size = inter.sparkSession, n_users + n_items, NODES
    zeros = F.array(*[F.lit(0.0)] * dim)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                e = first_embedding(at * size, min(n, (at + 1) * size), dim, seed, size)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, e.size + 1, dim, dtype=np.int32)), pa.array(e.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at * size, at * size + len(e))), lists], names=["node", "e"])

    generators = -(-n // size)
    nodes = staged(spark.range(0, generators, 1, max(1, min(64, generators))).mapInArrow(first, "node bigint, e array<double>").select("node", "e", zeros.alias("m"), zeros.alias("v")))
    losses = []
    lists = staged(inter.groupBy("u").agg(F.array_sort(F.collect_set("i")).alias("items")))

    for epoch in range(1, epochs + 1):
        triplets = _drawn(lists, n_items, 8, seed + epoch)
        e = nodes.select("node", "e")
        one = triplets.withColumn("pos", F.col("pos") + n_users).withColumn("neg", F.col("neg") + n_users).join(e.toDF("pos", "ep"), "pos")
        two = one.join(e.toDF("neg", "en"), "neg").select("u", "pos", "neg", F.zip_with("ep", "en", lambda a, b: a - b).alias("d"))
        three = two.join(e.toDF("u", "eu"), "u").withColumn("x", A.dot("eu", "d"))
        # both sums need the same rows, so they are written once
        scored = staged(three.select("u", "pos", "neg", "d", "eu", "x"))
        count, loss = scored.agg(F.count(F.lit(1)), F.avg(F.log1p(F.exp(-F.col("x"))))).first()
        losses.append(float(loss))
        g = -1 / (1 + F.exp("x")) / F.lit(count)
        push = F.array(F.struct(F.col("u").alias("node"), F.transform("d", lambda y: y * g).alias("g")), F.struct(F.col("pos").alias("node"), F.transform("eu", lambda y: y * g).alias("g")), F.struct(F.col("neg").alias("node"), F.transform("eu", lambda y: -y * g).alias("g")))
        parts = scored.select(F.explode(push).alias("p")).groupBy("p.node").agg(*[F.sum(F.col("p.g")[k]).alias(f"g{k}") for k in range(dim)])
        grad = parts.select("node", F.array(*[F.col(f"g{k}") for k in range(dim)]).alias("g"))
        joined = nodes.join(grad, "node", "left").withColumn("g", F.zip_with(F.coalesce("g", zeros), "e", lambda a, b: a + regs * b / F.lit(count)))
        moved = joined.withColumn("m", F.zip_with("m", "g", lambda a, b: 0.9 * a + 0.1 * b)).withColumn("v", F.zip_with("v", "g", lambda a, b: 0.999 * a + 0.001 * b * b))
        step = F.zip_with("m", "v", lambda a, b: rate * 0.96 ** (epoch / 50) * (a / (1 - 0.9**epoch)) / (F.sqrt(b / (1 - 0.999**epoch)) + 1e-8))
        nodes = staged(moved.select("node", F.zip_with("e", step, lambda a, b: a - b).alias("e"), "m", "v"), done=[nodes, scored])
    dropped(lists)
    return nodes, losses


def train_bpr(inter: DataFrame, n_users: int, n_items: int, dim: int = 16, layers: int = 0, epochs: int = 5, rate: float = 0.01, regs: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(user vectors, item vectors, loss per epoch).

    ``layers`` 0 is matrix factorisation; more are steps of light graph convolution
    over the sym-normalised user-item graph, whose mean of layers is linear and
    symmetric, so its transpose carries the gradients back.
    """
    edges = np.array([(r.u, r.i) for r in inter.select("u", "i").distinct().toLocalIterator()], np.int64).reshape(-1, 2)
    du, di = np.bincount(edges[:, 0], minlength=n_users), np.bincount(edges[:, 1], minlength=n_items)
    w = 1 / np.sqrt(np.maximum(du[edges[:, 0]], 1) * np.maximum(di[edges[:, 1]], 1))

    def spread(e: np.ndarray) -> np.ndarray:
        total, x = e.copy(), e
        for _ in range(layers):
            y = np.zeros_like(x)
            np.add.at(y, edges[:, 0], w[:, None] * x[n_users + edges[:, 1]])
            np.add.at(y, n_users + edges[:, 1], w[:, None] * x[edges[:, 0]])
            x = y
            total += x
        return total / (layers + 1)

    e = first_embedding(0, n_users + n_items, dim, seed, NODES)
    m, v, losses = np.zeros_like(e), np.zeros_like(e), []
    for epoch in range(1, epochs + 1):
        rows = sampled_triplets(inter, n_items, 8, seed + epoch).toPandas()
        u, p, n = rows.u.to_numpy(), n_users + rows.pos.to_numpy(), n_users + rows.neg.to_numpy()
        z = spread(e)
        x = (z[u] * (z[p] - z[n])).sum(1)
        losses.append(float(np.log1p(np.exp(-x)).mean()))
        g = -(1 / (1 + np.exp(x)) / len(x))[:, None]
        grad = np.zeros_like(e)
        for rows_, part in ((u, g * (z[p] - z[n])), (p, g * z[u]), (n, -g * z[u])):
            np.add.at(grad, rows_, part)
        grad = spread(grad) + regs * e / len(x)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        e -= rate * 0.96 ** (epoch / 50) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    z = spread(e)
    return z[:n_users], z[n_users:], losses


#: Ratings of a partition of als(), rows of factors that are on the driver and in a worker at once, and ratings of a row that are added at once.
RATINGS, FACTORS, ADDED = 1 << 20, 1 << 21, 1 << 16


class Factors(NamedTuple):
    """Tables (id, features) of a factorisation."""

    userFactors: DataFrame
    itemFactors: DataFrame


def _ids(inter: DataFrame, key: str) -> np.ndarray:
    return np.sort(inter.select(F.col(key).cast("bigint")).distinct().toArrow().column(0).to_numpy())


def _rated(inter: DataFrame, key: str, other: str, ids: Broadcast, others: Broadcast, parts: int) -> DataFrame:
    """(row, own): for each id the row numbers of the ids it is rated with, as binary 32-bit integers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.searchsorted(ids.value, b.column(0).to_numpy()), np.searchsorted(others.value, b.column(1).to_numpy())) for b in batches if b.num_rows]
        if held:
            row, own = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((own, row))
            row, own = row[order], own[order].astype(np.int32)
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            offsets = np.append(starts, len(own)).astype(np.int32) * np.int32(4)
            yield pa.RecordBatch.from_arrays([pa.array(row[starts]), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(own)])], names=["row", "own"])

    pairs = inter.select(F.col(key).cast("bigint").alias("k"), F.col(other).cast("bigint").alias("o"))
    return staged(pairs.repartition(parts, "k").mapInArrow(gather, "row bigint, own binary"))


def _integers(column: pa.Array) -> np.ndarray:
    """The 32-bit integers of all values of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int32)


def _add_ratings(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, own: np.ndarray, y: np.ndarray) -> None:
    """Adds to a and b the sums of y y' and of y over each row's ``own``; rows of like length at once, the last row of y being zero."""
    pieces = np.maximum(1, -(-lengths // ADDED))
    row = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * ADDED
    lengths = np.minimum(lengths[row] - nth * ADDED, ADDED)
    unit = np.maximum(4, 1 << np.maximum(np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64) - 3, 0))
    width = -(-lengths // unit) * unit
    for w in np.unique(width[lengths > 0]).tolist():
        same, step = np.flatnonzero(width == w), max(1, (1 << 16) // w)
        for at in range(0, len(same), step):
            some = same[at : at + step]
            held = np.take(own, starts[some, None] + np.arange(w), mode="clip")
            held[np.arange(w) >= lengths[some, None]] = len(y) - 1
            z = np.take(y, held.ravel(), axis=0).astype(np.float64).reshape(*held.shape, -1)
            products, sums = z.transpose(0, 2, 1) @ z, (np.ones((1, w)) @ z)[:, 0]
            if len(row) == len(a):
                a[some] += products
                b[some] += sums
            else:
                np.add.at(a, row[some], products)
                np.add.at(b, row[some], sums)


def _solved(rated: DataFrame, fixed: list[tuple[int, Broadcast]], gram: np.ndarray, regs: float, alpha: float) -> DataFrame:
    """(row, features): the factors that minimise the weighted squares, the other side's being fixed."""
    dim = len(gram)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        lengths = np.concatenate([pc.binary_length(b.column(1)).to_numpy() for b in held]).astype(np.int64) // 4
        own = np.concatenate([_integers(b.column(1)) for b in held])
        n, row = len(lengths), np.repeat(np.arange(len(lengths)), lengths) if len(fixed) > 1 else None
        a, b = np.zeros((n, dim, dim)), np.zeros((n, dim))
        for lo, y in fixed:
            if row is None:
                _add_ratings(a, b, lengths, own, y.value)
                continue
            inside = (own >= lo) & (own < lo + FACTORS)
            _add_ratings(a, b, np.bincount(row[inside], minlength=n), own[inside] - lo, y.value)
            y.__dict__.pop("_value", None)
        x = np.linalg.solve(gram + alpha * a + regs * lengths[:, None, None] * np.eye(dim), (1 + alpha) * b[..., None])[..., 0]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x.astype(np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0) for b in held]), lists], names=["row", "features"])

    return rated.mapInArrow(solve, "row bigint, features array<float>")


def als(inter: DataFrame, dim: int = 16, seed: int = 1, iterations: int = 10, regs: float = 0.1, alpha: float = 1.0) -> Factors:
    """Implicit-feedback alternating least squares, every row of inter (u, i) being a rating of 1; the objective and the defaults are those of Spark ML's ALS.

    Ratings lie in tables by user and by item. A half-step brings one side's factors to all tasks by broadcasts of FACTORS rows, one of which
    is on the driver at a time, in place of shuffling a factor to every block that rates it; the driver also holds the ids.
    """
    context = inter.sparkSession.sparkContext
    ids = [_ids(inter, c) for c in ("u", "i")]
    known = [context.broadcast(x) for x in ids]
    parts = max(context.defaultParallelism, -(-inter.count() // RATINGS))
    rated = [_rated(inter, "u", "i", known[0], known[1], parts), _rated(inter, "i", "u", known[1], known[0], parts)]

    def sent(n: int, part: Callable[[int, int], np.ndarray]) -> tuple[list[tuple[int, Broadcast]], np.ndarray]:
        chunks, gram = [], np.zeros((dim, dim))
        for lo in range(0, n, FACTORS):
            y = part(lo, min(n, lo + FACTORS))
            gram += y.T.astype(np.float64) @ y.astype(np.float64)
            chunks.append((lo, context.broadcast(np.concatenate([y, np.zeros((1, dim), np.float32)]))))
        return chunks, gram

    def first(lo: int, hi: int) -> np.ndarray:
        x = first_embedding(lo, hi, dim, seed, NODES)
        return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)

    def read(solved: DataFrame) -> Callable[[int, int], np.ndarray]:
        def part(lo: int, hi: int) -> np.ndarray:
            y = np.zeros((hi - lo, dim), np.float32)
            for b in solved.filter((F.col("row") >= lo) & (F.col("row") < hi)).toArrow().to_batches():
                if b.num_rows:
                    y[b.column(0).to_numpy() - lo] = b.column(1).flatten().to_numpy().reshape(-1, dim)
            return y

        return part

    fixed, gram = sent(len(ids[0]), first)
    out = {}
    for step in range(2 * iterations):
        side = 1 - step % 2
        solved = _solved(rated[side], fixed, gram, regs, alpha)
        # the last factors are the result; those of several broadcasts are read once for each
        last = step >= 2 * iterations - 2
        table = staged(solved) if last or len(ids[side]) > FACTORS else solved
        if last:
            out[side] = table
        used, (fixed, gram) = fixed, sent(len(ids[side]), read(table)) if step < 2 * iterations - 1 else ([], gram)
        for _, b in used:
            b.destroy()
        if not last:
            dropped(table)
    for t in rated:
        dropped(t)

    def named(side: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(known[side].value[b.column(0).to_numpy()]), b.column(1)], names=["id", "features"])

        return out[side].mapInArrow(run, "id bigint, features array<float>")

    return Factors(named(0), named(1))
