"""Propagation over graphs as iterated join and aggregation, on long embeddings (node, dim, x).

The long form lets Spark combine partial sums per (node, dim) before the
shuffle, so a hub node is never gathered as one group of vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.operators.features import mapped
from quern.runtime import staged, union_all

#: Pairs of shared_mean() that are shuffled at once.
SUMMED_AT_ONCE = 1 << 23


def long_form(vectors: DataFrame) -> DataFrame:
    """(i, v) to (node, dim, x)."""
    return vectors.select(F.col("i").alias("node"), F.posexplode("v").alias("dim", "x"))


def wide_form(emb: DataFrame) -> DataFrame:
    """(node, dim, x) to (i, v)."""
    return emb.groupBy(F.col("node").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))


def propagated(edges: DataFrame, emb: DataFrame) -> DataFrame:
    """One step: x_i = sum over edges (i, j, w) of w * x_j. Nodes without edges have no rows, which stands for zeros."""
    return edges.select(F.col("i").alias("to"), F.col("j").alias("node"), "w").join(emb, "node").groupBy(F.col("to").alias("node"), "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def layer_mean(edges: DataFrame, emb: DataFrame, layers: int) -> DataFrame:
    """Mean of the embeddings after 0..layers steps; lineage is cut at each layer."""
    parts, current = [emb], emb
    for _ in range(layers):
        current = staged(propagated(edges, current))
        parts.append(current)
    return union_all(*parts).groupBy("node", "dim").agg((F.sum("x") / F.lit(float(layers + 1))).alias("x"))


def last_layer(edges: DataFrame, emb: DataFrame, layers: int) -> DataFrame:
    """Embeddings after ``layers`` steps."""
    for _ in range(layers):
        emb = staged(propagated(edges, emb))
    return emb


def shared_mean(pairs: DataFrame, dim: int) -> DataFrame:
    """(u, v) of distinct (u, i, v), v being the user's vector of ``dim`` numbers: the mean of the other users' vectors, each as often as it shares an item.

    This is one step over the row-normalised graph of co-counts without its edges, whose number is
    quadratic in an item's users: vectors are summed by item, and each user adds up the sums of its items
    less its own vector. Users who share no item have no row. Large tables are summed in up to eight parts, one after the other, so their shuffles
    aren't on disk together.
    """
    d = range(dim)
    parts = min(8, max(1, -(-pairs.count() // SUMMED_AT_ONCE)))

    def summed(work: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
        return union_all(*[staged(work(pairs.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(parts)) == p))) for p in range(parts)])

    items = summed(lambda some: some.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[k]).alias(f"s{k}") for k in d]).filter("n > 1"), "i")
    others = summed(lambda some: some.join(items, "i").groupBy("u").agg(F.sum(F.col("n") - 1).alias("w"), *[F.sum(F.col(f"s{k}") - F.col("v")[k]).alias(f"s{k}") for k in d]), "u")
    return others.select("u", F.array(*[F.col(f"s{k}") / F.col("w") for k in d]).alias("v"))


def gated_layer(edges: DataFrame, emb: DataFrame, w_gc: np.ndarray, b_gc: np.ndarray, w_bi: np.ndarray, b_bi: np.ndarray, slope: float = 0.2) -> DataFrame:
    """leaky(GC(side)) + leaky(Bi(ego * side)), rows then of unit length; side is one propagation step. Embeddings are (i, v)."""
    d = len(b_gc)
    side = wide_form(propagated(edges, long_form(emb)))
    both = emb.join(side.select("i", F.col("v").alias("s")), "i", "left").select("i", F.concat("v", F.coalesce("s", F.array(*[F.lit(0.0)] * d))).alias("v"))

    def work(x: np.ndarray) -> np.ndarray:
        def leaky(y: np.ndarray) -> np.ndarray:
            return np.where(y > 0, y, slope * y)

        y = leaky(x[:, d:] @ w_gc.T + b_gc) + leaky((x[:, :d] * x[:, d:]) @ w_bi.T + b_bi)
        n = np.sqrt((y * y).sum(1))
        return y / np.where(n == 0, 1, n)[:, None]

    return mapped(both, work)


def fused_views(base: DataFrame, view: DataFrame) -> DataFrame:
    """(i, v): base + the view's unit rows; nodes that the view lacks keep their base."""
    joined = base.join(view.select("i", A.unit("v").alias("x")), "i", "left")
    return joined.select("i", F.when(F.col("x").isNull(), F.col("v")).otherwise(A.plus("v", "x")).alias("v"))


def edge_weights(inter: DataFrame, users: DataFrame, items: DataFrame, g: list[float], prototypes: list[list[float]] | None = None, lam: float = 0.0, tau: float = 1.0) -> DataFrame:
    """(u, i, sav, iav, ptv, w) of each interaction.

    sav = sigmoid(<e_u, e_i>); iav = softmax over a user's items of sigmoid(<e_u*g, e_i*g>);
    shared = sav * iav; w = sav + iav - shared, and with prototypes
    sav + iav + lam*ptv - (1 + lam)*shared, ptv being the dot product of the softmax assignments
    at temperature tau limited to 0.05..20.
    """
    gg = F.array(*[F.lit(float(x) ** 2) for x in g])
    e = inter.select("u", "i").distinct().join(users.select(F.col("i").alias("u"), F.col("v").alias("eu")), "u").join(items.select("i", F.col("v").alias("ei")), "i")
    scored = e.select("u", "i", A.sigmoid(A.dot("eu", "ei")).alias("sav"), A.sigmoid(A.dot(F.zip_with("eu", gg, lambda x, y: x * y), "ei")).alias("q"), *([_ptv(prototypes, tau).alias("ptv")] if prototypes else [F.lit(0.0).alias("ptv")]))
    # sigmoids lie in 0..1, so exp needs no shift by the maximum; sums are combined before the shuffle
    total = scored.groupBy("u").agg(F.sum(F.exp("q")).alias("z"))
    out = scored.join(total, "u").select("u", "i", "sav", (F.exp("q") / F.col("z")).alias("iav"), "ptv")
    extra = float(lam) if prototypes else 0.0
    return out.withColumn("w", F.col("sav") + F.col("iav") + extra * F.col("ptv") - (1 + extra) * F.col("sav") * F.col("iav"))


def _ptv(prototypes: list[list[float]], tau: float):
    t = min(max(tau, 0.05), 20.0)

    def assign(v: str):
        return A.softmax(F.array(*[A.dot(v, F.array(*[F.lit(float(x)) for x in p])) for p in prototypes]), t)

    return A.dot(assign("eu"), assign("ei"))


def weighted_view(weights: DataFrame, n_users: int) -> DataFrame:
    """The symmetric bipartite graph of (u, i, w), each weight over the square roots of both degrees (at least 1e-12)."""
    both = weights.select(F.col("u").alias("i"), (F.col("i") + F.lit(n_users)).alias("j"), "w")
    both = union_all(both, both.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    d = both.groupBy("i").agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("d"))
    return both.join(d.toDF("i", "di"), "i").join(d.toDF("j", "dj"), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def running_best(log: DataFrame, metric: str) -> DataFrame:
    """Adds best (largest so far) and improved (strictly above all before) to (run, epoch, metric)."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("best", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("improved", before.isNull() | (F.col(metric) > before))
