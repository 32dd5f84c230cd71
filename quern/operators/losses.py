"""Forward values of the training losses, as one-row tables; and seeded triplets.

Contrastive losses compare rows within chunks of consecutive ids; a chunk's size
is a parameter of the definition, so tasks are bounded by it. The all-row form is the
same with one chunk per pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.operators.prep import KNUTH
from quern.runtime import union_all


def triplets(inter: DataFrame, n_items: int, draws: int = 8, seed: int = 1, reject: bool = True) -> DataFrame:
    """(u, pos, neg): for every user one positive and one negative item, by hashes of ids.

    The positive is the user's item of the smallest hash; negatives are ``draws``
    hashed catalogue items of which the first that isn't the user's is taken (``reject``), or simply the
    first. Users all of whose draws are their own items get the r-th catalogue item that isn't theirs, r by the
    first draw; only users of the whole catalogue have no row.
    """
    h = F.pmod((F.col("i") + F.lit(seed)) * F.lit(KNUTH) + F.col("u") * F.lit(40503), F.lit(1_000_003))
    pos = inter.groupBy("u").agg(F.min_by("i", F.struct(h.alias("h"), F.col("i"))).alias("pos"))
    cand = pos.select("u", "pos", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("t"))
    cand = cand.withColumn("neg", F.pmod(F.col("u") * F.lit(KNUTH) + (F.col("t") + F.lit(seed)) * F.lit(7919), F.lit(n_items)))
    if reject:
        free = cand.join(inter.select("u", F.col("i").alias("neg")).distinct(), ["u", "neg"], "left_anti")
        left = cand.filter("t = 0").join(free.select("u").distinct(), "u", "left_anti")
        own = inter.filter(F.col("i").between(0, n_items - 1)).groupBy("u").agg(F.array_sort(F.collect_set("i")).alias("items"))
        cand = union_all(free, left.join(own, "u").withColumn("neg", unseen("items", n_items, F.col("neg"))).filter("neg is not null").select(*free.columns))
    return cand.groupBy("u").agg(F.first("pos").alias("pos"), F.min_by("neg", "t").alias("neg"))


def unseen(items: str, n_items: int, r: Column) -> Column:
    """The r-th (modulo their number) of the ids 0 to n_items - 1 that aren't in the sorted list ``items`` of such ids; null if there is none."""
    rest = F.lit(n_items) - F.size(items)
    rank = F.when(rest > 0, F.pmod(r, rest))
    # the list's p-th item, p from 0, has item - p free ids below it
    return rank + F.aggregate(F.transform(F.col(items), lambda x, p: x - p), F.lit(0).cast("bigint"), lambda n, below: n + F.when(below <= rank, 1).otherwise(0))


def bpr(trip: DataFrame, users: DataFrame, items: DataFrame, regs: float = 0.0) -> DataFrame:
    """One row (n, bpr, reg): mean of log(1 + exp(s- - s+)), and regs * half the squared norms over the number of triplets."""
    t = trip.join(users.select(F.col("i").alias("u"), F.col("v").alias("eu")), "u").join(items.select(F.col("i").alias("pos"), F.col("v").alias("ep")), "pos").join(items.select(F.col("i").alias("neg"), F.col("v").alias("en")), "neg")
    x = A.dot("eu", "ep") - A.dot("eu", "en")
    squares = sum((A.dot(c, c) for c in ("eu", "ep", "en")), F.lit(0.0))
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg(F.log1p(F.exp(-x))).alias("bpr"), (F.lit(float(regs)) * F.sum(squares) / 2 / F.count(F.lit(1))).alias("reg"))


def infonce(z1: DataFrame, z2: DataFrame, tau: float, chunk: int, log_q: DataFrame | None = None, scale: float = 1.0, clip: float = 5.0, reflexive: bool = False) -> DataFrame:
    """One row (n, loss): mean of -log(exp(s_ii) / sum_j exp(s_ij)), s = cosine/tau, j over the ids of the same chunk (id div chunk).

    ``log_q`` (i, log_q) subtracts scale * log_q, limited to +-clip, from column j.
    ``reflexive`` adds the other rows of z1 to the denominator, as the symmetric graph loss does.
    """
    a = z1.select("i", F.floor(F.col("i") / chunk).alias("c"), A.unit("v").alias("x"))
    b = z2.select(F.col("i").alias("j"), F.floor(F.col("i") / chunk).alias("c"), A.unit("v").alias("y"))
    shift = F.lit(0.0)
    if log_q is not None:
        b = b.join(log_q.select(F.col("i").alias("j"), "log_q"), "j")
        shift = A.clipped(F.col("log_q") * F.lit(float(scale)), -clip, clip)
    s = a.join(b, "c").select("i", "j", (A.dot("x", "y") / F.lit(float(tau)) - shift).alias("s"))
    if reflexive:
        r = a.select(F.col("i").alias("j"), "c", F.col("x").alias("y"))
        s = union_all(s.withColumn("own", F.lit(False)), a.join(r, "c").filter("i <> j").select("i", "j", (A.dot("x", "y") / F.lit(float(tau))).alias("s"), F.lit(True).alias("own")))
    else:
        s = s.withColumn("own", F.lit(False))
    # cosines are at most 1, so exp(s - 1/tau) can't overflow without the row maximum
    top = F.lit(1.0 / float(tau) + (clip if log_q is not None else 0.0))
    row = s.groupBy("i").agg(F.max(F.when((F.col("i") == F.col("j")) & ~F.col("own"), F.col("s"))).alias("diag"), (top + F.ln(F.sum(F.exp(F.col("s") - top)))).alias("lse"))
    return row.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("lse") - F.col("diag")).alias("loss"))


def infonce_all(z1: DataFrame, z2: DataFrame, tau: float, block: int = 4096) -> DataFrame:
    """infonce() with all rows of z2 in the denominator: each pair of blocks is one matrix product that sends a partial sum per row."""
    n = max(1, -(-z1.count() // block))

    def side(z: DataFrame, own: str, other: str, k: int) -> DataFrame:
        here = F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
        there = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        return z.select(here.alias(own), there.alias(other), "i", A.unit("v").alias("v"), F.lit(k).alias("side")).select("p", "q", "i", "v", "side")

    def sums(t: pa.Table) -> pa.Table:
        which, ids = t.column("side").to_numpy(), t.column("i").to_numpy()
        x = np.stack(t.column("v").to_pylist())
        a, b = np.flatnonzero(which == 0), np.flatnonzero(which == 1)
        s = x[a] @ x[b].T / tau
        same = ids[a][:, None] == ids[b][None]
        diag = np.where(same, s, 0).sum(1)
        return pa.table({"i": ids[a], "diag": diag, "z": np.exp(s - 1 / tau).sum(1)})

    both = union_all(side(z1, "p", "q", 0), side(z2, "q", "p", 1))
    rows = both.groupBy("p", "q").applyInArrow(sums, "i bigint, diag double, z double").groupBy("i").agg(F.sum("diag").alias("diag"), F.sum("z").alias("z"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.ln("z") + F.lit(1 / tau) - F.col("diag")).alias("loss"))


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of two loss rows."""
    return a.toDF("n", "x").crossJoin(b.toDF("n2", "y")).select("n", ((F.col("x") + F.col("y")) / 2).alias("loss"))


def gate_pull(theta: list[tuple[str, float]], target: float, weight: float, spark) -> DataFrame:
    """One row, loss: weight * sum of (gate - target)^2."""
    t = spark.createDataFrame(theta, "name string, value double")
    return t.agg((F.lit(float(weight)) * F.sum(F.pow(F.col("value") - F.lit(float(target)), F.lit(2.0)))).alias("loss"))


def running_state(updates: DataFrame, warmup: int, frozen: bool = False) -> DataFrame:
    """(key, epoch, x, ema): the running average of each key over its epochs, beta = 1 - 1/(t+1) during warm-up, then 0.99.

    The first value is taken as it is. ``frozen`` keeps that first value for good.
    """
    w = Window.partitionBy("key").orderBy("epoch")
    if frozen:
        return updates.select("key", "epoch", "x", F.first("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ema"))
    so_far = F.collect_list(F.struct("epoch", "x")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    beta = lambda t: F.when(t < warmup, 1 - 1 / (t.cast("double") + 1)).otherwise(F.lit(0.99))
    step = F.aggregate(F.slice(so_far, 2, F.greatest(F.size(so_far) - 1, F.lit(0))), F.element_at(so_far, 1)["x"], lambda s, p: beta(p["epoch"]) * s + (1 - beta(p["epoch"])) * p["x"])
    return updates.select("key", "epoch", "x", step.alias("ema"))
