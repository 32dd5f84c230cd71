"""Exact nearest neighbours by cosine.

Exact neighbours of every row need every pair. Rows are cut into blocks of a fixed
size, and a task compares one block with one other as a matrix product, keeping
only the k best of each row: tasks have a bounded size and shuffle k rows for
each of theirs. The work grows with the square of the rows; use an approximate index beyond a few
million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.runtime import union_all

BLOCK = 4096


def approximate_neighbours(vectors: DataFrame, k: int, tables: int = 8, width: float = 0.5, reach: float = 0.9, seed: int = 5) -> DataFrame:
    """(i, j, sim, rk): as cosine_neighbours(), over candidates of Spark ML's bucketed random projections on unit vectors within distance ``reach``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("i", A.unit("v").alias("v")).withColumn("x", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(rows)
    pairs = model.approxSimilarityJoin(rows, rows, reach).select(F.col("datasetA.i").alias("i"), F.col("datasetB.i").alias("j"), F.round(A.dot("datasetA.v", "datasetB.v"), 9).alias("sim")).filter("i <> j")
    order = Window.partitionBy("i").orderBy(F.col("sim").desc(), "j")
    return pairs.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def cosine_neighbours(vectors: DataFrame, k: int, include_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, j, sim, rk) of vectors (i, v): the k rows of largest cosine, rounded to 9 digits, ties to the smaller id.

    Rows of zero length have similarity 0 to all. With ``include_self`` a row is a candidate for itself.
    """
    n = max(1, -(-vectors.count() // block))
    rows = vectors.select("i", "v", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int").alias("b"))
    left = rows.select(F.col("b").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q"), "i", "v", F.lit(0).alias("side"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"), F.col("b").alias("q"), "i", "v", F.lit(1).alias("side"))

    def best(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("i").to_numpy()
        x = np.stack(t.column("v").to_pylist()).astype(np.float64)
        length = np.sqrt((x * x).sum(1))
        x = x / np.where(length == 0, 1, length)[:, None]
        us, its = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        its = its[np.argsort(ids[its], kind="stable")]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(us), 512):
            mine = us[at : at + 512]
            s = np.round(x[mine] @ x[its].T, 9)
            if not include_self:
                s[ids[mine][:, None] == ids[its][None]] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            sims = np.take_along_axis(s, order, 1)
            u, j = np.repeat(ids[mine], order.shape[1]), ids[its][order].ravel()
            ok = np.isfinite(sims.ravel())
            out.append((u[ok], j[ok], sims.ravel()[ok]))
        i, j, s = (np.concatenate(c) for c in zip(*out))
        return pa.table({"i": i, "j": j, "sim": s})

    found = union_all(left, right).groupBy("p", "q").applyInArrow(best, "i bigint, j bigint, sim double")
    order = Window.partitionBy("i").orderBy(F.col("sim").desc(), "j")
    return found.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)
