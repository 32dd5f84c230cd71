"""Feature tables: moments, whitening, independent components, stream fusion, spectral statistics.

A feature table is (i, v) with v array<double>. Moments are reduced in one pass per
task; only d x d matrices reach the driver, where d is the vector dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.runtime import staged


def _stack(b: pa.RecordBatch, column: int = 1) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)


#: Partial results that the driver adds up at most.
PARTIALS = 32


def reduced(features: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """(rows, sum over all batches of work(x)): tasks add up their batches, PARTIALS further tasks these, and the driver the rest."""

    def total_of(n: int, total: np.ndarray, g: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([n]), pa.array([total.ravel().tolist()]), pa.array([list(total.shape)])], names=["g", "n", "s", "shape"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                part = work(_stack(b))
                total, n = part if total is None else total + part, n + b.num_rows
        if total is not None:
            yield total_of(n, total, TaskContext.get().partitionId() % PARTIALS)

    def add(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        total = t.column("s").chunk(0).flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
        return pa.Table.from_batches([total_of(int(t.column("n").to_numpy().sum()), total.reshape(t.column("shape")[0].as_py()), t.column("g")[0].as_py())])

    n, total = 0, None
    schema = "g int, n bigint, s array<double>, shape array<bigint>"
    for r in sorted(features.select("i", "v").mapInArrow(run, schema).groupBy("g").applyInArrow(add, schema).collect()):
        part = np.array(r.s).reshape(r.shape)
        n, total = n + r.n, part if total is None else total + part
    return n, total


def moments(features: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with n-1)."""
    n, total = reduced(features, lambda x: np.vstack([x.sum(0), x.T @ x]))
    mean = total[0] / n
    return n, mean, (total[1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def mapped(features: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, v) with v = work(v), row-wise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = np.ascontiguousarray(work(_stack(b)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))], names=["i", "v"])

    return features.select("i", "v").mapInArrow(run, "i bigint, v array<double>")


def zca_matrix(cov: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    lam, u = np.linalg.eigh(cov)
    return u @ np.diag((np.maximum(lam, 0) + eps) ** -0.5) @ u.T


def zca(features: DataFrame, eps: float = 1e-5) -> DataFrame:
    """ZCA whitening."""
    _, mean, cov = moments(features)
    w = zca_matrix(cov, eps)
    return mapped(features, lambda x: (x - mean) @ w)


def whitening_report(features: DataFrame) -> DataFrame:
    """One row: rows, largest absolute covariance off the diagonal, smallest and largest variance."""
    n, _, cov = moments(features)
    off = cov - np.diag(np.diag(cov))
    row = (n, float(np.abs(off).max()), float(np.diag(cov).min()), float(np.diag(cov).max()))
    return features.sparkSession.createDataFrame([row], "n bigint, max_offdiag double, var_min double, var_max double")


def pca_ica(features: DataFrame, seed: int = 0, steps: int = 200, tol: float = 1e-4, floor: float | None = None) -> DataFrame:
    """PCA whitening, then FastICA (log cosh, symmetric decorrelation); components beyond the kept ones are 0.

    ``floor`` keeps the leading components up to that share of variance. Each step
    is one pass of partial sums, followed by k x k algebra on the driver.
    """
    n, mean, cov = moments(features)
    lam, u = np.linalg.eigh(cov)
    lam, u = lam[::-1], u[:, ::-1]
    k = int((lam > 1e-10 * lam[0]).sum())
    if floor is not None:
        k = min(k, int(np.searchsorted(np.cumsum(lam) / lam.sum(), floor)) + 1)
    white = u[:, :k] / np.sqrt(lam[:k])

    def decorrelated(w: np.ndarray) -> np.ndarray:
        s, v = np.linalg.eigh(w @ w.T)
        return v @ np.diag(1 / np.sqrt(np.maximum(s, 1e-12))) @ v.T @ w

    w = decorrelated(np.random.default_rng(seed).standard_normal((k, k)))
    z = staged(mapped(features, lambda x: (x - mean) @ white))
    for _ in range(steps):

        def step(x: np.ndarray, w=w) -> np.ndarray:
            g = np.tanh(x @ w.T)
            return np.hstack([g.T @ x, (1 - g * g).sum(0)[:, None]])

        _, s = reduced(z, step)
        new = decorrelated(s[:, :k] / n - np.diag(s[:, k] / n) @ w)
        change = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if change < tol:
            break
    d = len(mean)
    return mapped(features, lambda x: np.hstack([((x - mean) @ white) @ w.T, np.zeros((len(x), d - k))]))


def fused_streams(raw: DataFrame, pca: DataFrame | None, zca_: DataFrame | None, mode: str, alpha_p: float = 0.0, alpha_z: float = 0.0) -> DataFrame:
    """'raw', 'replace_pca', 'replace_zca', or 'residual': raw + alpha_p*s_p*P + alpha_z*s_z*Z with s making the mean row norms equal."""
    if mode == "raw":
        return raw
    if mode in ("replace_pca", "replace_zca"):
        chosen = pca if mode == "replace_pca" else zca_
        if chosen is None:
            raise ValueError(f"{mode} needs its stream")
        return raw.select("i").join(chosen, "i")
    out = raw.select("i", "v")
    for stream, alpha in ((pca, alpha_p), (zca_, alpha_z)):
        if stream is None or alpha == 0:
            continue
        s = raw.agg(F.avg(A.norm("v")).alias("r")).crossJoin(stream.agg(F.avg(A.norm("v")).alias("a"))).select((F.col("r") / F.greatest("a", F.lit(1e-12)) * F.lit(float(alpha))).alias("s"))
        out = out.join(stream.select("i", F.col("v").alias("x")), "i").crossJoin(F.broadcast(s)).select("i", F.zip_with("v", "x", lambda v, x: v + F.col("s") * x).alias("v"))
    return out


def spectra(features: DataFrame, dim: int, permutation: list[int] | None = None) -> DataFrame:
    """(i, k, re, im): orthonormal real DFT in long form."""
    z = features.select("i", F.posexplode(A.real_dft("v", dim, permutation)).alias("k", "z"))
    return z.select("i", "k", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def inverse_spectra(z: DataFrame, dim: int) -> DataFrame:
    """(i, v): the inverse of spectra(), by one row-wise pass."""
    per = z.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "re", "im"))).alias("z")).select("i", F.flatten(F.transform("z", lambda x: F.array(x["re"], x["im"]))).alias("v"))
    return mapped(per, lambda x: np.fft.irfft(x[:, 0::2] + 1j * x[:, 1::2], n=dim, norm="ortho"))


def category_phase(img: DataFrame, txt: DataFrame, cats: DataFrame) -> DataFrame:
    """(cat, k, theta): circular mean per category and bin of the phase of img * conj(txt)."""
    a, b = img.toDF("i", "k", "ar", "ai"), txt.toDF("i", "k", "br", "bi")
    cross = a.join(b, ["i", "k"]).select("i", "k", (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("x"), (F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("y"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    unit = cross.withColumn("r", F.when(r == 0, F.lit(1.0)).otherwise(r))
    return unit.join(cats, "i").groupBy("cat", "k").agg(F.atan2(F.sum(F.col("y") / F.col("r")), F.sum(F.col("x") / F.col("r"))).alias("theta"))


def rotated(z: DataFrame, cats: DataFrame, theta: DataFrame, sign: float, psi: Column | float = 0.0) -> DataFrame:
    """Rotates (i, k, re, im) by sign * (theta/2 + psi) of the item's category and bin."""
    p = psi if isinstance(psi, Column) else F.lit(float(psi))
    angle = F.lit(float(sign)) * (F.col("theta") / 2 + p)
    t = z.join(cats, "i").join(theta, ["cat", "k"]).withColumn("a", angle)
    return t.select("i", "k", (F.col("re") * F.cos("a") - F.col("im") * F.sin("a")).alias("re"), (F.col("re") * F.sin("a") + F.col("im") * F.cos("a")).alias("im"))


def bin_prior(z: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(k, prior): per bin the variance of the amplitude over items, against the mean over items of the variance within an item's spectrum: inter / (inter + intra)."""
    amp = z.select("i", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"))
    intra = amp.groupBy("i").agg(F.var_pop("a").alias("v")).agg(F.avg("v").alias("intra"))
    inter = amp.groupBy("k").agg(F.var_pop("a").alias("inter"))
    return inter.crossJoin(F.broadcast(intra)).select("k", (F.col("inter") / (F.col("inter") + F.col("intra") + F.lit(eps))).alias("prior"))


def clipped_logit(p: Column, clip: float = 2.0, eps: float = 1e-8) -> Column:
    return A.clipped(F.ln((p + F.lit(eps)) / (1 - p + F.lit(eps))), -clip, clip)


def gated(z: DataFrame, logits: DataFrame) -> DataFrame:
    """z * (1 + tanh(logit)) per bin; logits are (k, logit)."""
    g = 1 + F.tanh("logit")
    return z.join(F.broadcast(logits), "k").select("i", "k", (F.col("re") * g).alias("re"), (F.col("im") * g).alias("im"))


def coherence(img: DataFrame, txt: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(i, coherence): mean over bins of |C|^2 / (P_img * P_txt), limited to 0..1; C is the cross-spectrum of the item, P the powers plus eps.

    With one spectrum per item and modality this is 1 up to eps.
    """
    a, b = img.toDF("i", "k", "ar", "ai"), txt.toDF("i", "k", "br", "bi")
    x, y = F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"), F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")
    p = (F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai") + F.lit(eps)) * (F.col("br") * F.col("br") + F.col("bi") * F.col("bi") + F.lit(eps))
    return a.join(b, ["i", "k"]).select("i", A.clipped((x * x + y * y) / p, 0, 1).alias("c")).groupBy("i").agg(F.avg("c").alias("coherence"))


def coherence_gated(z: DataFrame, coh: DataFrame, lam: float, baseline: float | None = None) -> DataFrame:
    """z * (1 + lam * (coherence - baseline)) per item; the baseline is the mean coherence unless it is given."""
    base = coh.agg(F.avg("coherence").alias("base")) if baseline is None else coh.sparkSession.range(1).select(F.lit(float(baseline)).alias("base"))
    g = 1 + F.lit(float(lam)) * (F.col("coherence") - F.col("base"))
    return z.join(coh, "i").crossJoin(F.broadcast(base)).select("i", "k", (F.col("re") * g).alias("re"), (F.col("im") * g).alias("im"))


def deviation(z: DataFrame) -> DataFrame:
    """(k, med, mad): lower median of the amplitudes of each bin, and of their absolute differences from it."""
    amp = z.select("k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"))
    med = amp.groupBy("k").agg(F.expr("percentile_disc(0.5) within group (order by a)").alias("med"))
    return amp.join(F.broadcast(med), "k").withColumn("d", F.abs(F.col("a") - F.col("med"))).groupBy("k").agg(F.first("med").alias("med"), F.expr("percentile_disc(0.5) within group (order by d)").alias("mad"))


def saturation(x: Column) -> Column:
    """Aggregate: share of values whose tanh is beyond 0.95 either way."""
    return F.avg(F.when(F.abs(F.tanh(x)) > 0.95, 1.0).otherwise(0.0))


def projected(features: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """(i, v): v = W v + b."""
    return mapped(features, lambda x: x @ w.T + b)


def noisy(features: DataFrame, eps: float, seed: int) -> DataFrame:
    """v + eps * sign(v) * unit uniform noise; the noise depends on the row's id and the seed only. eps 0 is the identity."""
    if eps < 0:
        raise ValueError("eps must not be negative")
    if eps == 0:
        return features
    unit_noise = A.unit(F.transform("v", lambda x, k: F.pmod(F.xxhash64("i", k, F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 30)))
    return features.select("i", F.zip_with("v", unit_noise, lambda x, n: x + F.lit(float(eps)) * F.signum(x) * n).alias("v"))


def item_clusters(features: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(i, cat): k-means clusters of the unit vectors, by Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = features.select("i", array_to_vector(A.unit("v", 1e-12)).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("i", F.col("prediction").alias("cat"))
