"""Experiment statistics: seeds, deltas, paired tests, logs, early stopping."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def mean_std(x: str) -> tuple[Column, Column]:
    """Mean (NaN without values) and sample deviation (0 for one value)."""
    return F.coalesce(F.avg(x), F.lit(float("nan"))).alias(f"{x}_mean"), F.when(F.count(x) == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias(f"{x}_std")


def seed_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per group, mean, deviation and number of non-null values of each metric."""
    return runs.groupBy(*keys).agg(*[c for m in metrics for c in (*mean_std(m), F.count(m).alias(f"{m}_n"))])


def baseline_delta(summary: DataFrame, tag: str, baseline: str, metric: str, least: float = 0.0005) -> DataFrame:
    """(tag, mean, delta_points, verdict): 100 * (mean - the baseline's); better or worse from ``least`` on, else equal."""
    base = summary.filter(F.col(tag) == baseline).select(F.col(metric).alias("base"))
    d = F.col(metric) - F.col("base")
    verdict = F.when(d >= least, "better").when(d <= -least, "worse").otherwise("equal")
    return summary.crossJoin(F.broadcast(base)).select(F.col(tag).alias("tag"), F.col(metric).alias("mean"), (d * 100).alias("delta_points"), verdict.alias("verdict"))


def paired_statistics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, mean_diff, sem, t) of the paired differences a - b; t is null where all are equal."""
    d = F.col(a) - F.col(b)
    row = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), (F.stddev_samp(d) / F.sqrt(F.count(d).cast("double"))).alias("sem"))
    return row.withColumn("t", F.when(F.col("sem") > 0, F.col("mean_diff") / F.col("sem")))


@dataclass(frozen=True)
class PairedTest:
    n: int
    mean_diff: float
    t: float
    p: float
    p_corrected: float
    low: float
    high: float

    @property
    def significant(self) -> bool:
        return self.p_corrected < 0.05


def paired_test(pairs: DataFrame, a: str, b: str, alpha: float = 0.05, comparisons: int = 1) -> PairedTest:
    """Two-sided paired t-test with confidence interval and Bonferroni correction; needs two pairs or more.

    The t distribution comes from the mathematics library in Spark's JVM.
    """
    r = paired_statistics(pairs, a, b).first()
    if r.n < 2:
        raise ValueError("a paired test needs at least two pairs")
    if r.t is None:
        p = 1.0 if r.mean_diff == 0 else 0.0
        return PairedTest(r.n, r.mean_diff, math.inf if p == 0 else 0.0, p, min(1.0, p * comparisons), r.mean_diff, r.mean_diff)
    dist = pairs.sparkSession.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution(float(r.n - 1))
    p = 2 * dist.cumulativeProbability(-abs(r.t))
    half = dist.inverseCumulativeProbability(1 - alpha / 2) * r.sem
    return PairedTest(r.n, r.mean_diff, r.t, p, min(1.0, p * comparisons), r.mean_diff - half, r.mean_diff + half)


def log_metrics(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(run, metrics...): of each run's text lines (run, n, line) the first match of each pattern's first group, as double."""
    found = lines
    for name, p in patterns.items():
        hit = F.regexp_extract("line", p, 1)
        found = found.withColumn(name, F.when(hit != "", hit).try_cast("double"))
    return found.groupBy("run").agg(*[F.min_by(F.col(m), F.when(F.col(m).isNotNull(), F.col("n"))).alias(m) for m in patterns])


MONITOR = re.compile(r"val_(recall|ndcg|precision|bucket_geo)@(\d+)")


def parsed_monitor(monitor: str, ks: list[int]) -> tuple[str, int]:
    """(metric, k) of a monitor such as val_recall@20; k must be among ``ks``."""
    m = MONITOR.fullmatch(monitor)
    if not m or int(m[2]) not in ks:
        raise ValueError(f"unknown monitor {monitor}")
    return m[1], int(m[2])


def evaluated_epochs(log: DataFrame, every: int, last: int, total: int) -> DataFrame:
    """Epochs at which an evaluation runs: each ``every``-th and the ``last`` ones."""
    return log.filter((F.col("epoch") % every == 0) | (F.col("epoch") >= total - last))


def best_epochs(log: DataFrame, metric: str, taken: str) -> DataFrame:
    """(run, epoch, metric, taken): each run's best epoch by ``metric``, the earliest of equal ones, and another column's value there."""
    key = F.struct(F.col(metric).alias("m"), (-F.col("epoch")).alias("e"))
    return log.groupBy("run").agg(F.max_by("epoch", key).alias("epoch"), F.max(metric).alias(metric), F.max_by(taken, key).alias(taken))


def stopping_epoch(log: DataFrame, metric: str, patience: int, grow_every: int = 0) -> DataFrame:
    """(run, stop): the first epoch at which the best is ``patience`` or more evaluations old; no row if a run never stops.

    With ``grow_every`` patience grows by one for each that many epochs.
    """
    w = Window.partitionBy("run").orderBy("epoch")
    n = F.row_number().over(w)
    better = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.withColumn("n", n).withColumn("improved", better.isNull() | (F.col(metric) > better))
    since = marked.withColumn("last", F.max(F.when(F.col("improved"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.lit(patience) + (F.floor(F.col("epoch") / grow_every) if grow_every else F.lit(0))
    return since.filter(F.col("n") - F.col("last") >= limit).groupBy("run").agg(F.min("epoch").alias("stop"))


def grid(space: dict[str, list], seeds: list[int], spark: SparkSession) -> DataFrame:
    """(tag, seed, name, value): all combinations of a configuration space, times the seeds, as text."""
    rows = []
    for values in product(*space.values()):
        tag = "_".join(f"{k}{v}" for k, v in zip(space, values))
        rows += [(tag, s, k, str(v)) for s in seeds for k, v in zip(space, values)]
    return spark.createDataFrame(rows, "tag string, seed bigint, name string, value string")


def markdown(summary: DataFrame, tag: str, metrics: list[str]) -> str:
    """A table of 100 * mean ± 100 * deviation, best first."""
    lines = [f"| {tag} | " + " | ".join(metrics) + " |", "|" + "-|" * (len(metrics) + 1)]
    for r in summary.orderBy(F.col(f"{metrics[0]}_mean").desc(), tag).toLocalIterator():
        lines.append(f"| {r[tag]} | " + " | ".join(f"{100 * r[f'{m}_mean']:.2f} ± {100 * r[f'{m}_std']:.2f}" for m in metrics) + " |")
    return "\n".join(lines)
