"""Top N rows within every group, by descending score bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import staged, union_all

#: Shares of all edges above the lower ends of the bands; the last band takes the rest.
BANDS = (0.05, 0.25)


def clean_edges(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(g, i, v): every edge once, with its largest score. Nulls, NaN and edges from an item to itself are ignored."""
    v = F.col(score)
    ok = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.col(group) != F.col(item)))
    return ok.groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(F.max(v).alias("v"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(group, item, score, rank): for every group its ``n`` items of the largest score, equal scores by smaller item.

    The score range is cut into bands at approximate quantiles. From the highest
    band down: groups already filled are taken out by an anti-join, counts per
    group (reduced map-side) tell which groups fill within the band; a group
    whose band fits is taken whole, and only groups that overflow are ranked,
    by a window whose limit is applied before the shuffle. Whatever the cuts,
    the result is the same. Groups without a valid edge have no rows.
    """
    valid = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(group) != F.col(item)))
    cuts = valid.agg(F.percentile_approx(score, F.array(*[F.lit(1 - b) for b in bands]), F.lit(1000)).alias("cuts")).first().cuts if bands else []
    cuts = sorted({float(c) for c in cuts or []}, reverse=True)
    # every band is a folder of its own, so a pass over a band reads nothing else
    band_of = F.lit(len(cuts))
    for k, low in reversed(list(enumerate(cuts))):
        band_of = F.when(F.col("v") >= F.lit(low), k).otherwise(band_of)
    edges = staged(clean_edges(df, group, item, score).withColumn("band", band_of), by="band")
    filled = None  # groups with n rows
    short = None  # (g, have): groups with some rows, fewer than n
    parts: list[DataFrame] = []
    for k in range(len(cuts) + 1):
        band = edges.filter(F.col("band") == k).drop("band")
        if filled is not None:
            band = band.join(filled, "g", "left_anti")
        counts = band.groupBy("g").agg(F.count(F.lit(1)).alias("more"))
        if short is not None:
            counts = counts.join(short, "g", "full")
        counts = staged(counts.select("g", F.coalesce("more", F.lit(0)).alias("more"), (F.col("have") if short is not None else F.lit(0)).alias("have")).fillna(0, ["have"]))
        need = counts.filter("more > 0").select("g", "have", (F.col("more") + F.col("have") > n).alias("over"))
        rows = band.join(need, "g")
        whole = rows.filter("not over").select("g", "i", "v")
        order = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("i"))
        # rank <= n first, so that the limit runs before the shuffle; then what the group still lacks
        cut = rows.filter("over").withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= n).filter(F.col("rk") + F.col("have") <= n).select("g", "i", "v")
        parts += [whole, cut]
        if k == len(cuts):
            break
        full = counts.filter(F.col("more") + F.col("have") >= n).select("g")
        filled = staged(full if filled is None else union_all(filled, full))
        short = counts.filter(F.col("more") + F.col("have") < n).select("g", (F.col("more") + F.col("have")).alias("have"))
    kept = union_all(*parts)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("i"))))
    return kept.select(F.col("g").alias(group), F.col("i").alias(item), F.col("v").alias(score), "rank")
