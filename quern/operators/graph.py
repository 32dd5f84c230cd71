"""Item and user graphs as edge tables (i, j, w), unique on (i, j).

All rankings are total orders: weight descending, then the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import staged, union_all


def top_per_row(edges: DataFrame, k: int, row: str = "i", col: str = "j", weight: str = "w") -> DataFrame:
    """The ``k`` heaviest edges of each row with their rank rk; Spark applies the limit before the shuffle too."""
    order = Window.partitionBy(row).orderBy(F.col(weight).desc(), F.col(col))
    return edges.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def co_counts(inter: DataFrame, by: str, of: str, least: int = 1, self_pairs: bool = False) -> DataFrame:
    """(i, j, w): for pairs of ``of`` the number of distinct ``by`` they share, both directions.

    Each unordered pair is generated and counted once, and mirrored after the
    count, which halves the shuffle. Pairs need a partner of at least ``least``
    rows, so rarer ones are left out before the self-join.
    """
    pairs = inter.select(F.col(by).alias("by"), F.col(of).alias("of")).distinct()
    if least > 1:
        pairs = pairs.join(pairs.groupBy("of").count().filter(F.col("count") >= least).select("of"), "of", "left_semi")
    a, b = pairs.toDF(*[{"by": "by", "of": "i"}[c] for c in pairs.columns]), pairs.toDF(*[{"by": "by", "of": "j"}[c] for c in pairs.columns])
    counted = a.join(b, "by").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= least)
    both = counted.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "w").select("e.i", "e.j", "w")
    if self_pairs:
        both = union_all(both, pairs.groupBy("of").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= least).select(F.col("of").alias("i"), F.col("of").alias("j"), "w"))
    return both


def bipartite(inter: DataFrame, n_users: int) -> DataFrame:
    """The user-item graph: items are nodes n_users + i, each pair gives both directions with weight 1."""
    p = inter.select(F.col("u").alias("i"), (F.col("i") + F.lit(n_users)).alias("j")).distinct()
    return p.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")).select("e.i", "e.j", F.lit(1.0).alias("w"))


def degrees(edges: DataFrame, node: str = "i") -> DataFrame:
    return edges.groupBy(node).agg(F.sum("w").alias("d"))


def _power(d: Column, p: float) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(F.pow(d.cast("double"), F.lit(p)))


def normalised(edges: DataFrame, how: str) -> DataFrame:
    """'rw' w/d_i; 'sym' with row degrees on both sides; '2sym' with row and column degrees; 'origin' as it is. A degree of 0 gives 0."""
    if how == "origin":
        return edges
    row = degrees(edges).withColumnRenamed("d", "di")
    out = edges.join(row, "i")
    if how == "rw":
        return out.select("i", "j", (F.col("w") * _power(F.col("di"), -1.0)).alias("w"))
    side = {"sym": degrees(edges).toDF("j", "dj"), "2sym": degrees(edges, "j").toDF("j", "dj")}[how]
    out = out.join(side, "j", "left")
    return out.select("i", "j", (F.col("w") * _power(F.col("di"), -0.5) * F.coalesce(_power(F.col("dj"), -0.5), F.lit(0.0))).alias("w"))


def row_scaled(edges: DataFrame, by: str) -> DataFrame:
    """Weights over the largest ('max') or the sum ('sum') of their row; a row of zeros stays.

    The row statistic comes from an aggregation with map-side combine and is
    joined back, so a hub's edges aren't sorted together.
    """
    stat = edges.groupBy("i").agg((F.max if by == "max" else F.sum)("w").alias("s"))
    return edges.join(stat, "i").select("i", "j", (F.col("w") / F.when(F.col("s") == 0, F.lit(1)).otherwise(F.col("s"))).alias("w"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, not yet unique."""
    return union_all(edges.select("i", "j", "w"), edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def symmetric_max(edges: DataFrame) -> DataFrame:
    """The larger weight of both directions, at least 0."""
    return mirrored(edges).groupBy("i", "j").agg(F.greatest(F.max("w"), F.lit(0.0)).alias("w"))


def symmetric_mean(edges: DataFrame) -> DataFrame:
    """Half the sum of both directions, a missing one being 0."""
    return mirrored(edges).groupBy("i", "j").agg((F.sum("w") * F.lit(0.5)).alias("w"))


def weighted_sum(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """Sum of graphs, each times its factor; parts of factor 0 are left out of the plan."""
    scaled = [g.select("i", "j", (F.col("w") * F.lit(float(a))).alias("w")) for a, g in parts if a != 0]
    return union_all(*scaled).groupBy("i", "j").agg(F.sum("w").alias("w"))


def graph_stats(edges: DataFrame, n: int) -> DataFrame:
    """One row: non-zero edges, rows with any, average degree over n nodes, largest row."""
    per = edges.filter("w <> 0").groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    return per.agg(F.sum("d").alias("nnz"), F.count(F.lit(1)).alias("rows"), (F.sum("d") / F.lit(float(n))).alias("avg_degree"), F.max("d").alias("max_degree"))


def hypergraph(knn: DataFrame) -> DataFrame:
    """H H^T of binary neighbour lists knn(m, i, j): pairs that share a neighbour, counted over neighbours and modalities, diagonal included.

    A neighbour of h lists makes h*h pairs: they are counted as (i <= j) once and mirrored.
    """
    e = staged(knn.select("m", "i", "j"))
    pairs = e.alias("a").join(e.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.i") <= F.col("b.i")))
    counted = pairs.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return union_all(counted, counted.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def interest_tree(edges: DataFrame, hops: int = 3, k: int | None = None) -> DataFrame:
    """(anchor, nbr, ord, w): breadth-first expansion of every anchor at once, pruned by level.

    Level 1 is all neighbours of the anchor. A node belongs to the level at which it is
    discovered, with the weight of the edge from its first parent in frontier
    order, even if it is then pruned. Of level o >= 2 the
    max(1, floor(size of the previous level / (2(o-1)))) heaviest nodes stay.
    """
    g = edges.select("i", "j", F.col("w").cast("double").alias("w"))
    if k is not None:
        g = top_per_row(g, k).drop("rk")
    g = staged(g.withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy(F.col("w").desc(), "j"))))
    level = g.select(F.col("i").alias("anchor"), F.col("j").alias("nbr"), "w", "pos")
    found, kept = [level.select("anchor", "nbr")], [level.withColumn("ord", F.lit(1))]
    for o in range(2, hops + 1):
        step = level.select("anchor", "nbr", F.col("pos").alias("parent")).join(g.select(F.col("i").alias("nbr"), F.col("j").alias("next"), "w", "pos"), "nbr")
        step = step.filter("next <> anchor").groupBy("anchor", F.col("next").alias("nbr")).agg(F.min_by("w", F.struct("parent", "pos")).alias("w"))
        new = step.join(union_all(*found), ["anchor", "nbr"], "left_anti")
        keep = level.groupBy("anchor").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / F.lit((o - 1) * 2.0)).cast("int")).alias("keep"))
        ranked = staged(new.withColumn("pos", F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("w").desc(), "nbr"))))
        found.append(ranked.select("anchor", "nbr"))
        level = ranked.join(keep, "anchor").filter("pos <= keep").drop("keep").select("anchor", "nbr", "w", "pos")
        if o < hops:
            level = staged(level)
        kept.append(level.withColumn("ord", F.lit(o)))
    return union_all(*[x.select("anchor", "nbr", "ord", "w") for x in kept])


def tree_coefficients(tree: DataFrame, gamma: float, tau: float) -> DataFrame:
    """(i, j, w): gamma * e^-(ord-1) * w^tau."""
    c = F.lit(float(gamma)) * F.exp(-(F.col("ord") - 1).cast("double")) * F.pow("w", F.lit(float(tau)))
    return tree.select(F.col("anchor").alias("i"), F.col("nbr").alias("j"), c.alias("w"))


def augmented(sim: DataFrame, coef: DataFrame, form: str = "production", full: DataFrame | None = None) -> DataFrame:
    """A similarity graph raised by tree coefficients.

    'production': sim/2 * (1 + coef) on the edges of sim. 'sparse': sim/2 +
    coef*sim on the edges of sim. 'dense': sim + coef * full, where coefficients
    also add edges outside sim, with their similarity taken from ``full``.
    """
    c = coef.select("i", "j", F.col("w").alias("c"))
    if form == "dense":
        if full is None:
            raise ValueError("the dense form needs the full similarities")
        extra = c.join(full.select("i", "j", F.col("w").alias("s")), ["i", "j"]).select("i", "j", (F.col("c") * F.col("s")).alias("w"))
        return weighted_sum([(1.0, sim), (1.0, extra)])
    c0 = F.coalesce("c", F.lit(0.0))
    w = {"production": F.col("w") * 0.5 * (1 + c0), "sparse": F.col("w") * 0.5 + c0 * F.col("w")}[form]
    return sim.join(c, ["i", "j"], "left").select("i", "j", w.alias("w"))


def popularity_damped(edges: DataFrame, counts: DataFrame, eta: float) -> DataFrame:
    """w * (max(n_i, 1) * max(n_j, 1))^-eta; eta 0 changes nothing."""
    if eta == 0:
        return edges
    n = counts.select("i", F.greatest(F.col("n"), F.lit(1)).cast("double").alias("n"))
    out = edges.join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
    return out.select("i", "j", (F.col("w") * F.pow(F.col("ni") * F.col("nj"), F.lit(-float(eta)))).alias("w"))


def fused_item_graph(sims: list[tuple[float, DataFrame]], coef: DataFrame, co: DataFrame, alpha_interest: float, counts: DataFrame, eta: float) -> DataFrame:
    """Augmented modality graphs plus the row-normalised, popularity-damped co-occurrence graph, max-symmetrised and sym-normalised."""
    parts = [(a, augmented(s, coef)) for a, s in sims if a != 0]
    if alpha_interest != 0:
        parts.append((alpha_interest, popularity_damped(row_scaled(co, "sum"), counts, eta)))
    return normalised(symmetric_max(weighted_sum(parts)), "sym")


def pair_patterns(inter: DataFrame, least: int, ratio: float) -> DataFrame:
    """(i, j, support, rel): item pairs i < j with support >= least and support/min(n_i, n_j) >= ratio, the relative support."""
    n = inter.select("u", "i").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    pairs = co_counts(inter, "u", "i", least).filter("i < j")
    out = pairs.join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
    out = out.withColumn("rel", F.col("w") / F.least("ni", "nj").cast("double")).filter(F.col("rel") >= F.lit(float(ratio)))
    return out.select("i", "j", F.col("w").alias("support"), "rel")


def parsed_patterns(patterns: DataFrame) -> DataFrame:
    """(i, j, support, rel) from text columns pattern ('i<TAB>j<TAB>') and support ('35 : 1.0'); only pairs of different items."""
    t = patterns.select(F.split(F.trim(F.regexp_replace("pattern", "[,\\s]+", " ")), " ").alias("t"), F.split("support", ":").alias("s"))
    t = t.filter(F.size("t") == 2).select(F.col("t")[0].try_cast("bigint").alias("i"), F.col("t")[1].try_cast("bigint").alias("j"), F.trim(F.col("s")[0]).try_cast("bigint").alias("support"), F.trim(F.get("s", F.lit(1))).try_cast("double").alias("rel"))
    return t.filter("i is not null and j is not null and i <> j")


def absolute_support(value: float, n: int) -> int:
    """A support given as a share (below 1) or a count, as a count of at least 1."""
    if value <= 0:
        raise ValueError("support must be above 0")
    return max(1, round(value * n)) if value < 1 else int(value)


def blended(a: DataFrame, b: DataFrame, alpha: float, k: int) -> DataFrame:
    """(1-alpha) * a + alpha * b, both row-max-normalised, symmetrised by the mean and cut to the k heaviest per row."""
    mixed = weighted_sum([(1 - alpha, row_scaled(a, "max")), (alpha, row_scaled(b, "max"))])
    return top_per_row(symmetric_mean(mixed), k)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows found in only one of two tables."""
    only_a = a.exceptAll(b).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only_first").alias("side"), "n")
    return union_all(only_a, b.exceptAll(a).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only_second").alias("side"), "n"))
