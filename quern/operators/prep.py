"""From raw records to interactions: deduplication, k-core, chronological splits, counts and audits.

An interaction table has (u bigint, i bigint) and, where time matters, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import staged


def parsed_id(text: Column) -> Column:
    """An id written as any decimal or exponent number, cut to its whole part; null if it isn't a finite number."""
    number = text.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) > 9e18), None).otherwise(number).cast("bigint")


def interactions(events: DataFrame, user: str, item: str, ts: str | None = None) -> DataFrame:
    """Distinct (u, i), with the first time ts if a time column is given. Rows with a null user or item are dropped."""
    kept = events.filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    keys = [F.col(user).alias("u"), F.col(item).alias("i")]
    return kept.select(*keys).distinct() if ts is None else kept.groupBy(*keys).agg(F.min(ts).alias("ts"))


def exploded(lists: DataFrame, key: str, items: str) -> DataFrame:
    """(u, i) of list records, repeats kept, empty and null lists and null elements skipped."""
    return lists.select(F.col(key).alias("u"), F.explode(items).alias("i")).filter("u is not null and i is not null")


def item_lists(edges: DataFrame) -> DataFrame:
    """(u, items): each user's items in ascending order, repeats kept."""
    return edges.groupBy("u").agg(F.array_sort(F.collect_list("i")).alias("items"))


def chronological_split(inter: DataFrame, train: float = 0.8, val: float = 0.9) -> DataFrame:
    """(u, i, split): per user in order of (ts, i), the first floor(train*n) rows, up to floor(val*n), and the rest."""
    by_time = Window.partitionBy("u").orderBy("ts", "i")
    ranked = inter.select("u", "i", F.row_number().over(by_time).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("u")).alias("n"))
    split = F.when(F.col("rn") <= F.floor(F.col("n") * F.lit(train)), "train").when(F.col("rn") <= F.floor(F.col("n") * F.lit(val)), "val").otherwise("test")
    return ranked.select("u", "i", split.alias("split"))


def k_core(split: DataFrame, core: int) -> DataFrame:
    """One pass of the k-core filter over (u, i, split).

    Items with at least ``core`` training rows stay; then users with at least ``core``
    training rows left; validation and test are restricted to these. Items aren't
    counted again after users have gone.
    """
    train = split.filter("split = 'train'")
    items = train.groupBy("i").count().filter(F.col("count") >= core).select("i")
    by_item = split.join(items, "i", "left_semi")
    users = by_item.filter("split = 'train'").groupBy("u").count().filter(F.col("count") >= core).select("u")
    return by_item.join(users, "u", "left_semi").select("u", "i", "split")


def split_stats(split: DataFrame) -> DataFrame:
    """(split, n, share, suspicious): rows of each split; a training share outside 70-90 % is suspicious."""
    counts = split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    odd = (F.col("split") == "train") & ~share.between(0.7, 0.9)
    return counts.crossJoin(F.broadcast(total)).select("split", "n", share.alias("share"), odd.alias("suspicious"))


def id_audit(split: DataFrame) -> DataFrame:
    """One row: largest ids, negative ids, distinct users and items, and whether both id ranges have no gaps."""
    return split.agg(
        F.max("u").alias("max_u"), F.max("i").alias("max_i"),
        F.count_if(F.col("u") < 0).alias("negative_u"), F.count_if(F.col("i") < 0).alias("negative_i"),
        F.countDistinct("u").alias("users"), F.countDistinct("i").alias("items"),
    )


def dataset_stats(split: DataFrame) -> DataFrame:
    """One row: n_users from training, n_items from all splits (both largest id + 1), rows per split and density of training plus test."""
    sizes = split.agg(
        (F.max(F.when(F.col("split") == "train", F.col("u"))) + 1).alias("n_users"), (F.max("i") + 1).alias("n_items"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")],
    )
    return sizes.withColumn("density", (F.col("n_train") + F.col("n_test")) / (F.col("n_users").cast("double") * F.col("n_items")))


def catalogue(n_items: int, spark) -> DataFrame:
    """(i): all ids 0..n_items-1, so that items without interactions exist."""
    return spark.range(n_items).select(F.col("id").alias("i"))


def item_counts(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(i, n): interactions of each catalogue item, repeats counted, 0 for items without any."""
    counts = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return items.join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def out_of_range(edges: DataFrame, n_items: int) -> DataFrame:
    """Rows whose item id is null, negative or not below n_items."""
    return edges.filter(F.col("i").isNull() | (F.col("i") < 0) | (F.col("i") >= n_items))


#: Fixed value: Knuth's multiplicative hash constant.
KNUTH = 2654435761


def hashed_category(item: Column, n: int) -> Column:
    """Category of an item without metadata."""
    return F.pmod(item * F.lit(KNUTH), F.lit(n))


def item_categories(items: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(i, cat): the known category limited to 0..n-1, else the hashed one. ``known`` has (i, cat)."""
    limited = F.greatest(F.least(F.col("cat"), F.lit(n - 1)), F.lit(0)).cast("bigint")
    return items.join(known, "i", "left").select("i", F.coalesce(limited, hashed_category(F.col("i"), n)).alias("cat"))


def category_histogram(cats: DataFrame) -> DataFrame:
    """(cat, n, imbalance): items per category; imbalance is the largest count over the smallest."""
    h = cats.groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    ends = h.agg((F.max("n") / F.min("n")).alias("imbalance"))
    return h.crossJoin(F.broadcast(ends))


def log_prior(counts: DataFrame, beta: float, mode: str) -> DataFrame:
    """(i, log_q): log of the popularity prior; 'laplace' (n+b)/(sum+items*b), 'sqrt' in proportion to sqrt(n+b), 'raw' to n.

    Raw refuses items without interactions, whose prior would be 0.
    """
    n, b = F.col("n").cast("double"), F.lit(float(beta))
    weight = {"laplace": n + b, "sqrt": F.sqrt(n + b), "raw": F.when(F.col("n") > 0, n).otherwise(F.raise_error("raw mode needs counts above 0").cast("double"))}[mode]
    weighted = counts.select("i", weight.alias("w"))
    total = weighted.agg(F.sum("w").alias("total"))
    return weighted.crossJoin(F.broadcast(total)).select("i", F.ln(F.col("w") / F.col("total")).alias("log_q"))


def prior_summary(prior: DataFrame, counts: DataFrame) -> DataFrame:
    """One row describing log_q and the counts it comes from."""
    q = prior.agg(F.min("log_q").alias("lo"), F.max("log_q").alias("hi"), F.avg("log_q").alias("mean"), F.stddev_samp("log_q").alias("std"), F.count_if(~F.isnan("log_q")).alias("n_finite"))
    c = counts.agg(F.min("n").alias("count_min"), F.max("n").alias("count_max"), F.sum("n").alias("count_sum"), F.count_if(F.col("n") == 0).alias("n_zero"))
    return q.crossJoin(F.broadcast(c))


def terciles(counts: DataFrame) -> DataFrame:
    """(i, bucket): by ascending (n, i) the first n//3 items are tail, up to 2n//3 mid, the rest head.

    The order is a range partitioning by (n, i): a rank is the number of items in earlier partitions plus
    the rank within one, so many items of one frequency are spread over partitions like all others.
    """
    ordered = staged(counts.select("i", "n").repartitionByRange("n", "i").withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    # one row for each partition
    before = sizes.withColumn("before", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
    total = sizes.agg(F.sum("c").alias("total"))
    ranked = ordered.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy("n", "i"))).join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    pos = F.col("before") + F.col("within") - 1
    bucket = F.when(pos < F.floor(F.col("total") / 3), "tail").when(pos < F.floor(F.col("total") * 2 / 3), "mid").otherwise("head")
    return ranked.select("i", bucket.alias("bucket"))


def gini(counts: DataFrame) -> DataFrame:
    """One row, gini: inequality of the counts, items without interactions included; 0 where all are 0 or there are none.

    Equal counts are taken together, so the ordered pass runs over distinct counts only.
    """
    levels = counts.groupBy(F.col("n").cast("double").alias("n")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = levels.select("n", "c", F.sum("c").over(w).alias("k"))
    # the sum over ranks of rank * count, ranks of one level being k-c+1..k
    s = run.agg(F.sum(F.col("n") * F.col("c") * (2 * F.col("k") - F.col("c") + 1) / 2).alias("s"), F.sum("c").alias("m"), F.sum(F.col("n") * F.col("c")).alias("t"))
    return s.select(F.when(F.coalesce("t", F.lit(0.0)) == 0, F.lit(0.0)).otherwise((2 * F.col("s") / F.col("t") - (F.col("m") + 1)) / F.col("m")).alias("gini"))


def coverage(recommended: DataFrame, n_items: int) -> DataFrame:
    """One row, coverage: share of the catalogue that is recommended to anyone."""
    return recommended.agg((F.countDistinct("i") / F.lit(float(n_items))).alias("coverage"))
