"""Per-key results when a few keys hold most of the rows.

Counts are reduced before any shuffle (map-side combine), so a key with a third
of all rows costs one partial row per task. Quantiles use exact distributed
selection: values become order-preserving 64-bit codes, counted per key in
histograms of ``2**BITS`` bins; the bin that holds the wanted rank is opened
into the next finer histogram until the rank resolves. Only counts are
shuffled, never the values of a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import small, staged

#: Bits resolved by one histogram round: 64 bits take at most six rounds.
BITS = 11


def one_row_per_key(df: DataFrame, key: str, items: str) -> DataFrame:
    """One row per non-null ``key``, with its smallest sorted list: exports of the same list count once.

    Grouping compares the sorted lists inside partial aggregation, so a key
    with any number of rows reaches the reducer as one row per task.
    Null lists are ignored unless the key has no other.
    """
    ordered = F.array_sort(F.filter(items, lambda x: x.isNotNull()))
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.min(ordered).alias(items))


def value_histogram(df: DataFrame, key: str, items: str) -> DataFrame:
    """(k, v, c): per item k, how many keys hold it v times; each key is taken once.

    The histograms are mergeable: partial ones are summed map-side, so an item
    in a third of all lists sends one row per task and distinct value.
    """
    elements = one_row_per_key(df, key, items).select(F.col(key).alias("u"), F.explode(items).alias("k"))
    per_key = elements.groupBy("u", "k").agg(F.count(F.lit(1)).alias("v"))
    return per_key.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))


def histogram_quantiles(hist: DataFrame, fractions: list[float], bits: int = BITS) -> DataFrame:
    """(k, fraction, n, quantile): exact lower quantiles per key from value counts (k, v, c), as percentile_disc has them.

    The quantile of fraction q over n values is the value of rank max(1, ceil(q*n)).
    Values are offsets from the smallest one. Each round counts the bins of ``bits`` further
    bits within the one bin per (key, fraction) that holds the wanted rank. The state is one row
    per (key, fraction); it is broadcast only while its counted size allows it.
    """
    span = hist.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    wanted = F.array(*[F.lit(float(q)) for q in fractions])
    state = hist.groupBy("k").agg(F.sum("c").alias("n")).select("k", "n", F.explode(wanted).alias("fraction"))
    state = state.select("k", "n", "fraction", F.greatest(F.lit(1), F.ceil(F.round(F.col("fraction") * F.col("n"), 6))).cast("bigint").alias("rank"))
    if span is None or span.lo is None:
        return state.select("k", "fraction", "n", F.col("n").alias("quantile"))
    base, width = span.lo, max(1, (span.hi - span.lo).bit_length())
    shift = -(-width // bits) * bits
    state = state.withColumn("prefix", F.lit(0).cast("bigint"))
    # above 63 bits nothing is left to shift in, and a difference beyond a bigint can't be coded
    if width > 62:
        raise ValueError("values span more than 62 bits")
    code = F.col("v") - F.lit(base)
    while shift > 0:
        upper, shift = min(shift, 63), shift - bits
        state = staged(state)
        opened = hist.select("k", F.shiftright(code, upper).alias("prefix"), F.shiftright(code, shift).alias("bin"), "c")
        counted = opened.groupBy("k", "prefix", "bin").agg(F.sum("c").alias("c"))
        found = counted.join(small(state, state.count(), 48), ["k", "prefix"]).withColumn("upto", F.sum("c").over(Window.partitionBy("k", "fraction").orderBy("bin")))
        found = found.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        state = found.select("k", "n", "fraction", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("bin").alias("prefix"))
    return state.select("k", "fraction", "n", (F.col("prefix") + F.lit(base)).alias("quantile"))


def key_quantiles(df: DataFrame, key: str, value: str, fractions: list[float], bits: int = BITS) -> DataFrame:
    """(key, fraction, n, quantile): exact lower quantiles of an integer column per key.

    Null values and null keys are ignored; a key without values has no row.
    Rows are first reduced to counts of (key, value), combined map-side.
    """
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(value).cast("bigint").alias("v")).filter("k is not null and v is not null")
    hist = staged(rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")))
    return histogram_quantiles(hist, fractions, bits).withColumnRenamed("k", key)


def item_profiles(df: DataFrame, key: str, items: str, fractions: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(item_id, n_elements, n_keys, share, quantiles array): per item, elements, keys that hold it, share of all elements, and quantiles of how often a key holds it.

    Repeated elements count; each key is taken once. All figures come from the
    items' mergeable histograms, so hot items cost no more than others. Null
    keys, lists and elements count nothing; an empty table gives no rows.
    """
    hist = staged(value_histogram(df, key, items))
    totals = hist.groupBy(F.col("k").alias("item_id")).agg(F.sum(F.col("c") * F.col("v")).alias("n_elements"), F.sum("c").alias("n_keys"))
    q = histogram_quantiles(hist, list(fractions)).groupBy(F.col("k").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("fraction", "quantile"))).alias("q"))
    total = hist.agg(F.sum(F.col("c") * F.col("v")).alias("total"))
    out = totals.join(q, "item_id").crossJoin(F.broadcast(total))
    return out.select("item_id", "n_elements", "n_keys", (F.col("n_elements") / F.col("total")).alias("share"), F.transform("q", lambda x: x["quantile"]).alias("quantiles"), "total")


def heavy_items(df: DataFrame, key: str, items: str, least_percent: int) -> DataFrame:
    """(item_id): items that make up at least ``least_percent`` per cent of all non-null elements."""
    return item_profiles(df, key, items).filter(F.col("n_elements") * 100 >= F.lit(least_percent) * F.col("total")).select("item_id")


def salted_join(big: DataFrame, other: DataFrame, key: str, hot: list, salts: int = 16) -> DataFrame:
    """Inner equi-join in which rows of the ``hot`` keys are spread over ``salts`` sub-keys; the other side is repeated for these only."""
    is_hot = reduce(lambda a, b: a | b, [F.col(key) == F.lit(h) for h in hot], F.lit(False))
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"]).drop("_salt")
