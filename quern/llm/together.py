"""Items that appear together, by heavy-light decomposition.

Items in many records are heavy, the others light. Pairs of heavy items are
counted as popcounts of ANDed rows of a dense bit matrix, one per block of
records; pairs of light items are generated per record and counted by code
within the block; for mixed pairs each light item's list of records probes the
heavy items' bits. Blocks give partial counts, which are summed.

Items with fewer records than the least pair count can't be in a result and are
left out beforehand, as are items in more than n/lift records where a least
lift is asked for (lift = c*n/(fa*fb) <= n/max(fa, fb), since c <= min(fa, fb)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.setcodes import item_sets
from quern.runtime import staged

#: An item is heavy from this share of all records. At most 1/HEAVY times the mean set size of items can be heavy.
HEAVY = 1 / 64
#: Records in a block, and pair codes generated at a time.
BLOCK, CODES = 65_536, 4_000_000


def _summed(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, int)
    counts = np.diff(np.append(new, len(a))) if c is None else np.add.reduceat(c[order], new) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], counts.astype(np.int64)


def _out(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], names=["item_a", "item_b", "c"])


def count_block(heavy: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Partial pair counts of one block: records are flat[starts[i]:starts[i+1]], items distinct and ascending within a record."""
    n = len(starts) - 1
    record = np.repeat(np.arange(n), np.diff(starts))
    at = np.searchsorted(heavy, flat)
    is_heavy = (at < len(heavy)) & (heavy[np.minimum(at, max(len(heavy) - 1, 0))] == flat) if len(heavy) else np.zeros(len(flat), bool)
    bits = np.zeros((len(heavy), n), np.uint8)
    bits[at[is_heavy], record[is_heavy]] = 1
    # heavy with heavy: popcounts of ANDed rows
    words = np.packbits(bits, axis=1)
    words = np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).view(np.uint64)
    for i in range(len(heavy) - 1):
        c = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
        j = np.flatnonzero(c)
        if len(j):
            yield _out(np.full(len(j), heavy[i]), heavy[i + 1 + j], c[j])
    light, owner = flat[~is_heavy], record[~is_heavy]
    # light with heavy: each light item's list of records probes the bits
    if len(heavy) and len(light):
        order = np.argsort(light, kind="stable")
        item, rows = light[order], owner[order]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        step = max(1, CODES // len(rows) + 1)
        for h in range(0, len(heavy), step):
            c = np.add.reduceat(bits[h : h + step][:, rows].astype(np.int32), first, axis=1)
            hi, li = np.nonzero(c)
            if len(hi):
                yield _out(heavy[h + hi], item[first[li]], c[hi, li].astype(np.int64))
    # light with light: pairs at distance d within a record, counted by sorting
    ends = np.searchsorted(owner, owner, side="right")
    parts, held = [], 0
    for d in range(1, int(np.bincount(owner).max()) if len(owner) else 0):
        p = np.flatnonzero(np.arange(len(light)) + d < ends)
        for q in range(0, len(p), CODES):
            x = p[q : q + CODES]
            parts.append((light[x], light[x + d]))
            held += len(x)
            if held >= CODES:
                yield _out(*_summed(*(np.concatenate(v) for v in zip(*parts))))
                parts, held = [], 0
    if held:
        yield _out(*_summed(*(np.concatenate(v) for v in zip(*parts))))


def item_pairs(df: DataFrame, key: str, items: str, least: int = 8, least_lift: float | None = None, heavy: float = HEAVY) -> DataFrame:
    """(item_a, item_b, c, f_a, f_b, n, lift): pairs of items in the sets of at least ``least`` keys, item_a < item_b.

    n counts keys with a non-empty set, f the keys with an item, c those with both; lift = c*n/(f_a*f_b).
    Keys that are null, null lists, null items and repeats within a key count nothing; no rows come
    from an empty table. The frequent items' list, at most n_records*mean/(heavy*n_records), is
    the only thing sent to the tasks.
    """
    spark = df.sparkSession
    sets = staged(item_sets(df, [key], items).select(F.monotonically_increasing_id().alias("r"), "s"))
    n = sets.count()
    if n == 0:
        return spark.createDataFrame([], "item_a bigint, item_b bigint, c bigint, f_a bigint, f_b bigint, n bigint, lift double")
    f = staged(sets.select(F.explode("s").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("f")))
    kept = f.filter(F.col("f") >= least)
    if least_lift:
        kept = kept.filter(F.col("f") * F.lit(float(least_lift)) <= F.lit(float(n)))
    many = np.sort(np.array([r.item for r in kept.filter(F.col("f") >= max(heavy * n, least)).select("item").collect()], np.int64))
    long = sets.select("r", F.explode("s").alias("item")).join(kept.select("item"), "item", "left_semi")
    records = long.groupBy("r").agg(F.array_sort(F.collect_list("item")).alias("s")).filter(F.size("s") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block() -> Iterator[pa.RecordBatch]:
            s = pa.concat_arrays(held)
            offsets = s.offsets.to_numpy().astype(np.int64)
            yield from count_block(many, s.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0])

        for b in batches:
            held.append(b.column(0))
            rows += b.num_rows
            if rows >= BLOCK:
                yield from block()
                held, rows = [], 0
        if rows:
            yield from block()

    partial = records.select("s").mapInArrow(run, "item_a bigint, item_b bigint, c bigint")
    pairs = partial.groupBy("item_a", "item_b").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    out = pairs.join(f.toDF("item_a", "f_a"), "item_a").join(f.toDF("item_b", "f_b"), "item_b").withColumn("n", F.lit(n).cast("bigint"))
    out = out.withColumn("lift", F.col("c").cast("double") * F.col("n") / (F.col("f_a").cast("double") * F.col("f_b")))
    if least_lift:
        out = out.filter(F.col("c").cast("double") * F.col("n") >= F.lit(float(least_lift)) * F.col("f_a").cast("double") * F.col("f_b"))
    return out.select("item_a", "item_b", "c", "f_a", "f_b", "n", "lift")
