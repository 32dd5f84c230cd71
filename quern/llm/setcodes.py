"""Similarity joins of set-valued records by binary codes.

Records with equal sets form one class; classes are joined, never copies. A
join has three steps:

1. every class gets a code of many bits (one-bit minhashes or a similarity hash), which is cut into
   segments of equal length;
2. classes that agree in a segment are joined on it, some segments at a time; a pair
   is a candidate if the sizes allow the similarity and the first 256 bits of the codes, packed in four longs, lie within a Hamming radius;
3. the original sets are compared exactly.

By the pigeonhole two codes that differ in fewer bits than there are segments agree in one; beyond that the number of segments
is calibrated: from the probability that a bit differs at the least similarity it follows how many are needed so
that no more than MISS of the pairs at the threshold (and far less above it) agree in none. The radius loses another 1e-9. The length of a segment grows with the
logarithm of the classes, so a class has about as many candidates by chance in a larger table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.vectors import mixed
from quern.runtime import staged, union_all

#: Bits of the packed code that the radius is for, segments joined at once, and the share of pairs at the threshold that may agree in no segment.
BITS, AT_ONCE, MISS = 256, 12, 1e-6


def item_sets(df: DataFrame, key: list[str], items: str, least: int = 1) -> DataFrame:
    """(key..., s): the sorted distinct non-null items of each key over all its rows; sets under ``least`` items are left out.

    Rows with a null in the last key column, null and empty lists are ignored.
    Equal lists of one key are merged map-side, so a key that is repeated very
    often reaches the reducer as one list per task.
    """
    s = F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())))
    rows = df.filter(F.col(key[-1]).isNotNull()).select(*[F.col(k).alias(k) for k in key], s.alias("s")).filter(F.size("s") > 0)
    sets = rows.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("s"))
    return sets.filter(F.size("s") >= least)


def minhash_bits(flat: np.ndarray, starts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One bit of each of many minhashes of the sets flat[starts[i]:starts[i+1]]; no set is empty."""
    rng = np.random.default_rng(20240613)
    a = rng.integers(0, 1 << 32, (bits, 2), dtype=np.uint32) | np.uint32(1)
    x = (mixed(flat.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(starts), bits), np.uint32)
    for j in range(bits):
        h = (x ^ (x >> np.uint32(j % 13 + 3))) * a[j, 0]
        h ^= h >> np.uint32(15)
        h *= a[j, 1]
        low[:, j] = np.minimum.reduceat(h, starts)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (low >> np.uint32(31)).astype(np.uint8)


def similarity_bits(flat: np.ndarray, starts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity-hash bits: bit j says whether most items have hash bit j; ties give 0."""
    sizes = np.diff(np.append(starts, len(flat)))[:, None]
    out = np.empty((len(starts), -(-bits // 64) * 64), np.uint8)
    base = mixed(flat.astype(np.uint64))
    for w in range(out.shape[1] // 64):
        word = mixed(base + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        votes = np.add.reduceat(np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.int32)
        out[:, 64 * w : 64 * w + 64] = 2 * votes > sizes
    return out[:, :bits]


def with_codes(sets: DataFrame, kind: str, segments: int, length: int) -> DataFrame:
    """Adds c0..c3, the packed first 256 bits of the code of ``s``, and seg, the values of its segments; kind is 'minhash' or 'simhash'. Sets aren't empty."""
    coded = {"minhash": minhash_bits, "simhash": similarity_bits}[kind]
    names = [c for c in sets.columns]
    powers = (1 << np.arange(length, dtype=np.int64)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                s = b.column(names.index("s"))
                flat = s.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = s.offsets.to_numpy()
                code = coded(flat, (offsets[:-1] - offsets[0]).astype(np.int64), max(BITS, segments * length))
                first = np.packbits(code[:, :BITS], axis=1).view(np.int64)
                seg = (code[:, : segments * length].reshape(-1, length) @ powers).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * np.int32(segments)), pa.array(seg))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(first[:, w])) for w in range(4)), lists], names=[*names, "c0", "c1", "c2", "c3", "seg"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema)
    return sets.mapInArrow(run, f"{kept}, c0 bigint, c1 bigint, c2 bigint, c3 bigint, seg array<int>")


def segments_for(n: float, difference: float, miss: float = MISS) -> tuple[int, int]:
    """(segments, their length) for n classes whose codes differ in a bit with probability ``difference`` at the threshold."""
    length = min(24, max(6, round(math.log2(max(n, 2))) - 4))
    return math.ceil(math.log(miss) / math.log1p(-((1 - difference) ** length))), length


def radius(p: float, miss: float = 1e-9, bits: int = BITS) -> int:
    """The least r with P(Binomial(bits, p) > r) <= miss."""
    tail, r = 0.0, bits
    while r > 0:
        tail += math.exp(math.lgamma(bits + 1) - math.lgamma(r + 1) - math.lgamma(bits - r + 1) + r * math.log(p) + (bits - r) * math.log1p(-p))
        if tail > miss:
            return r
        r -= 1
    return 0


def minhash_difference(num: int, den: int) -> float:
    """Probability that one-bit minhashes differ at Jaccard similarity num/den."""
    return (1 - num / den) / 2


def simhash_difference(num: int, den: int, least: int, most: int = 60) -> float:
    """The largest probability that a similarity-hash bit differs between two sets of least..most items at Jaccard similarity of num/den or more.

    Exact by summing over the votes of the shared and the two private parts. For larger sets it tends to the
    angle's share (0.172 at 3/4), which is below the value for small sets.
    """

    def binom(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n

    worst = 0.0
    for a in range(least, most + 1):
        for b in range(a, a * den // num + 1):
            shared = -(-num * (a + b) // (num + den))
            if shared > a:
                continue
            ps, pa_, pb = binom(shared), binom(a - shared), binom(b - shared)
            v = np.arange(shared + 1)[:, None]
            up_a = (pa_[None] * (2 * (v + np.arange(len(pa_))[None]) > a)).sum(1)
            up_b = (pb[None] * (2 * (v + np.arange(len(pb))[None]) > b)).sum(1)
            worst = max(worst, float((ps * (up_a * (1 - up_b) + up_b * (1 - up_a))).sum()))
    return worst


def similar_classes(left: DataFrame, right: DataFrame | None, num: int, den: int, kind: str, difference: float, length: int = 0) -> DataFrame:
    """(a, b, common, size_a, size_b): pairs of classes with Jaccard similarity of at least num/den.

    ``left`` and ``right`` have (cid bigint, s array<bigint>), cid unique and s distinct within a
    side. Without ``right`` the pairs are within ``left``, a < b; with it a is of left and b of
    right, and equal sets of both sides are among the pairs. ``difference`` is the probability that a bit of the code
    differs at the threshold; a segment has ``length`` bits, or as many as fit the number of classes.
    """
    sides = [left.select("cid", "s")] + ([] if right is None else [right.select("cid", "s")])
    n = math.prod(math.sqrt(max(1, side.count())) for side in sides) ** (2 / len(sides))
    segments, fitting = segments_for(n, difference)
    if length:
        segments, length = math.ceil(math.log(MISS) / math.log1p(-((1 - difference) ** length))), length
    else:
        length = fitting
    coded = [staged(with_codes(side, kind, segments, length)) for side in sides]
    r = radius(difference)
    near = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in ("c0", "c1", "c2", "c3"))

    def keyed(side: DataFrame, name: str, at: int) -> DataFrame:
        seg = F.posexplode(F.slice("seg", at + 1, AT_ONCE)).alias("segment", "value")
        return side.select(seg, *[F.col(c).alias(f"{name}_{c}") for c in ("cid", "c0", "c1", "c2", "c3")], F.size("s").alias(f"{name}_n"))

    found = []
    for at in range(0, segments, AT_ONCE):
        pairs = keyed(coded[0], "a", at).hint("merge").join(keyed(coded[-1], "b", at), ["segment", "value"])
        if right is None:
            pairs = pairs.filter("a_cid < b_cid")
        pairs = pairs.filter(f"a_n * {den} >= b_n * {num} and b_n * {den} >= a_n * {num} and {near} <= {r}")
        found.append(staged(pairs.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()))
    pairs = staged(union_all(*found).distinct(), done=found)
    sa, sb = coded[0].select(F.col("cid").alias("a"), F.col("s").alias("s_a")), coded[-1].select(F.col("cid").alias("b"), F.col("s").alias("s_b"))
    both = pairs.join(sa, "a").join(sb, "b").select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("common"), F.size("s_a").alias("size_a"), F.size("s_b").alias("size_b"))
    return staged(both.filter(f"common * {den} >= {num} * (size_a + size_b - common)"), done=[*coded, pairs])


def user_classes(train: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Members (user_id, cid) and classes (cid, s) of train_split: users with equal item sets share a class, named by its smallest user_id."""
    sets = staged(item_sets(train, ["user_id"], "train_items", least))
    classes = staged(sets.groupBy("s").agg(F.min("user_id").alias("cid"), F.count(F.lit(1)).alias("size")))
    members = staged(sets.join(classes, "s").select("user_id", "cid"))
    return members, classes


def similar_users(train: DataFrame, num: int = 7, den: int = 10, least: int = 5) -> DataFrame:
    """(user_a, user_b): different users whose item sets of at least ``least`` items have a Jaccard similarity of num/den or more."""
    members, classes = user_classes(train, least)
    across = similar_classes(classes, None, num, den, "minhash", minhash_difference(num, den)).select("a", "b")
    within = classes.filter("size > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    pairs = union_all(across, within)
    out = pairs.join(members.toDF("u", "a"), "a").join(members.toDF("v", "b"), "b").filter("a <> b or u < v")
    return out.select(F.least("u", "v").alias("user_a"), F.greatest("u", "v").alias("user_b"))


def user_links(train: DataFrame, num: int = 7, den: int = 10, least: int = 5) -> DataFrame:
    """(user_id, class_id, n_links): one row for every user with at least ``least`` items; n_links counts the other users at similarity num/den or more.

    Copies aren't expanded: links are summed over classes.
    """
    members, classes = user_classes(train, least)
    pairs = similar_classes(classes, None, num, den, "minhash", minhash_difference(num, den)).select("a", "b")
    sizes = classes.select("cid", "size")
    both = union_all(pairs, pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.toDF("b", "size"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("size").alias("n"))
    total = sizes.join(links, "cid", "left").select("cid", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return members.join(total, "cid").select("user_id", F.col("cid").alias("class_id"), "n_links")


def _evaluation_sets(val: DataFrame, test: DataFrame, least: int) -> DataFrame:
    def one(df: DataFrame, name: str, items: str) -> DataFrame:
        return item_sets(df, ["eval_id"], items, least).select(F.lit(name).alias("split_name"), "eval_id", "s")

    return union_all(one(val, "val", "val_set"), one(test, "test", "test_set"))


def split_overlap(train: DataFrame, val: DataFrame, test: DataFrame, num: int = 3, den: int = 4, least: int = 5) -> DataFrame:
    """(split_name, eval_id, user_id): evaluation records whose item sets are those of a training user, exactly or at Jaccard similarity num/den.

    Both sets have at least ``least`` items. Classes of equal sets are joined on
    both sides and expanded to records at the end.
    """
    members, classes = user_classes(train, least)
    records = staged(_evaluation_sets(val, test, least))
    theirs = staged(records.groupBy("s").agg(F.min("eval_id").alias("cid")))
    pairs = similar_classes(theirs, classes, num, den, "simhash", simhash_difference(num, den, least)).select("a", "b")
    of = records.join(theirs, "s").select("split_name", "eval_id", F.col("cid").alias("a"))
    return pairs.join(of, "a").join(members.toDF("user_id", "b"), "b").select("split_name", "eval_id", "user_id")


def split_overlap_report(train: DataFrame, val: DataFrame, test: DataFrame, num: int = 3, den: int = 4, least: int = 5) -> DataFrame:
    """(split_name, source, n_records, n_overlapping): per split and source, evaluation records with enough items and those also in training.

    A record's source is its smallest non-null one; none is reported as 'unknown'.
    """
    hits = split_overlap(train, val, test, num, den, least).select("split_name", "eval_id").distinct().withColumn("hit", F.lit(1))

    def sources(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("eval_id").agg(F.coalesce(F.min("source"), F.lit("unknown")).alias("source")).withColumn("split_name", F.lit(name))

    source = union_all(sources(val, "val"), sources(test, "test"))
    records = _evaluation_sets(val, test, least).select("split_name", "eval_id").join(source, ["split_name", "eval_id"])
    return records.join(hits, ["split_name", "eval_id"], "left").groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("n_records"), F.count("hit").alias("n_overlapping"))
