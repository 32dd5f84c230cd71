"""The k most similar vectors of every vector by a hash-prefix forest.

A tree's hash gives every vector a string of 64 bits, one per random hyperplane; a tree
is the sorted array of its strings. The first levels of several trees are distributed: the array
is cut into blocks of at most about BLOCK vectors that share their leading bits, one task each. Within a block
the forest goes on in memory with ARRAYS sorted arrays of further long strings:

* descent: every vector goes down each array to its longest matching prefix;
* synchronous ascent: level by level it goes up in all arrays at once, until the
  vectors with a matching prefix, counted over all arrays, are at least GATHER. The prefix length is thus another for
  every vector: long where vectors are dense, short, down to the whole block, where they are sparse.

The vectors of one node are compared with those that stop at it by one matrix product. Cosines that decide are taken
in double precision from the original vectors and rounded to 9 digits, so equal ones go to
the smaller item however many there are.

How many trees are built follows from the number of blocks and RECALL, the share of neighbours at a cosine
of 0.85 that has to be found; README.md has measured recalls. Blocks are cut at
quantiles of a bounded sample of SAMPLE strings; every vector is indexed and every one is a query. A string that fills more than one block
(vectors of one direction, say) is dealt to several, each of which gets the string's k + 1 smallest items as well.

Copies: vectors that are equal bit by bit are one entry. An item's neighbours are its copies and those of its
entry's neighbours; of each only the k + 1 smallest ids can matter and are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.vectors import MODALITIES, mixed, packed, row_keys, unit_rows, unpacked
from quern.runtime import dropped, staged, union_all

#: Most vectors of a block, about.
BLOCK = 65_536
ARRAYS, GATHER = 16, 3_072
#: Neighbours at a cosine of 0.85 that the trees are to find, and those of them that a block finds if it holds both.
RECALL, IN_BLOCK = 0.995, 0.97
#: Strings at most (about) from which the cuts of a tree are taken.
SAMPLE = 65_536
#: Rows compared with a node at once, pairs computed exactly at once, and twice the error (at most) of a product of 32-bit unit vectors.
CHUNK, PAIRS, ERROR = 1_024, 20_000, 4e-5


def hyperplanes(dim: int, bits: int, salt: int) -> np.ndarray:
    return np.random.default_rng([1000 + dim, salt]).standard_normal((dim, bits)).astype(np.float32)


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(n, strings) of 64-bit strings as uint64 in the strings' order."""
    return np.packbits((x @ planes) > 0, axis=1).view(">u8").astype(np.uint64)


def trees_for(blocks: int) -> int:
    """Trees that find RECALL of the neighbours at a cosine of 0.85 if each is cut into so many blocks."""
    together = (1 - math.acos(0.85) / math.pi) ** math.log2(max(1, blocks))
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - IN_BLOCK * together)))


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    high = np.frexp((v >> np.uint64(32)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])


class Arrays:
    """Sorted arrays of a block's strings, with the length of the prefix that neighbours in the order share."""

    def __init__(self, strings: np.ndarray):
        self.n = len(strings)
        self.order = [np.argsort(s, kind="stable") for s in strings.T]
        self.shared = []
        for s, order in zip(strings.T, self.order):
            s = s[order]
            self.shared.append(np.concatenate([[-1], 64 - _bit_lengths(s[1:] ^ s[:-1])]))

    def nodes(self, array: int, level: int) -> np.ndarray:
        """Begins of the nodes of ``level`` shared bits in the order of ``array``, and the end."""
        return np.append(np.flatnonzero(self.shared[array] < level), self.n)

    def ascended(self, gather: int) -> np.ndarray:
        """For each vector the deepest level at which its nodes of all arrays hold ``gather`` vectors together (0 if none does)."""
        level_of = np.zeros(self.n, np.int64)
        for level in range(1, 65):
            total = np.zeros(self.n, np.int64)
            for a, order in enumerate(self.order):
                sizes = np.diff(self.nodes(a, level))
                total[order] += np.repeat(sizes, sizes)
            enough = total >= gather
            if not enough.any():
                break
            level_of[enough] = level
        return level_of


def exact_cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of x[i] and y[j], unit vectors in double precision, in units of 1e-9."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        out[at : at + PAIRS] = np.einsum("ij,ij->i", x[i[at : at + PAIRS]], y[j[at : at + PAIRS]])
    return np.rint(out * 1e9).astype(np.int64)


def best_of_node(x: np.ndarray, x32: np.ndarray, rows: np.ndarray, node: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine in 1e-9): for each of ``rows`` its k most similar others in ``node`` of at least ``least``, ties to the smaller index; ``node`` is ascending."""
    least9, n = round(least * 1e9), len(node)
    y32 = x32[node].T
    for at in range(0, len(rows), CHUNK):
        r = rows[at : at + CHUNK]
        s = x32[r] @ y32
        own = np.searchsorted(node, r)
        s[np.arange(len(r)), own] = -9
        i, j = np.divmod(np.flatnonzero(s >= least - ERROR), n)
        many = np.flatnonzero(np.bincount(i, minlength=len(r)) > k)
        if len(many):
            limit = np.full(len(r), -9, np.float32)
            limit[many] = np.partition(s[many], n - k, axis=1)[:, n - k] - np.float32(ERROR)
            near = s[i, j] >= limit[i]
            i, j = i[near], j[near]
            long = np.bincount(i, minlength=len(r)) > 8 * k
            if long.any():
                # long ties: one product in double precision, then the smallest of those level with the k-th
                dense = np.flatnonzero(long)
                c = np.rint((x[r[dense]] @ x[node].T) * 1e9)
                c[np.arange(len(dense)), own[dense]] = -9e9
                last = np.partition(c, n - k, axis=1)[:, [n - k]]
                above, level = c > last, c == last
                keep = (above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))) & (c >= least9)
                p, q = np.nonzero(keep)
                yield r[dense[p]], node[q], c[p, q].astype(np.int64)
                i, j = i[~long[i]], j[~long[i]]
        c = exact_cosines(x, x, r[i], node[j])
        yield r[i[c >= least9]], node[j[c >= least9]], c[c >= least9]


def best_in_block(x: np.ndarray, k: int, least: float, salt: int, arrays: int = ARRAYS, gather: int = GATHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine in 1e-9): for each unit vector its k most similar others among those that the arrays bring together, ties to the smaller index."""
    x32 = x.astype(np.float32)
    forest = Arrays(hash_strings(x32, hyperplanes(x.shape[1], 64 * arrays, salt)))
    level_of = forest.ascended(gather)
    parts = [(np.zeros(0, np.int64),) * 3]
    for level in np.unique(level_of).tolist():
        for a in range(arrays if level else 1):
            order = forest.order[a]
            begins = forest.nodes(a, level)
            here = np.flatnonzero(level_of[order] == level)
            at = np.searchsorted(begins, here, side="right") - 1
            edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist() + [len(at)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                node = order[begins[at[lo]] : begins[at[lo] + 1]]
                if len(node) > 1:
                    parts += best_of_node(x, x32, order[here[lo:hi]], np.sort(node), min(k, len(node) - 1), least)
    i, j, c = (np.concatenate(v) for v in zip(*parts))
    order = np.lexsort((j, -c, i))
    i, j, c = i[order], j[order], c[order]
    new = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(i)]
    i, j, c = i[new], j[new], c[new]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], c[rank < k]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _parts(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(m, rows, vectors) of each run of one modality in batches whose first column is m and whose last is the vector."""
    for b in batches:
        m = b.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, m[1:] != m[:-1])).tolist() + [b.num_rows] if len(m) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = b.slice(lo, hi - lo)
            yield int(m[lo]), part, unpacked(part.column(part.num_columns - 1), kinds[m[lo]])


def _entries(df: DataFrame, item: str, modalities: tuple, kinds: list) -> tuple[DataFrame, DataFrame]:
    """Items (m, item_id, key) and entries (m, key, first, x): the original vectors, copies merged; first is the smallest item."""

    def originals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, (_, _, dim) in enumerate(modalities):
                rows, _ = unit_rows(b.column(m + 1), dim)
                if len(rows):
                    x = b.column(m + 1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(kinds[m]).reshape(len(rows), dim)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), m, np.int32)), b.column(0).take(pa.array(rows)), pa.array(row_keys(x)), packed(x)], names=["m", "item_id", "key", "x"])

    source = df.filter(f"`{item}` is not null").selectExpr(f"cast(`{item}` as bigint) item_id", *[f"`{c}`" for _, c, _ in modalities])
    rows = source.mapInArrow(originals, "m int, item_id bigint, key bigint, x binary")
    items = staged(rows.groupBy("m", "item_id").agg(F.min("key").alias("key")))
    # the entries of a modality have to be next to each other
    return items, staged(rows.groupBy("m", "key").agg(F.min("item_id").alias("first"), F.min("x").alias("x")).sortWithinPartitions("m", "key"))


def cuts_of(strings: np.ndarray, blocks: int) -> np.ndarray:
    """Where an array of sorted ``strings`` is cut into ``blocks``: near the quantiles, between the largest nodes.

    A cut is the least string of a node, so that no node but the one around it is cut; only a string that goes on over half a block is a cut itself.
    """
    n, out = len(strings), []
    shared = 64 - _bit_lengths(strings[1:] ^ strings[:-1])
    reach = max(1, n // (4 * blocks))
    for q in np.linspace(0, n, blocks + 1)[1:-1].astype(int):
        lo, hi = max(1, q - reach), min(n, q + reach + 1)
        if lo < hi:
            near = shared[lo - 1 : hi - 1]
            best = np.flatnonzero(near == near.min()) + lo
            at = best[np.abs(best - q).argmin()]
            bits = np.uint64(63 - min(63, int(near.min())))
            out.append(strings[at] >> bits << bits)
    return np.array(out, np.uint64)


class Cuts:
    """The blocks of every tree: per modality and tree the strings at which the array is cut."""

    def __init__(self, entries: DataFrame, kinds: list, dims: list[int]):
        counts = {r.m: r["count"] for r in entries.groupBy("m").count().collect()}
        self.dims = dims
        self.blocks = {m: -(-n // BLOCK) for m, n in counts.items()}
        self.trees = trees_for(max(self.blocks.values(), default=1))
        every = max(1, -(-sum(counts.values()) // SAMPLE))
        held: dict[int, list] = {}
        if max(self.blocks.values(), default=1) > 1:
            sample = entries.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).limit(2 * SAMPLE).sortWithinPartitions("m")
            for m, _, x in _parts(iter(sample.select("m", "key", "x").toArrow().to_batches()), kinds):
                held.setdefault(m, []).append(x)
        self.at: dict[tuple[int, int], np.ndarray] = {}
        for m, n in self.blocks.items():
            x = np.concatenate(held[m]) if m in held else np.zeros((0, dims[m]), np.float32)
            for t in range(self.trees):
                self.at[m, t] = cuts_of(np.sort(self.strings(m, t, x)), n)

    def strings(self, m: int, t: int, x: np.ndarray) -> np.ndarray:
        # the lengths don't matter for the signs
        return hash_strings((x / np.abs(x).max(1, keepdims=True)).astype(np.float32), hyperplanes(self.dims[m], 64, 2 * t))[:, 0]

    def placed(self, m: int, t: int, x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, string) of every vector; a string at several cuts is dealt to the blocks that these begin."""
        s, at = self.strings(m, t, x), self.at[m, t]
        lo, hi = np.searchsorted(at, s, "left"), np.searchsorted(at, s, "right")
        return np.where(hi - lo > 1, lo + 1 + (mixed(keys.view(np.uint64)) % np.maximum(hi - lo, 1).astype(np.uint64)).astype(np.int64), hi), s

    def heavy(self, m: int, t: int) -> np.ndarray:
        """Strings that are dealt to several blocks."""
        s, n = np.unique(self.at[m, t], return_counts=True)
        return s[n > 1]


def _found(entries: DataFrame, cuts: Cuts, t: int, kinds: list, k: int, least: float) -> DataFrame:
    """(m, a, b, first, similarity): the k best partners b of every entry a in its block of tree t."""
    schema = "m int, g int, key bigint, first bigint, core boolean, x binary"
    block_schema = pa.schema([("m", pa.int32()), ("g", pa.int32()), ("key", pa.int64()), ("first", pa.int64()), ("core", pa.bool_()), ("x", pa.binary())])
    extra: dict[tuple[int, int], list[int]] = {}
    heavy = {m: cuts.heavy(m, t) for m in cuts.blocks}
    if any(len(h) for h in heavy.values()):

        def of_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m, b, x in _parts(batches, kinds):
                s = cuts.strings(m, t, x)
                rows = np.flatnonzero(np.isin(s, heavy[m]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(s[rows].view(np.int64)), b.column(1).take(pa.array(rows)), b.column(2).take(pa.array(rows))], names=["m", "s", "key", "first"])

        order = Window.partitionBy("m", "s").orderBy("first")
        ranked = entries.mapInArrow(of_heavy, "m int, s bigint, key bigint, first bigint").withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k + 1)
        for r in ranked.collect():
            at = cuts.at[r.m, t]
            lo, hi = (int(np.searchsorted(at, np.uint64(r.s % (1 << 64)), side)) for side in ("left", "right"))
            for block in range(lo + 1, hi + 1):
                extra.setdefault((r.m, block), []).append(r.key)
    offset = {m: sum(n for o, n in cuts.blocks.items() if o < m) for m in cuts.blocks}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, b, x in _parts(batches, kinds):
            keys = b.column(1).to_numpy()
            block, _ = cuts.placed(m, t, x, keys)
            rows, core, to = [np.arange(len(keys))], [np.ones(len(keys), bool)], [block]
            for (o, g), listed in extra.items():
                if o == m:
                    more = np.flatnonzero(np.isin(keys, np.array(listed)) & (block != g))
                    rows, core, to = [*rows, more], [*core, np.zeros(len(more), bool)], [*to, np.full(len(more), g)]
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array((np.concatenate(to) + offset[m]).astype(np.int32)), b.column(1).take(at), b.column(2).take(at), pa.array(np.concatenate(core)), b.column(3).take(at)], names=["m", "g", "key", "first", "core", "x"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, block_schema).combine_chunks()
        if table.num_rows:
            m = int(table.column("m")[0].as_py())
            keys, first, core = (table.column(c).to_numpy() for c in ("key", "first", "core"))
            order = np.lexsort((keys, first))
            x = _unit(unpacked(table.column("x").chunk(0), kinds[m]))[order]
            keys, first, core = keys[order], first[order], core[order]
            i, j, c = best_in_block(x, k, least, 2 * t + 1)
            i, j, c = i[core[i]], j[core[i]], c[core[i]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), m, np.int32)), pa.array(keys[i]), pa.array(keys[j]), pa.array(first[j]), pa.array(c / 1e9)], names=["m", "a", "b", "first", "similarity"])

    # a partition is a block
    blocks = entries.mapInArrow(place, schema).repartitionById(max(1, sum(cuts.blocks.values())), "g")
    return staged(blocks.mapInArrow(compare, "m int, a bigint, b bigint, first bigint, similarity double"))


def _forest(df: DataFrame, item: str, modalities: tuple, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Items (m, item_id, key) and (m, a, b, similarity): the k best partners b of every entry a in the forest."""
    kinds = [np.float32 if "float" in df.schema[c].dataType.simpleString() else np.float64 for _, c, _ in modalities]
    items, entries = _entries(df, item, modalities, kinds)
    cuts = Cuts(entries, kinds, [d for _, _, d in modalities])
    # one tree after the other, so that only one shuffle of vectors is there at a time
    found = [_found(entries, cuts, t, kinds, k, least) for t in range(cuts.trees)]
    dropped(entries)
    order = Window.partitionBy("m", "a").orderBy(F.col("similarity").desc(), "first")
    near = union_all(*found).distinct().withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)
    return items, near.select("m", "a", "b", "similarity")


def most_similar(df: DataFrame, item: str = "item_id", modalities: tuple = MODALITIES, k: int = 5, least: float = 0.8) -> DataFrame:
    """(modality, item_id, neighbour, similarity, rank): the k most similar other items of every item with a valid vector, of cosine ``least`` or more.

    Equal similarities go to the smaller item. All rows are queries and all are
    indexed. An item that is present several times counts once. Vectors that are
    null, of another length, all zero or hold NaN, infinity or null have no rows; an empty table gives none.
    """
    items, near = _forest(df, item, modalities, k, least)
    smallest = items.withColumn("rk", F.row_number().over(Window.partitionBy("m", "key").orderBy("item_id"))).filter(F.col("rk") <= k + 1)
    smallest = smallest.select("m", F.col("key").alias("b"), F.col("item_id").alias("neighbour"))
    copies = items.select("m", "item_id", F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    others = items.withColumnRenamed("key", "a").join(near, ["m", "a"]).select("m", "item_id", "b", "similarity")
    pairs = union_all(copies, others).join(smallest, ["m", "b"]).filter("item_id <> neighbour")
    order = Window.partitionBy("m", "item_id").orderBy(F.col("similarity").desc(), "neighbour")
    best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = F.element_at(F.array(*[F.lit(name) for name, _, _ in modalities]), F.col("m") + 1)
    return best.select(names.alias("modality"), "item_id", "neighbour", "similarity", "rank")


def similar_pairs(df: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(modality, item_a, item_b): pairs one of which is among the k most similar items of the other; item_a < item_b, distinct."""
    best = most_similar(df, k=k, least=least)
    return best.select("modality", F.least("item_id", "neighbour").alias("item_a"), F.greatest("item_id", "neighbour").alias("item_b")).distinct()
