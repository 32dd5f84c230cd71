"""Full-catalogue ranking with exclusion of training items, and its metrics.

Ranked lists are (u, i, rk); relevance is (u, i). Users without relevant items
aren't evaluated. Averages run over evaluated users; a user without any
ranked item counts with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import staged, union_all

#: Users whose directions cut the cells of factor_top(), most users of a cell scored by one task, and items that each task finds far out in a cell's direction.
CELL_SAMPLE, PIECE, FAR_OUT = 65_536, 4_096, 8


def neighbour_scores(history: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(u, i, score): sums of weights over the neighbours (i, j, w) of a user's items, the user's own items excluded by an anti-join."""
    summed = history.select("u", F.col("i").alias("seed")).join(neighbours.select(F.col("i").alias("seed"), F.col("j").alias("i"), "w"), "seed").groupBy("u", "i").agg(F.sum("w").alias("score"))
    return summed.join(history.select("u", "i"), ["u", "i"], "left_anti")


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    """(u, i, rk): the k best by score, ties to the smaller item."""
    order = Window.partitionBy("u").orderBy(F.col("score").desc(), "i")
    return scores.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k).select("u", "i", "rk")


class _Cells:
    """Users cut into cells by halving a sample of their directions at the median of the widest direction; each cell's centre is the mean of its sample.

    The sample decides only which users are looked at together.
    """

    def __init__(self, x: np.ndarray, depth: int):
        x = _directions(x)
        self.depth, d = depth, x.shape[1]
        inner = (1 << depth) - 1
        self.along, self.border = np.zeros((inner, d)), np.full(inner, np.inf)
        self.centres = np.zeros((1 << depth, d))
        rows, mean = {0: np.arange(len(x))}, {0: x.sum(0)}
        for node in range(2 * inner + 1):
            at = rows.pop(node)
            # a cell without sample rows has its parent's centre
            centre = mean[node] = x[at].sum(0) if len(at) else mean[(node - 1) // 2]
            if node >= inner:
                self.centres[node - inner] = _directions(centre[None])[0]
                continue
            part = x[at] - x[at].mean(0) if len(at) else x[at]
            axis = np.linalg.eigh(part.T @ part)[1][:, -1]
            side = (x[at] * axis).sum(1)
            if len(at) and np.ptp(side) > 1e-9:
                half = np.median(side)
                self.along[node], self.border[node] = axis, half if half < side.max() - 1e-9 else (side[side < side.max() - 1e-9].max() + side.max()) / 2
            right = side > self.border[node]
            rows[2 * node + 1], rows[2 * node + 2] = at[~right], at[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        x, node = _directions(x), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.along[node]).sum(1) > self.border[node])
        return node - ((1 << self.depth) - 1)


def _directions(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed in the order of the dimensions whatever the number of rows."""
    s = x[:, 0] * y[:, 0]
    for d in range(1, x.shape[1]):
        s = s + x[:, d] * y[:, d]
    return s


def _without(s: np.ndarray, ids: np.ndarray, own: pa.ListArray) -> None:
    """Sets the scores s (rows, ids) of each row's own items to -inf; ids ascend."""
    held = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(ids, held), len(ids) - 1)
    known = ids[at] == held
    s[row[known], at[known]] = -np.inf


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k <= s.shape[1] else np.full(len(s), -np.inf)


def factor_top(users: DataFrame, items: DataFrame, history: DataFrame, k: int, block: int = 512, digits: int | None = None) -> DataFrame:
    """(u, i, rk): top k items by the dot product of vectors, users (u, v) and items (i, v), history excluded; scores are rounded to ``digits`` if given.

    Users of like direction form cells of about ``block``. A user's k-th best score outside the history among some items far out in
    the cell's direction bounds the true one from below; and an item's score for any user of a cell is bounded from above by the item's length and its angle to
    the cell's centre less the cell's widest angle. Only items whose bound reaches the lowest k-th score of a cell are sent there and scored, with every user
    of it; what is left out can't be among any user's best, so the result is that of scoring all pairs. An item is compared with each centre, not with each user.
    """
    vector = F.col("v").cast("array<double>").alias("v")
    own = history.select("u", "i").groupBy("u").agg(F.collect_set("i").alias("own"))
    people = staged(users.select("u", vector).join(own, "u", "left").select("u", "v", F.coalesce("own", F.array().cast("array<bigint>")).alias("own")))
    catalogue = staged(items.select("i", vector))
    n, longest = people.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("own")), F.lit(0))).first()
    sample = _matrix(people.filter(F.pmod(F.xxhash64("u", F.lit(5)), F.lit(max(1, n // CELL_SAMPLE))) == 0).select("u", "v").toArrow().sort_by("u").column("v"))
    cells = _Cells(sample, max(0, min(int(np.ceil(np.log2(max(1, n) / block))), int(np.log2(max(8, len(sample)) / 8)))))
    centres = cells.centres

    # items far out in the direction of some cell
    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, who = np.full((FAR_OUT, len(centres)), -np.inf), np.full((FAR_OUT, len(centres)), -1, np.int64)
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            ids, y = b.column(0).to_numpy(), _matrix(b.column(1))
            for at in range(0, len(ids), 512):
                s = y[at : at + 512] @ centres.T
                i, c = np.nonzero(s > score[-1])
                if not len(i):
                    continue
                some = np.unique(c)
                both = np.concatenate([score[:, some], s[:, some]])
                named = np.concatenate([who[:, some], np.broadcast_to(ids[at : at + 512, None], (len(s), len(some)))])
                order = np.argpartition(-both, FAR_OUT - 1, axis=0)[:FAR_OUT]
                order = np.take_along_axis(order, np.argsort(-np.take_along_axis(both, order, 0), axis=0), 0)
                score[:, some], who[:, some] = np.take_along_axis(both, order, 0), np.take_along_axis(named, order, 0)
                kept |= {int(ids[at + r]): y[at + r] for r in np.unique(i)}
            kept = {r: kept[r] for r in np.unique(who[who >= 0]).tolist() if r in kept} if (who >= 0).all() else kept
        rank, c = np.nonzero(np.isfinite(score) & np.isin(who, np.fromiter(kept, np.int64, len(kept))))
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(score[rank, c]), pa.array(who[rank, c]), _listed(np.stack([kept[w] for w in who[rank, c].tolist()]))], names=["cell", "score", "i", "v"])

    order = Window.partitionBy("cell").orderBy(F.col("score").desc(), "i")
    ahead = catalogue.mapInArrow(far, "cell bigint, score double, i bigint, v array<double>").withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= 8 * FAR_OUT)
    lead = ahead.groupBy("i").agg(F.first("v").alias("v")).toArrow().sort_by("i")
    lead_ids, lead_v = lead.column("i").to_numpy(), _matrix(lead.column("v"))
    most = min(len(lead_ids), max(1_024, k + longest))
    # the rows of lead that each cell tries, in ascending order of the item
    tried = [np.sort(np.argpartition(-(lead_v @ c), most - 1)[:most]) for c in centres] if most else []

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            cell, length = cells.of(x), np.sqrt((x * x).sum(1))
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(cell) else []
            least, near, names = [], [], []
            for rows in np.split(order, starts[1:]) if len(cell) else []:
                c = cell[rows[0]]
                at = np.full(len(rows), -np.inf)
                if most:
                    y = lead_v[tried[c]]
                    s = x[rows] @ y.T
                    _without(s, lead_ids[tried[c]], b.column(2).take(pa.array(rows)))
                    error = (2 * 10.0**-digits if digits is not None else 0) + 1e-12 * length[rows] * np.sqrt((y * y).sum(1).max())
                    with np.errstate(invalid="ignore", divide="ignore"):
                        at = np.where(length[rows] > 0, (_kth(s, k) - error) / length[rows], -np.inf)
                names.append(c)
                least.append(at.min())
                near.append((_directions(x[rows]) @ centres[c]).min())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(r) for r in np.split(order, starts[1:])] if len(cell) else [], pa.int64()), pa.array(least, pa.float64()), pa.array(near, pa.float64())], names=["cell", "n", "least", "near"])

    least, near, pieces = np.full(len(centres), np.inf), np.ones(len(centres)), np.zeros(len(centres), np.int64)
    for r in people.mapInArrow(lowest, "cell bigint, n bigint, least double, near double").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min("near").alias("near")).collect():
        least[r.cell], near[r.cell], pieces[r.cell] = r.least, r.near, -(-r.n // PIECE)
    near = np.clip(near - 1e-9, -1, 1)
    sine, chord = np.sqrt(1 - near * near), np.sqrt(2 - 2 * near)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b.column(1))
            length = np.sqrt((y * y).sum(1))
            # 1e-9 of the length is far above the rounding of the products
            rows = np.flatnonzero(length * (1 + 1e-9) >= least.min())
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                s, m = y[some] @ centres.T, length[some] * (1 + 1e-9)
                i, c = np.nonzero(s + m[:, None] * chord >= least)
                along, m = s[i, c], m[i]
                across = np.sqrt(np.maximum(m * m - along * along, 0))
                keep = np.where(along >= m * near[c], m, along * near[c] + across * sine[c] + 1e-9 * m) >= least[c]
                i, c = i[keep], c[keep]
                copies = pieces[c]
                i, c, piece = np.repeat(i, copies), np.repeat(c, copies), np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                for lo in range(0, len(c), 20_000):
                    part = slice(lo, lo + 20_000)
                    row = some[i[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c[part]), pa.array(piece[part]), b.column(0).take(pa.array(row)), _listed(y[row])], names=["cell", "piece", "i", "v"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cells.of(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(b.column(0).to_numpy() % np.maximum(pieces[cell], 1)), *b.columns], names=["cell", "piece", "u", "v", "own"])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("i")
            us, x, held = left.column("u").to_numpy(), _matrix(left.column("v")), left.column("own").combine_chunks()
            its, y = right.column("i").to_numpy(), _matrix(right.column("v"))
            ahead = np.argpartition(-(y @ _directions(x).mean(0)), 1_023)[:1_024] if len(its) > 1_024 else np.arange(len(its))
            longest = np.sqrt((y * y).sum(1).max())
            step = max(1, (1 << 22) // len(its))
            for at in range(0, len(us), step):
                part = x[at : at + step]
                s = part @ y.T
                _without(s, its, held.slice(at, step))
                error = (2 * 10.0**-digits if digits is not None else 0) + 1e-12 * np.sqrt((part * part).sum(1)) * longest
                i, j = np.nonzero((s >= (_kth(s[:, ahead], k) - error)[:, None]) & (s > -np.inf))
                score = _products(part[i], y[j])
                score = score if digits is None else np.round(score, digits)
                # its is ascending, so a stable order by score leaves ties to the smaller item
                order = np.lexsort((j, -score, i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                top = rank < k
                out.append((us[i[top] + at], its[j[top]], rank[top] + 1))
        u, i, rk = (np.concatenate(c) for c in zip(*out))
        return pa.table({"u": u, "i": i, "rk": pa.array(rk, pa.int32())})

    sent = catalogue.mapInArrow(wanted, "cell bigint, piece bigint, i bigint, v array<double>")
    there = people.mapInArrow(placed, "cell bigint, piece bigint, u bigint, v array<double>, own array<bigint>")
    return there.groupBy("cell", "piece").cogroup(sent.groupBy("cell", "piece")).applyInArrow(best, "u bigint, i bigint, rk int")


def hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(u, rk, hit): hit is 1 where the ranked item is relevant to the user."""
    r = relevant.select("u", "i").distinct().withColumn("hit", F.lit(1))
    return ranked.join(r, ["u", "i"], "left").select("u", "rk", F.coalesce("hit", F.lit(0)).alias("hit"))


def _gain(rank: Column) -> Column:
    return 1 / F.log2(rank.cast("double") + 1)


def ideal_gains(spark, k: int) -> DataFrame:
    """(m, ideal): DCG of m hits at the first m ranks, m = 0..k."""
    total, rows = 0.0, [(0, 0.0)]
    for r in range(1, k + 1):
        total += 1.0 / float(np.log2(r + 1))
        rows.append((r, total))
    return spark.createDataFrame(rows, "m int, ideal double")


def metrics_at(ranked: DataFrame, relevant: DataFrame, ks: list[int], ideal: str = "prefix") -> DataFrame:
    """(k, users, precision, recall, ndcg, hit), averages over users with relevant items.

    ``ideal``: 'prefix' takes the ideal ordering of the first k positions, 'kmax'
    that of all positions ranked (the largest of ``ks``), cut at k.
    """
    spark, k_max = ranked.sparkSession, max(ks)
    n_pos = relevant.select("u", "i").distinct().groupBy("u").agg(F.count(F.lit(1)).alias("n_pos"))
    h = hits(ranked.filter(F.col("rk") <= k_max), relevant)
    aggs = [F.sum("hit").alias("h_all")]
    for k in ks:
        inside = F.when(F.col("rk") <= k, F.col("hit")).otherwise(0)
        aggs += [F.sum(inside).alias(f"h{k}"), F.sum(inside * _gain(F.col("rk"))).alias(f"g{k}")]
    per = n_pos.join(h.groupBy("u").agg(*aggs), "u", "left").fillna(0)
    lines = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h"), F.col(f"g{k}").cast("double").alias("g")) for k in ks])).alias("x")
    long = per.select("u", "n_pos", "h_all", lines).select("u", "n_pos", "h_all", "x.*")
    m = (F.col("h") if ideal == "prefix" else F.least(F.col("k"), F.col("h_all"))).cast("int")
    long = long.withColumn("m", m).join(F.broadcast(ideal_gains(spark, k_max)), "m")
    return long.groupBy("k").agg(
        F.count(F.lit(1)).alias("users"), F.avg(F.col("h") / F.col("k")).alias("precision"), F.avg(F.col("h") / F.col("n_pos")).alias("recall"),
        F.avg(F.when(F.col("ideal") > 0, F.col("g") / F.col("ideal")).otherwise(0.0)).alias("ndcg"), F.avg((F.col("h") > 0).cast("double")).alias("hit"),
    )


def bucket_recall(ranked: DataFrame, relevant: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(bucket, users, recall): recall@k on relevant items of each popularity bucket; users without any there are left out."""
    rel = relevant.select("u", "i").distinct().join(buckets, "i")
    top = ranked.filter(F.col("rk") <= k).select("u", "i").withColumn("hit", F.lit(1))
    per = rel.join(top, ["u", "i"], "left").groupBy("bucket", "u").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return per.groupBy("bucket").agg(F.count(F.lit(1)).alias("users"), F.avg("recall").alias("recall"))


def geometric_mean(head: Column, mid: Column, tail: Column) -> Column:
    """Cube root of the product; 0 unless all three are numbers above 0."""
    ok = F.coalesce((head > 0) & (mid > 0) & (tail > 0) & ~F.isnan(head) & ~F.isnan(mid) & ~F.isnan(tail), F.lit(False))
    return F.when(ok, F.pow(head * mid * tail, F.lit(1 / 3))).otherwise(F.lit(0.0))


def auc_per_user(scores: DataFrame, relevant: DataFrame, history: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(u, auc): rank-sum AUC of each user's scored items, ties by average rank; 0 without both classes.

    With ``history`` (u, i) and the catalogue ``items`` (i) it is that of all items outside the history, those
    without a score having score 0, for all users with scores or relevant items.
    """
    r = relevant.select("u", "i").distinct().withColumn("y", F.lit(1))
    labelled = scores.join(r, ["u", "i"], "left").select("u", "score", F.coalesce("y", F.lit(0)).alias("y"))
    # equal scores are counted together, so ranks need one row per user and score
    levels = labelled.groupBy("u", "score").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("p"))
    if history is not None and items is not None:
        ids = items.select("i").distinct()
        own = history.select("u", "i").distinct()
        held = own.join(ids, "i").groupBy("u").agg(F.count(F.lit(1)).alias("h"))
        positives = r.join(ids, "i").join(own, ["u", "i"], "left_anti").groupBy("u").agg(F.count(F.lit(1)).alias("all_p"))
        seen = levels.groupBy("u").agg(F.sum("c").alias("sc"), F.sum("p").alias("sp"))
        users = union_all(scores.select("u"), relevant.select("u")).distinct()
        counts = users.join(held, "u", "left").join(positives, "u", "left").join(seen, "u", "left").fillna(0).crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n_items"))))
        # the items without a score are one more level
        rest = counts.select("u", F.lit(0.0).alias("score"), (F.col("n_items") - F.col("h") - F.col("sc")).alias("c"), (F.col("all_p") - F.col("sp")).alias("p"))
        levels = union_all(levels.withColumn("score", F.col("score").cast("double")), rest.filter("c > 0")).groupBy("u", "score").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    w = Window.partitionBy("u").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = levels.withColumn("mean_rank", F.sum("c").over(w) - (F.col("c") - 1) / 2)
    s = ranked.groupBy("u").agg(F.sum(F.col("mean_rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("c").alias("n"))
    q = F.col("n") - F.col("p")
    return s.select("u", F.when((F.col("p") > 0) & (q > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q)).otherwise(F.lit(0.0)).alias("auc"))
