"""Operators that have to count what a bound or a join would leave out."""

import datetime
import os

import pytest

from quern import runtime
from quern.operators import losses, prep, propagate, ranking, training
from quern.plans import core


def test_auc_of_the_whole_catalogue(spark):
    """User 1: items 2 to 9, of which 2, 3 have scores and 3, 4 are relevant; user 2 has no scored item."""
    scores = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5)], "u bigint, i bigint, score double")
    rel = spark.createDataFrame([(1, 3), (1, 4), (2, 5)], "u bigint, i bigint")
    history = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "u bigint, i bigint")
    got = dict(ranking.auc_per_user(scores, rel, history, spark.range(10).toDF("i")).collect())
    # positives 3 (above 5 of 6 negatives) and 4 (below one, level with 5)
    assert got == {1: pytest.approx((5 + 2.5) / 12), 2: pytest.approx(0.5)}


def test_users_beyond_a_million_share_no_node(spark, tmp_path):
    """User 1,000,005 isn't item 5."""
    day = datetime.date(2020, 1, 1)
    spark.createDataFrame([(1, 1, day), (2, 1_000_005, day)], "o_orderkey bigint, o_custkey bigint, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(r.i, r.j) for r in core.QUERIES["ui_sym"](spark, str(tmp_path)).collect()}
    first = 1_000_006
    assert edges == {e for u, i in ((1, 5), (1, 6), (1_000_005, 7)) for e in ((u, first + i), (first + i, u))}


def test_negatives_of_long_histories(spark):
    """Users who hold all but one item get that one; a user of the whole catalogue has no row."""
    n = 60
    inter = spark.createDataFrame([(u, i) for u in range(n + 1) for i in range(n) if i != u], "u bigint, i bigint")
    assert {(r.u, r.neg) for r in losses.triplets(inter, n).collect()} == {(u, u) for u in range(n)}
    rows = training.sampled_triplets(inter, n, 3, 1).collect()
    assert len(rows) == 3 * n and all(r.neg == r.u for r in rows)


def test_average_degree_goes_by_the_catalogue(spark, data):
    row = core.QUERIES["graph_stats_all"](spark, data).first()
    assert row.avg_degree == pytest.approx(row.nnz / spark.read.parquet(f"{data}/part.parquet").count(), abs=1e-6)


def test_terciles_of_equal_counts(spark):
    """All items of one frequency, in several range partitions: ranks go on across them."""
    counts = spark.range(999).selectExpr("id as i", "cast(id div 900 as bigint) as n")
    got = {r.i: r.bucket for r in prep.terciles(counts).collect()}
    assert got == {i: "tail" if i < 333 else "mid" if i < 666 else "head" for i in range(999)}


def test_top_items_by_factors_with_ties_and_long_histories(spark):
    users = spark.createDataFrame([(u, [1.0, float(u % 2)]) for u in range(6)], "u bigint, v array<double>")
    items = spark.createDataFrame([(i, [float(i // 3), 0.0]) for i in range(20)], "i bigint, v array<double>")
    history = spark.createDataFrame([(u, i) for u in range(6) for i in range(20) if i % 6 == u or u == 5 and i > 1], "u bigint, i bigint")
    own = {}
    for u, i in history.collect():
        own.setdefault(u, set()).add(i)
    expected = sorted((u, i, rk) for u in range(6) for rk, i in enumerate(sorted((i for i in range(20) if i not in own[u]), key=lambda i: (-(i // 3), i))[:4], 1))
    for block in (3, 8192):
        assert sorted(tuple(r) for r in ranking.factor_top(users, items, history, 4, block=block).collect()) == expected


def test_stages_need_a_shared_folder_on_a_cluster():
    assert runtime._one_process("local[8]") and runtime._one_process("local")
    assert not runtime._one_process("spark://host:7077") and not runtime._one_process("local-cluster[3,2,3000]") and not runtime._one_process("yarn")


def test_folders_of_done_stages_go(spark):
    first = runtime.staged(spark.range(10))
    folder = first.stage_folder.removeprefix("file://")
    assert os.path.isdir(folder)
    assert runtime.staged(first.filter("id > 3"), done=[first]).count() == 6
    assert not os.path.exists(folder)


def test_users_of_a_hub_item_make_no_pairs(spark, tmp_path, monkeypatch):
    """20,000 users of one item, of whom one shares another with a user outside, and one user alone."""
    monkeypatch.setattr(propagate, "SUMMED_AT_ONCE", 9_000)
    n, day = 20_000, datetime.date(2020, 1, 1)
    spark.range(n + 2).selectExpr("id o_orderkey", "id o_custkey", f"date'{day}' o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(n).selectExpr("id l_orderkey", "1L l_partkey").union(spark.createDataFrame([(0, 2), (n, 2), (n + 1, 3), (0, 1)], "a bigint, b bigint"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.node, r.dim): r.x for r in core.QUERIES["user_conv"](spark, str(tmp_path)).collect()}
    e = [[(u * 2654435761 + k * 40503) % 1000 / 1000 - 0.5 for k in range(4)] for u in range(n + 1)]
    total = [sum(v[k] for v in e[:n]) for k in range(4)]
    expected = {(u, k): (total[k] - e[u][k]) / (n - 1) for u in range(1, n) for k in range(4)}
    expected |= {(0, k): (total[k] - e[0][k] + e[n][k]) / n for k in range(4)} | {(n, k): e[0][k] for k in range(4)}
    assert got == pytest.approx(expected, abs=2e-9)


def test_top_items_of_many_cells(spark, monkeypatch):
    """Many cells and pieces give the ranks of all pairs; scores equal in decimals but not in binary are ties."""
    import numpy as np

    monkeypatch.setattr(ranking, "PIECE", 20)
    rng = np.random.default_rng(5)
    x, y = np.round(rng.standard_normal((900, 3)), 1), np.round(rng.standard_normal((3_000, 3)), 1)
    own = {u: set(rng.integers(0, 3_000, 20).tolist()) | ({*range(2_995)} if u == 7 else set()) for u in range(900)}
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], f"{c} bigint, v array<double>") for a, c in ((x, "u"), (y, "i"))]
    history = spark.createDataFrame([(u, i) for u, its in own.items() for i in its], "u bigint, i bigint")
    top = ranking.factor_top(*frames, history, 10, block=30, digits=9)
    expected = []
    exact = np.rint(x * 10).astype(int) @ np.rint(y * 10).astype(int).T
    for u in range(900):
        order = [i for i in np.lexsort((np.arange(3_000), -exact[u])).tolist() if i not in own[u]][:10]
        expected += [(u, i, rk) for rk, i in enumerate(order, 1)]
    assert sorted(tuple(r) for r in top.collect()) == sorted(expected)


def test_training_by_tables_is_that_on_the_driver(spark, monkeypatch):
    """The same losses and embeddings, with first embeddings from several generators."""
    import numpy as np

    monkeypatch.setattr(training, "NODES", 16)
    inter = spark.createDataFrame([(u, (u * 7 + k * k) % 45) for u in range(40) for k in range(1 + u % 9)], "u bigint, i bigint")
    users, items, losses_ = training.train_bpr(inter, 40, 45, dim=3, epochs=3, rate=0.05)
    nodes, got = training.train_mf(inter, 40, 45, dim=3, epochs=3, rate=0.05)
    assert got == pytest.approx(losses_, abs=1e-12)
    assert np.array([r.e for r in nodes.orderBy("node").collect()]) == pytest.approx(np.concatenate([users, items]), abs=1e-9)


def test_top_items_by_unrounded_scores(spark):
    """As in als_topk: the ranks of all pairs, over many cells."""
    import numpy as np

    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((1_500, 2)).astype(np.float32), rng.standard_normal((4_000, 2)).astype(np.float32)
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], f"{c} bigint, v array<double>") for a, c in ((x, "u"), (y, "i"))]
    history = spark.createDataFrame([(u, (u * 37 + k) % 4_000) for u in range(1_500) for k in range(3)], "u bigint, i bigint")
    rows = ranking.factor_top(*frames, history, 5, block=40).collect()
    s = x.astype(float) @ y.astype(float).T
    for u in range(1_500):
        s[u, [(u * 37 + k) % 4_000 for k in range(3)]] = -np.inf
    assert {(r.u, r.i, r.rk) for r in rows} == {(u, i, rk) for u in range(1_500) for rk, i in enumerate(np.argsort(-s[u], kind="stable")[:5].tolist(), 1)}
