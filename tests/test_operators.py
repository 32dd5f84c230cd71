"""Operators on hand-made tables with known results."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.operators import features, graph, harness, losses, prep, propagate, ranking, similarity, skew
from quern.sources import readers, sinks
from quern.streaming import ema


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_prior_of_the_tiny_split(spark):
    edges = frame(spark, [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 3), (2, 0)], "u bigint, i bigint")
    counts = prep.item_counts(edges, prep.catalogue(5, spark))
    assert got(counts) == [(0, 3), (1, 2), (2, 1), (3, 1), (4, 0)]
    q = {r.i: math.exp(r.log_q) for r in prep.log_prior(counts, 1.0, "laplace").collect()}
    assert [round(q[i] * 12) for i in range(5)] == [4, 3, 2, 2, 1]
    assert abs(sum(q.values()) - 1) < 1e-12
    with pytest.raises(Exception, match="raw mode"):
        prep.log_prior(counts, 1.0, "raw").collect()
    assert prep.out_of_range(edges, 3).count() == 1


def test_terciles_and_gini(spark):
    counts = frame(spark, [(i, i) for i in range(2000)], "i bigint, n bigint")
    sizes = {r.bucket: r["count"] for r in prep.terciles(counts).groupBy("bucket").count().collect()}
    assert sizes == {"tail": 666, "mid": 667, "head": 667}
    for values, expected in (([0, 0, 0, 4], 0.75), ([1, 1, 1, 1], 0.0), ([0, 0], 0.0), ([], 0.0)):
        c = frame(spark, [(i, v) for i, v in enumerate(values)], "i bigint, n bigint")
        assert prep.gini(c).first().gini == pytest.approx(expected)


def test_hash_category(spark):
    assert spark.range(1).select(prep.hashed_category(F.lit(23032), 10).alias("c")).first().c == 2


def test_k_core_is_one_pass(spark):
    rows = [(1, 1), (1, 2), (2, 1), (3, 2)]
    split = frame(spark, [(u, i, "train") for u, i in rows] + [(1, 2, "test"), (2, 1, "test")], "u bigint, i bigint, split string")
    # both items have two rows; users 2 and 3 go, after which the items would have one
    assert got(prep.k_core(split, 2)) == [(1, 1, "train"), (1, 2, "test"), (1, 2, "train")]


def test_ids_in_any_notation(spark):
    texts = ["12", " 12 ", "12.0", "1.2e1", "x", None, "nan", "inf", "-3.9"]
    log = frame(spark, [(t, "1", "0") for t in texts] + [("5", "6", "7")], "userID string, itemID string, x_label string")
    assert got(readers.labelled_log(log)) == [(-3, 1, "train")] + [(12, 1, "train")] * 4


def test_repeated_pairs_count_once(spark):
    rows = frame(spark, [(0, 1), (0, 2), (0, 2), (1, 1), (1, 2)], "u bigint, i bigint")
    assert got(graph.co_counts(rows, "u", "i")) == [(1, 2, 2), (2, 1, 2)]


def test_ties_and_negative_weights(spark):
    e = frame(spark, [(0, 7, 2), (0, 3, 2), (0, 9, 5)], "i bigint, j bigint, w bigint")
    assert [r.j for r in graph.top_per_row(e, 2).orderBy("rk").collect()] == [9, 3]
    neg = frame(spark, [(0, 1, -0.3)], "i bigint, j bigint, w double")
    assert {r.w for r in graph.symmetric_max(neg).collect()} == {0.0}


def brute_tree(g, anchor, hops):
    order = lambda i: sorted(g.get(i, {}).items(), key=lambda p: (-p[1], p[0]))
    level, seen, out = order(anchor), {anchor} | set(g.get(anchor, {})), []
    out += [(anchor, j, 1, w) for j, w in level]
    for o in range(2, hops + 1):
        new = {}
        for p, _ in level:
            for j, w in order(p):
                if j not in seen and j not in new:
                    new[j] = w
        seen |= set(new)
        level = sorted(new.items(), key=lambda p: (-p[1], p[0]))[: max(1, len(level) // ((o - 1) * 2))]
        out += [(anchor, j, o, w) for j, w in level]
    return out


def test_tree_against_brute_force(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(220)}
    rows = [(i, j, float(rng.randrange(1, 6))) for i, j in edges if i != j]
    g = {}
    for i, j, w in rows:
        g.setdefault(i, {})[j] = w
    expected = sorted(x for a in g for x in brute_tree(g, a, 3))
    assert got(graph.interest_tree(frame(spark, rows, "i bigint, j bigint, w double"), 3)) == expected


def test_neighbours_over_several_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (60, 5)).astype(float)
    x[7] = 0
    v = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "i bigint, v array<double>")
    n = np.sqrt((x * x).sum(1))
    y = x / np.where(n == 0, 1, n)[:, None]
    s = np.round(y @ y.T, 9)
    np.fill_diagonal(s, -9)
    expected = sorted((i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), -s[i]))[:4])
    assert sorted((r.i, r.j) for r in similarity.cosine_neighbours(v, 4, block=16).collect()) == expected


def test_ndcg_variants(spark):
    ranked = frame(spark, [(1, i, i) for i in range(1, 21)], "u bigint, i bigint, rk int")
    rel = frame(spark, [(1, 1), (1, 15), (2, 9)], "u bigint, i bigint")
    one = ranked, rel.filter("u = 1")
    at = {r.k: r for r in ranking.metrics_at(*one, [10, 20], "prefix").collect()}
    assert at[10].ndcg == pytest.approx(1.0) and at[20].ndcg == pytest.approx(0.766434, abs=1e-6)
    at = {r.k: r for r in ranking.metrics_at(*one, [10, 20], "kmax").collect()}
    assert at[10].ndcg == pytest.approx(0.613147, abs=1e-6)
    # user 2 has relevant items but no ranking: it counts with zeros
    assert ranking.metrics_at(ranked, rel, [20]).first().recall == pytest.approx(0.5)


def test_geometric_mean(spark):
    rows = frame(spark, [(0.08, 0.04, 0.01), (0.0, 1.0, 1.0), (float("nan"), 1.0, 1.0), (None, 1.0, 1.0)], "h double, m double, t double")
    values = [r.g for r in rows.select(ranking.geometric_mean(F.col("h"), F.col("m"), F.col("t")).alias("g")).collect()]
    assert values[0] == pytest.approx(0.031748, abs=1e-6) and values[1:] == [0.0, 0.0, 0.0]


def test_training_items_are_never_ranked(spark):
    rng = np.random.default_rng(1)
    users = frame(spark, [(u, rng.standard_normal(4).tolist()) for u in range(9)], "u bigint, v array<double>")
    its = frame(spark, [(i, rng.standard_normal(4).tolist()) for i in range(15)], "i bigint, v array<double>")
    history = frame(spark, [(u, i) for u in range(9) for i in range(u)], "u bigint, i bigint")
    top = ranking.factor_top(users, its, history, 5, block=4)
    seen = {(r.u, r.i) for r in history.collect()}
    rows = top.collect()
    assert len(rows) == 45 and not seen & {(r.u, r.i) for r in rows}


def test_auc(spark):
    scores = frame(spark, [(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.1), (2, 1, 0.3)], "u bigint, i bigint, score double")
    rel = frame(spark, [(1, 1), (1, 2)], "u bigint, i bigint")
    assert got(ranking.auc_per_user(scores, rel)) == [(1, 0.875), (2, 0.0)]


def test_single_item_users_have_full_softmax(spark):
    inter = frame(spark, [(1, 1)], "u bigint, i bigint")
    v = frame(spark, [(1, [0.3, -0.2])], "i bigint, v array<double>")
    r = propagate.edge_weights(inter, v, v, [1.0, 1.0]).first()
    assert r.iav == pytest.approx(1.0) and r.w == pytest.approx(1.0)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    x = rng.laplace(size=(800, 3)) @ rng.standard_normal((3, 3))
    f = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "i bigint, v array<double>")
    _, _, cov = features.moments(features.zca(f))
    assert np.allclose(cov, np.eye(3), atol=1e-2)
    z = np.stack([r.v for r in features.pca_ica(f).orderBy("i").collect()])
    assert np.allclose(np.cov(z.T), np.eye(3), atol=1e-2)


def test_median_is_the_lower_one(spark):
    z = frame(spark, [(i, 0, float(i), 0.0) for i in range(1, 5)], "i bigint, k int, re double, im double")
    assert features.deviation(z).first().med == 2.0


def test_noise_is_the_identity_without_eps(spark):
    f = frame(spark, [(1, [1.0, -2.0])], "i bigint, v array<double>")
    assert features.noisy(f, 0.0, 1) is f
    a, b = features.noisy(f, 0.2, 1).first().v, features.noisy(f, 0.2, 1).first().v
    assert a == b and a[0] >= 1 and a[1] <= -2 and math.dist(a, [1, -2]) == pytest.approx(0.2)
    with pytest.raises(ValueError):
        features.noisy(f, -1.0, 1)


def test_key_quantiles_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(1, rng.randrange(-(10**9), 10**9)) for _ in range(3000)] + [(2, 7)] * 50 + [(3, v) for v in (5, 1, 9)] + [(None, 1), (4, None)]
    df = frame(spark, rows, "k bigint, v bigint")
    have = {(r.k, r.fraction): r.quantile for r in skew.key_quantiles(df, "k", "v", [0.0, 0.25, 0.5, 1.0], bits=5).collect()}
    for k in (1, 2, 3):
        v = sorted(x for key, x in rows if key == k)
        for q in (0.0, 0.25, 0.5, 1.0):
            assert have[k, q] == v[max(1, math.ceil(q * len(v))) - 1]
    assert len(have) == 12
    empty = skew.key_quantiles(df.filter("false"), "k", "v", [0.5])
    assert empty.count() == 0 and empty.columns == ["k", "fraction", "n", "quantile"]


def test_shares_take_a_key_once(spark):
    rows = [(1, [5, 5, 6, None]), (1, [6, 5, None, 5]), (2, [5]), (3, []), (4, None), (None, [9])]
    df = frame(spark, rows, "user_id bigint, train_items array<bigint>").withColumn("item_id", F.lit(1)).withColumn("n", F.lit(1))
    r = {x.item_id: (x.n_elements, x.n_keys, x.share, x.quantiles) for x in skew.item_profiles(df, "user_id", "train_items").collect()}
    assert r == {5: (3, 2, 0.75, [1, 2]), 6: (1, 1, 0.25, [1, 1])}
    assert got(skew.heavy_items(df, "user_id", "train_items", 25)) == [(5,), (6,)]
    assert got(skew.heavy_items(df, "user_id", "train_items", 26)) == [(5,)]
    assert skew.heavy_items(df.filter("false"), "user_id", "train_items", 2).count() == 0


def test_salted_join(spark):
    a = frame(spark, [(1, i) for i in range(100)] + [(2, -1)], "k bigint, x bigint")
    b = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "k bigint, y string")
    assert got(skew.salted_join(a, b, "k", [1], 4)) == got(a.join(b, "k"))


def test_files(spark, tmp_path):
    d = tmp_path / "shop" / "5-core"
    d.mkdir(parents=True)
    (d / "train.json").write_text('{"0": [1, 2, 2], "1": [], "7": [3]}')
    (d / "train.txt").write_text("0 1 2\n5\n\n1\t4 x\n")
    path = readers.train_file(str(tmp_path), "shop")
    assert path.endswith("train.json")
    assert got(readers.interactions_file(spark, path)) == [(0, 1), (0, 2), (0, 2), (7, 3)]
    assert got(readers.interactions_file(spark, str(d / "train.txt"))) == [(0, 1), (0, 2), (1, 4)]
    np.save(tmp_path / "image_feat.npy", np.arange(10.0).reshape(5, 2))
    m = readers.matrix_rows(spark, str(tmp_path / "image_feat.npy"), 2)
    assert got(m)[4] == (4, [8.0, 9.0]) and readers.matrix_rows(spark, str(tmp_path / "no.npy")) is None
    (tmp_path / "seeds.csv").write_text("tag,Recall@20\na,0.5\nb,\nc,0.25\n")
    assert [r.value for r in readers.csv_column(spark, str(tmp_path / "seeds.csv"), "recall@20").orderBy("seed").collect()] == [0.5, 0.25]
    with pytest.raises(KeyError):
        readers.csv_column(spark, str(tmp_path / "seeds.csv"), "other")


def test_caches(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return frame(spark, [(1, 2)], "a bigint, b bigint")

    path = str(tmp_path / sinks.cache_name("laplace", 1.0))
    assert path.endswith("log_q_laplace_b1p0")
    for key in ("x", "x", "y"):
        assert got(sinks.cached(path, build, key, spark)) == [(1, 2)]
    assert len(built) == 2
    a, b = frame(spark, [(1, 2), (3, 4)], "a bigint, b bigint"), frame(spark, [(3, 4), (1, 2)], "a bigint, b bigint")
    assert sinks.fingerprint(a) == sinks.fingerprint(b) and sinks.table_md5(a) == sinks.table_md5(b)
    assert sinks.fingerprint(a) != sinks.fingerprint(a.limit(1)) and sinks.table_md5(a) != sinks.table_md5(a.limit(1))
    sinks.write_interest_cache(str(tmp_path / "ic"), a, b, {"k": 2})
    co, tree, meta = sinks.read_interest_cache(spark, str(tmp_path / "ic"))
    assert got(co) == got(tree) and meta == {"k": 2}
    split = frame(spark, [(1, 2, "train"), (1, 3, "test")], "u bigint, i bigint, split string")
    sinks.write_splits(split, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).count() == 2
    sinks.append_results(a, str(tmp_path / "runs"))
    sinks.append_results(b, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 4


def test_statistics(spark):
    pairs = frame(spark, [(0.5, 0.4), (0.6, 0.45), (0.55, 0.5), (0.52, 0.41)], "a double, b double")
    t = harness.paired_test(pairs, "a", "b", comparisons=3)
    assert t.n == 4 and t.p_corrected == pytest.approx(3 * t.p) and t.low < t.mean_diff < t.high and t.p < 0.05
    with pytest.raises(ValueError):
        harness.paired_test(pairs.limit(1), "a", "b")
    one = harness.seed_summary(frame(spark, [("x", 1.0)], "tag string, m double"), ["tag"], ["m"]).first()
    assert one.m_std == 0.0
    assert harness.parsed_monitor("val_recall@20", [10, 20]) == ("recall", 20)
    with pytest.raises(ValueError):
        harness.parsed_monitor("val_loss", [20])
    log = frame(spark, [("r", e, m) for e, m in enumerate([0.1, 0.3, 0.2, 0.3, 0.25, 0.1])], "run string, epoch int, m double")
    assert got(harness.stopping_epoch(log, "m", 3)) == [("r", 4)]
    assert harness.best_epochs(log, "m", "epoch").first().epoch == 1
    assert harness.grid({"k": [1, 2], "d": [8]}, [0, 1], spark).count() == 8
    assert "±" in harness.markdown(harness.seed_summary(frame(spark, [("x", 0.1)], "tag string, m double"), ["tag"], ["m"]), "tag", ["m"])


def test_patterns(spark):
    p = frame(spark, [("3\t7\t", "35 : 1.0"), ("1 2 3", "4 : 1"), ("5,5", "9 : 1"), ("x y", "1 : 1")], "pattern string, support string")
    assert got(graph.parsed_patterns(p)) == [(3, 7, 35, 1.0)]
    assert graph.absolute_support(0.1, 50) == 5 and graph.absolute_support(7, 50) == 7
    with pytest.raises(ValueError):
        graph.absolute_support(0, 5)


def test_gates(spark):
    for form in ("raw", "sigmoid", "tanh_signed", "tanh01"):
        theta = A.gate_start(0.1, form)
        assert spark.range(1).select(A.gate(F.lit(theta), form).alias("g")).first().g == pytest.approx(0.1)


def test_identical_views(spark):
    z = frame(spark, [(i, np.eye(8)[i].tolist()) for i in range(8)], "i bigint, v array<double>")
    expected = math.log(1 + 7 * math.exp(-5))
    assert losses.infonce(z, z, 0.2, 8).first().loss == pytest.approx(expected)
    assert losses.infonce_all(z, z, 0.2, block=3).first().loss == pytest.approx(expected)
    assert losses.infonce(z, z, 0.2, 8, reflexive=True).first().loss == pytest.approx(math.log(1 + 14 * math.exp(-5)))


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [(k, e, float(k * 10 + e * e % 7)) for k in (1, 2) for e in range(8)]
    frame(spark, rows, "key bigint, epoch int, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key bigint, epoch int, x double").parquet(str(tmp_path / "in"))
    q = ema.running_averages(stream, 5).writeStream.outputMode("update").format("memory").queryName("averages").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    have = {r.key: r.ema for r in spark.table("averages").collect()}
    batch = {r.key: r.ema for r in losses.running_state(frame(spark, rows, "key bigint, epoch int, x double"), 5).filter("epoch = 7").collect()}
    assert have == pytest.approx(batch)


def test_training_lowers_the_loss(spark):
    from quern.operators.training import als, train_bpr

    rng = random.Random(2)
    rows = list({(u, (u % 3) * 10 + rng.randrange(10)) for u in range(30) for _ in range(6)})
    inter = frame(spark, rows, "u bigint, i bigint")
    for layers in (0, 1):
        _, _, losses_ = train_bpr(inter, 30, 30, dim=4, layers=layers, epochs=6, rate=0.05)
        assert losses_[-1] < losses_[0]
    assert als(inter, 4).itemFactors.count() > 0


def test_library_works_without_the_training_data_package():
    folder = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "quern")
    for base, _, files in os.walk(folder):
        if os.path.basename(base) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "quern.llm" not in open(os.path.join(base, f), encoding="utf-8").read(), f
