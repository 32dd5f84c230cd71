"""Problem 6: a cell's pairs are looked at once, rounds share their passes, and sums take no Python call for each key."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import clusters
from quern.llm.vectors import packed


def units(n: int, dim: int, seed: int, copies: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((n, dim)), copies, axis=0)
    x += 0.3 * rng.standard_normal(x.shape)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("chunk", [7, 256])
def test_pairs_of_a_group_are_looked_at_once(monkeypatch, chunk):
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    x = units(60, 64, 1, copies=5)
    s = x.astype(float) @ x.T.astype(float)
    seen = Counter((i, j) for _, _, i, j, *_ in clusters._near(clusters.coded(x), 0.8) for i, j in zip(i.tolist(), j.tolist()))
    assert set(seen.values()) == {1} and all(i < j for i, j in seen)
    assert {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.8, 1)))} <= set(seen)


@pytest.mark.parametrize("few", [1, 32, 10**9])
def test_labels_of_chains(monkeypatch, few):
    """Chains whose links run backwards and forwards through the chunks, held as pairs and as bits."""
    monkeypatch.setattr(clusters, "CHUNK", 4)
    monkeypatch.setattr(clusters, "FEW", few)
    angle = np.arange(30) * 0.5
    order = np.random.default_rng(5).permutation(30)
    x = np.zeros((40, 64), np.float32)
    x[:30, 0], x[:30, 1] = np.cos(angle)[order], np.sin(angle)[order]
    x[30:, 2:12] = np.eye(10)
    label, across = clusters.linked_labels(pa.table({"x": clusters.coded(x)}), 0.8)
    assert label.tolist() == [0] * 30 + list(range(30, 40)) and not list(across)


def test_groups_that_share_a_hash():
    """Rows of equal g come in any order; two groups of one g, of vectors of two lengths, stay apart."""
    m, cell, part, item = (np.array(v) for v in zip(*[(i % 2, 5 + i % 3, i % 4 // 2, 100 - i) for i in range(50)]))
    x = pa.array([packed(np.full((1, 3 + k), i, np.float32))[0].as_py() for i, k in zip(item, m)], pa.binary())
    g = np.where(np.arange(50) < 40, 7, 8)
    t = pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(g), pa.array(cell), pa.array(part), pa.array(item), x], names=["m", "g", "cell", "part", "item_id", "x"])
    expected = {}
    for row in zip(g.tolist(), m.tolist(), cell.tolist(), part.tolist(), item.tolist()):
        expected.setdefault(row[:4], []).append(row[4])
    found = {}
    for some in clusters._groups(iter([t.slice(0, 11), t.slice(11)])):
        keys = {tuple(r) for r in zip(*(some.column(c).to_pylist() for c in ("g", "m", "cell", "part")))}
        assert len(keys) == 1 and not keys & set(found)
        ids = some.column("item_id").to_pylist()
        found[keys.pop()] = ids
        assert [v[0] for v in np.frombuffer(b"".join(some.column("x").to_pylist()), np.float32).reshape(len(ids), -1)] == ids
    assert found == {k: sorted(v) for k, v in expected.items()}


def test_sums_of_keys_over_many_batches(spark):
    rows = [(m, key, float(i), np.array([i, 1.0, key] + [0.5] * m).tobytes()) for m in range(2) for key in (-4, 0, 3, 9) for i in range(1 + 11 * (key + 4))]
    df = spark.createDataFrame(rows, clusters._SUMS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        summed = clusters._summed_by_key(df)
        got = sorted((r.m, r.key, r.number, np.frombuffer(bytes(r.v)).tolist()) for r in summed.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = []
    for m in range(2):
        for key in (-4, 0, 3, 9):
            n = 1 + 11 * (key + 4)
            expected.append((m, key, n * (n - 1) / 2, [n * (n - 1) / 2, n, n * key] + [0.5 * n] * m))
    assert got == expected
    assert "FlatMapGroupsInArrow" not in summed._jdf.queryExecution().toString()


@pytest.mark.parametrize("most, passes", [(8, 2), (0, 5)])
def test_rounds_share_passes(spark, monkeypatch, most, passes):
    """Five rounds are compared in two passes, or one by one where cells have more rows; a cluster's rows don't depend on it."""
    monkeypatch.setattr(clusters, "CELL_MEAN", 40)
    monkeypatch.setattr(clusters, "TOGETHER", most, raising=False)
    sent, spread = [], clusters._spread

    def counted(grouped, rows):
        sent.append(rows)
        return spread(grouped, rows)

    monkeypatch.setattr(clusters, "_spread", counted)
    monkeypatch.setattr(clusters, "FIRST_ROUNDS", 5)
    x = units(80, 64, 3, copies=3)
    near = x.astype(float) @ x.T.astype(float) >= 0.8
    groups = [frozenset(np.flatnonzero(r).tolist()) for r in near]
    expected = {("text", min(g), i) for i, g in enumerate(groups) if len(g) > 1 and all(groups[j] == g for j in g)}
    df = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(x)], "item_id bigint, image_feat array<float>, text_feat array<float>")
    assert {tuple(r) for r in clusters.found_clusters(df).collect()} == expected and len(expected) > 100
    # one more for the check of whole components; further looks make two passes or one each
    assert len(sent) >= passes + 1 and sum(sent[:passes]) == 5 * 2 * len(x)
