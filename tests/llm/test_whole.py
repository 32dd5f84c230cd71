"""Results that have to be whole where a bound on candidates would lose some."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.llm import clusters, neighbours


def test_clusters_of_many_cells(spark, tmp_path):
    """Pairs just above the least similarity, so many that they don't all share a neighbourhood."""
    rng = np.random.default_rng(3)
    n = 10_000
    a, b = rng.standard_normal((2, n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b *= (np.tan(np.arccos(0.82)) / np.linalg.norm(b, axis=1))[:, None]
    x = np.concatenate([a, a + b]).astype(np.float32)
    text = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n * 64 + 1, 64, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"item_id": np.arange(2 * n), "image_feat": pa.nulls(2 * n, pa.list_(pa.float32())), "text_feat": text}), f"{tmp_path}/items.parquet")
    found = {(r.cluster_id, r.item_id) for r in clusters.found_clusters(spark.read.parquet(f"{tmp_path}/items.parquet")).collect()}
    assert found == {(i, j) for i in range(n) for j in (i, n + i)}


@pytest.mark.parametrize("block", [65_536, 25])
def test_neighbours_of_rescaled_copies(spark, monkeypatch, block):
    """Vectors of one direction and many lengths aren't equal bit by bit, but their cosines are all 1."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0.1, 30, 60)[:, None] * rng.standard_normal(64), rng.standard_normal((30, 64)), rng.standard_normal(64) + 0.3 * rng.standard_normal((20, 64))]).astype(np.float32)
    ids = rng.permutation(1000)[: len(x)].tolist()
    d = x.astype(float)
    s = np.round(d @ d.T / np.sqrt((d * d).sum(1)[:, None] * (d * d).sum(1)), 9)
    expected = set()
    for i, a in enumerate(ids):
        best = sorted((-s[i, j], b) for j, b in enumerate(ids) if j != i and s[i, j] >= 0.8)[:5]
        expected |= {("text", min(a, b), max(a, b)) for _, b in best}
    df = spark.createDataFrame([(i, None, v.tolist()) for i, v in zip(ids, x)], "item_id bigint, image_feat array<float>, text_feat array<float>")
    assert {tuple(r) for r in neighbours.similar_pairs(df).collect()} == expected
