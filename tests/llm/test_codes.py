"""Byte codes of problem 6: what they leave open is settled by the vectors themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import clusters
from quern.llm.vectors import packed


def units(n: int, dim: int, seed: int) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("dim", [1, 64, 96])
def test_codes_bound_cosines(dim):
    x = np.concatenate([units(300, dim, 1), np.eye(dim, dtype=np.float32)[:3], units(5, dim, 2) ** 3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    column = clusters.coded(x)
    assert {len(v.as_py()) for v in column} == {dim + 8}
    y, rest = clusters.decoded(column)
    d, e = x.astype(float), rest[:, None] + rest + rest[:, None] * rest + clusters.ERROR
    assert (np.abs(d @ d.T - y.astype(float) @ y.astype(float).T) <= e).all() and rest.max() < 0.02


@pytest.mark.parametrize("part, least_open", [(6000, 32), (20, 32), (6000, 10**9)])
def test_pairs_that_codes_leave_open(spark, monkeypatch, part, least_open):
    """Pairs within 0.0004 of the least cosine on either side, alone and between clusters; cells get bytes, not vectors."""
    monkeypatch.setattr(clusters, "CELL", part)
    monkeypatch.setattr(clusters, "CELL_MEAN", 5 * part)
    monkeypatch.setattr(clusters, "FEW", least_open)
    sent, spread = [], clusters._spread

    def seen(grouped, rows):
        sent.append(grouped.agg(F.max(F.length("x"))).first()[0])
        return spread(grouped, rows)

    monkeypatch.setattr(clusters, "_spread", seen)
    rng = np.random.default_rng(9)
    x = []
    for k, a in enumerate(units(120, 64, 7).astype(float)):
        b = rng.standard_normal(64)
        b -= (a @ b) * a / (a @ a)
        cos = 0.8 + (k % 9 - 4) * 1e-4 + 2e-5
        near = cos * a + math.sqrt(1 - cos * cos) * b / np.linalg.norm(b)
        x += [a, near] + ([a + 0.01 * rng.standard_normal(64), near + 0.01 * rng.standard_normal(64)] if k % 3 == 0 else [])
    x = np.float32(x)
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = np.round(d @ d.T, 9) >= 0.8
    groups = [frozenset(np.flatnonzero(r).tolist()) for r in s]
    expected = {("text", min(g), i) for i, g in enumerate(groups) if len(g) > 1 and all(groups[j] == g for j in g)}
    df = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(x)], "item_id bigint, image_feat array<float>, text_feat array<float>")
    assert {tuple(r) for r in clusters.found_clusters(df).collect()} == expected and len(expected) > 60
    assert min(sent[:-1]) == max(sent[:-1]) == 64 + 8


def test_groups_that_are_nearly_all_open():
    """A group of equal cosines next to the least one is held as bits and looked through again."""
    import pyarrow as pa

    a = np.eye(64)[:40] + math.sqrt(0.8 / 0.2 / 40) * np.eye(64)[:40].sum(0) / math.sqrt(40) * math.sqrt(40)
    x = (a / np.linalg.norm(a, axis=1)[:, None]).astype(np.float32)
    cos = float((x[0] * x[1]).sum())
    label, across = clusters.linked_labels(pa.table({"x": clusters.coded(x)}), cos)
    assert label.tolist() == list(range(40))
    assert sorted((i, j) for p in across for i, j in zip(*(c.tolist() for c in p))) == [(i, j) for i in range(40) for j in range(i)]
    assert packed(x).nbytes > 2 * clusters.coded(x).nbytes
