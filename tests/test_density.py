"""Density clusters against every pair of points."""

from __future__ import annotations

import time

import numpy as np
import pytest

from parlance.operators import density


def expected(points, epsilon, min_samples=5, min_size=5):
    """Rows of (id, vector)."""
    ids = [k for k, _ in points]
    v = np.array([x for _, x in points])
    with np.errstate(invalid="ignore"):
        near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= epsilon
    core = near.sum(1) >= min_samples
    label = {i: k for i, k in enumerate(ids) if core[i]}
    moved = True
    while moved:
        moved = False
        for i in label:
            least = min(label[j] for j in np.flatnonzero(near[i]) if j in label)
            if least < label[i]:
                label[i], moved = least, True
    for i in range(len(ids)):
        found = [label[j] for j in np.flatnonzero(near[i]) if core[j]]
        if not core[i] and found:
            label[i] = min(found)
    sizes = {c: list(label.values()).count(c) for c in set(label.values())}
    number = {c: k for k, c in enumerate(sorted(c for c, n in sizes.items() if n >= min_size))}
    return sorted((k, number.get(label.get(i), -1)) for i, k in enumerate(ids))


def found(spark, points, epsilon, **more):
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in points], "id long, v array<double>")
    return sorted((r.id, r.cluster) for r in density.density_clusters(df, "id", "v", epsilon, **more).collect())


@pytest.mark.parametrize(("dims", "spread", "epsilon"), [(2, 3.0, 0.4), (2, 1.0, 0.1), (3, 0.3, 0.5), (1, 2.0, 0.05), (8, 0.2, 0.5)])
def test_clusters_of_random_points(spark, dims, spread, epsilon, monkeypatch):
    draw = np.random.default_rng(dims)
    centres = draw.normal(0, 2, (6, dims))
    points = [(int(k), centres[k % 6] + draw.normal(0, spread, dims)) for k in draw.permutation(400)]
    points += [(1000 + k, points[k % 7][1]) for k in range(60)] + [(2000 + k, points[k][1] + 1e-6 * draw.normal(size=dims)) for k in range(60)]
    points += [(3000, np.full(dims, np.nan)), (3001, np.full(dims, np.inf)), (3002, np.full(dims, 1e12))]
    want = expected(points, epsilon)
    assert len({c for _, c in want}) > 1
    assert found(spark, points, epsilon) == want
    assert found(spark, points, epsilon, min_samples=1, min_cluster_size=2) == expected(points, epsilon, 1, 2)


def test_dense_cells_that_touch_at_their_rims(spark):
    """Two crowds whose first points are too far apart, joined by one pair at the rims; and a third just out of reach."""
    crowd = lambda x, ids: [(k, (x + 0.001 * (k % 10), 0.0)) for k in ids]
    points = crowd(0.0, range(10, 30)) + [(40, (0.69, 0.0))] + crowd(1.67, range(50, 70)) + crowd(3.0, range(80, 100))
    for epsilon in (0.98, 0.9799, 1.0, 1.4):
        assert found(spark, points, epsilon) == expected(points, epsilon)


def test_blocks_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK_ROWS", 40)
    draw = np.random.default_rng(3)
    points = [(k, draw.normal(0, 1, 2)) for k in range(300)]
    assert found(spark, points, 0.25) == expected(points, 0.25)


def test_zero_epsilon_joins_equal_points(spark):
    points = [(k, (float(k % 4), -0.0 if k % 2 else 0.0)) for k in range(30)] + [(50, (9.0, 0.0))]
    assert found(spark, points, 0.0) == expected(points, 0.0)


def test_a_hundred_thousand_equal_vectors(spark):
    df = spark.range(100_000).selectExpr("id", "transform(sequence(1, 16), x -> cast(x as double)) as v").unionAll(spark.range(200_000, 200_400).selectExpr("id", "transform(sequence(1, 16), x -> x + 100 + 1e-4 * (id % 97)) as v"))
    began = time.perf_counter()
    out = density.density_clusters(df, "id", "v", 0.5).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in out} == {0: 100_000, 1: 400} and time.perf_counter() - began < 90
    crowd = density._keyed(df, 0.5).groupBy("key").count()
    assert crowd.count() == 98  # what is compared, written and joined has a row for each different vector


@pytest.mark.parametrize(("shift", "scale", "epsilon"), [(0.0, 1.0, 0.9), (1e6, 1.0, 0.9), (0.0, 1e-30, 0.9e-30), (0.0, 1e25, 0.9e25), (0.0, 1.0, 0.0)])
def test_pairs_by_products_are_those_by_distance(shift, scale, epsilon):
    draw = np.random.default_rng(5)
    x = draw.normal(0, 0.12, (1500, 32)) * scale + shift
    y = np.concatenate((x[:700] + draw.normal(0, 0.05, (700, 32)) * scale, x[700:900], np.full((1, 32), 1e12), x[:1] + np.eye(32)[:1] * epsilon))
    found = np.zeros((len(x), len(y)), bool)
    for i, j in density.near(x, y, epsilon):
        found[i, j] = True
    assert found.any() and (found == (density.distances(x, y) <= epsilon)).all()


def test_points_without_bounds_visit_few_blocks(spark):
    """Unit vectors of many dimensions: no pivot rules a cell out, and yet a point is handed on once for each block, not for each cell."""
    v = np.random.default_rng(6).normal(size=(3000, 64))
    points = spark.createDataFrame([(k, (x / np.linalg.norm(x)).tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    most = density._Space(points, 0.9).placed(points).selectExpr("max(size(visited))").first()[0]
    assert 1 < most <= 4
