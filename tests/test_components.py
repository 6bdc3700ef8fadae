"""Connected components on graphs whose least label has far to go."""

import random

import pytest

from threadloom.plans.components import connected_components


def shuffled(n, seed):
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    return ids


@pytest.mark.parametrize("path", [[0, *range(100, 0, -1)], [*range(100, 0, -2), 0, *range(1, 100, 2)], shuffled(1000, 5)], ids=["falling", "v", "shuffled"])
def test_long_paths_are_one_component(spark, path):
    edges = spark.createDataFrame([*zip(path, path[1:], strict=False), (5000, 5001), (5001, 5002)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in path} | {5000: 5000, 5001: 5000, 5002: 5000}


def test_random_graphs_equal_union_find(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(330)]
    up = list(range(600))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for e in pairs for i in e}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
