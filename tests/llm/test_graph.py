"""Components against union-find."""

import random

import pytest

from quern.llm.graph import components, joined_components


def least(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


RANDOM = random.Random(4)
CASES = {
    "none": [], "loop": [(3, 3)], "repeated": [(1, 2), (2, 1), (1, 2)], "star": [(0, i) for i in range(1, 90)], "far star": [(99, i) for i in range(90)],
    "path": [(i, i + 1) for i in range(200)], "random": [(RANDOM.randrange(150), RANDOM.randrange(150)) for _ in range(110)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = [(u, v) for u, v in CASES[name] if u != v]
    assert {r["node"]: r["label"] for r in components(frame(spark, CASES[name])).collect()} == least(edges)


def test_more_links(spark):
    label = components(frame(spark, [(5, 6), (6, 7), (1, 9), (20, 21)]))
    got = joined_components(label, frame(spark, [(7, 9), (30, 21), (40, 41)])).collect()
    assert {r["node"]: r["label"] for r in got} == least([(5, 6), (6, 7), (1, 9), (20, 21), (7, 9), (30, 21), (40, 41)])
