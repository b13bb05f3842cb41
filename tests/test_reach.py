"""Interval labels against the closure by brute force."""

import random

import pytest

from estatelens import queries
from estatelens.operators import reach


def brute(edges):
    out, new = set(edges), set(edges)
    while new:
        new = {(a, d) for a, b in new for c, d in edges if b == c} - out
        out |= new
    return out


GRAPHS = {
    "tree": [(n // 3, n) for n in range(1, 30)],
    "dag": [(a, b) for a in range(16) for b in range(a + 1, 16) if random.Random(a * 99 + b).random() < 0.2],
    "any": [(a, b) for a in range(14) for b in range(14) if random.Random(a * 77 + b).random() < 0.09],
    "star": [(0, n) for n in range(1, 25)] + [(30, n) for n in range(5, 25)] + [(24, 31), (31, 32)],
    "loops": [(1, 1), (1, 2), (2, 3), (3, 2), (3, 4), (5, 4)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_labels_say_what_the_closure_says(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame([*edges, *edges[:2], (None, 1), (2, None)], "src int, dst int")
    labels, want = reach.reach_labels(df), brute(set(edges))
    nodes = spark.createDataFrame([(n,) for n in [*range(40), 7, None]], "node int")
    assert sorted(map(tuple, labels.below(nodes).collect())) == sorted(want)
    pairs = spark.createDataFrame([(a, b, "x") for a in range(34) for b in range(34)] + [(None, 1, "x")], "src int, dst int, more string")
    assert sorted(map(tuple, labels.reaches(pairs).collect())) == sorted((a, b, "x") for a, b in want)
    if name == "tree":
        assert labels.intervals.count() == 30


def test_a_forest_needs_no_search_for_cycles(spark, monkeypatch):
    """No trimming or colouring where the levels take in all nodes, and no pairs of edges beside the forest."""
    monkeypatch.setattr(reach.graph, "strong_components", lambda edges: pytest.fail("searched for cycles"))
    labels = reach.reach_labels(spark.createDataFrame(GRAPHS["tree"], "src int, dst int"))
    assert labels.acyclic and labels.intervals.count() == 30


def test_descendants_of_one_node_build_no_labels(spark, monkeypatch):
    monkeypatch.setattr(reach, "reach_labels", lambda edges: pytest.fail("labels of all nodes"))
    found = [r.node for r in queries.descendants(spark, "/root/testdata/sf0.001").collect()]
    assert len(found) == len(set(found)) > 30 and "r:1" not in found
