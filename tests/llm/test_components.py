"""Components against a search."""

import random

from muxlake.llm.components import components


def test_random_graphs_and_paths(spark):
    rng = random.Random(8)
    edges = [(f"r{rng.randrange(80):03}", f"r{rng.randrange(80):03}") for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    path = [f"p{k:03}" for k in rng.sample(range(200), 60)]
    edges += list(zip(path, path[1:])) + [("hub", f"leaf{k}") for k in range(40)]
    part = {x: x for e in edges for x in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == part


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
