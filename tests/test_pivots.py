"""Betweenness of a graph that a task can hold: no state per pivot and node leaves a task."""
import random
from collections import defaultdict, deque

import numpy as np
import pytest

from ledgerlens.operators import graph as G
from ledgerlens.operators import pivots as P


def plain(pairs, pivots):
    """Brandes node by node: the dependencies of every node over the pivots."""
    after, total = defaultdict(set), defaultdict(float)
    for a, b in pairs:
        if a != b:
            after[a].add(b)
    for p in pivots:
        dist, sigma, before, order, todo = {p: 0}, defaultdict(float, {p: 1.0}), defaultdict(list), [], deque([p])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in after[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != p:
                total[w] += delta[w]
    return total


GRAPHS = {"random": [(a, b) for r in [random.Random(3)] for a, b in [(r.randrange(60), r.randrange(60)) for _ in range(240)]],
          "path": [(i, i + 1) for i in range(40)], "hub": [(0, i) for i in range(1, 50)] + [(i, 60) for i in range(1, 50)] + [(60, 61), (61, 61)]}


@pytest.mark.parametrize("step", [1, 7, 1_000])
@pytest.mark.parametrize("pairs", GRAPHS.values(), ids=GRAPHS)
def test_dependencies_equal_brute_force(pairs, step, monkeypatch):
    monkeypatch.setattr(P, "STEP_EDGES", step)
    n = max(map(max, pairs)) + 1
    e = np.array(sorted({(a, b) for a, b in pairs if a != b}))
    pieces = []
    for lo in range(0, n, 23):
        part = e[(e[:, 0] >= lo) & (e[:, 0] < lo + 23)]
        if len(part):
            pieces.append((lo, np.concatenate(([0], np.cumsum(np.bincount(part[:, 0] - lo)))), part[:, 1].astype(np.int32)))
    sums = P.Dependencies(pieces, n)
    for p in range(0, n, 2):
        sums.add(p)
    want = plain(pairs, range(0, n, 2))
    assert sums.total.tolist() == pytest.approx([want[v] for v in range(n)])


def test_held_graph_spreads_no_states_and_equals_blocks(spark, monkeypatch):
    pairs = GRAPHS["random"]
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs] + [("n1", None), (None, "n2")], "src string, dst string")
    pivots = spark.createDataFrame([(f"n{p}",) for p in range(0, 60, 3)] + [("nowhere",), (None,)], "address string")
    monkeypatch.setattr(P, "GROUP_EDGES", 10)
    monkeypatch.setattr(P, "PIECE_EDGES", 40)
    spread = G.spread
    monkeypatch.setattr(G, "spread", lambda *a, **k: pytest.fail("states were spread"))
    held = {r["address"]: r["betweenness"] for r in G.betweenness(e, pivots).collect()}
    monkeypatch.setattr(G, "spread", spread)
    monkeypatch.setattr(P, "HELD_EDGES", 0)
    blocks = {r["address"]: r["betweenness"] for r in G.betweenness(e, pivots).collect()}
    assert held == pytest.approx(blocks) and len(held) == 61 and max(held.values()) > 0


def test_no_edges(spark):
    e = spark.createDataFrame([(1, 1)], "src bigint, dst bigint")
    assert [tuple(r) for r in G.betweenness(e, G.nodes_of(e)).collect()] == [(1, 0.0)]
