"""Greedy modularity and Markov clustering against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from helispan.operators import clusters

GRAPH = "k string, src long, dst long, w double"


def _graphs():
    rng = random.Random(6)
    out = {"triangles": (range(6), [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]), "none": (range(3), []), "one": ([7], []), "path": (range(9), [(i, i + 1) for i in range(8)]), "ring": (range(8), [(i, (i + 1) % 8) for i in range(8)])}
    for g in range(12):
        n = rng.randint(4, 18)
        out[f"r{g}"] = (range(n), sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 3 * n))}))
    return {k: (list(n), [(min(e), max(e)) for e in edges]) for k, (n, edges) in out.items()}


def _numbers(label):
    order = {x: i for i, x in enumerate(sorted(set(label.values())))}
    return {n: order[x] for n, x in label.items()}


def modularity(edges, label):
    m = len(edges)
    inside = sum(label[a] == label[b] for a, b in edges)
    degree = {}
    for e in edges:
        for n in e:
            degree[label[n]] = degree.get(label[n], 0) + 1
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def plain_greedy(nodes, edges):
    """All pairs looked at in each step; the modularity itself decides."""
    label = {n: n for n in nodes}
    while True:
        options = []
        groups = sorted(set(label.values()))
        for i, a in enumerate(groups):
            for b in groups[i + 1 :]:
                if any({label[x], label[y]} == {a, b} for x, y in edges):
                    merged = {n: a if x == b else x for n, x in label.items()}
                    options.append((-round(modularity(edges, merged) - modularity(edges, label), 12), a, b))
        if not options or min(options)[0] >= 0:
            return _numbers(label)
        _, a, b = min(options)
        label = {n: a if x == b else x for n, x in label.items()}


def plain_mutual(nodes, edges):
    label = {n: n for n in nodes}
    m = len(edges)
    while True:
        degree, between = {}, {}
        for x, y in edges:
            a, b = label[x], label[y]
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1 if a != b else degree.get(a, 0) + 2
            if a == b:
                degree[a] = degree[b]
            else:
                between[a, b] = between.get((a, b), 0) + 1
                between[b, a] = between[a, b]
        best = {}
        for (a, b), e in between.items():
            w = 2 * m * e - degree[a] * degree[b]
            if w > 0:
                best[a] = max(best.get(a, (0,)), (w, -min(a, b), -max(a, b), b))
        pairs = [(a, v[3]) for a, v in best.items() if a < v[3] and best[v[3]][3] == a]
        if not pairs:
            return _numbers(label)
        into = {b: a for a, b in pairs}
        label = {n: into.get(x, x) for n, x in label.items()}


def plain_markov(nodes, edges, inflation=2.0, least=1e-5):
    n = len(nodes)
    at = {x: i for i, x in enumerate(nodes)}
    m = np.eye(n)
    for a, b in edges:
        m[at[a], at[b]] = m[at[b], at[a]] = 1.0
    m = np.round(m / m.sum(axis=0), 12)
    for _ in range(300):
        s = (m @ m) ** inflation
        s = s / s.sum(axis=0)
        s[s < least] = 0
        s = np.round(s / s.sum(axis=0), 12)
        if np.abs(s - m).max() <= 1e-9:
            break
        m = s
    label = dict(zip(nodes, nodes, strict=True))
    while True:
        new = {x: min(label[y] for y in nodes if x == y or m[at[x], at[y]] > 0 or m[at[y], at[x]] > 0) for x in nodes}
        if new == label:
            return _numbers(label)
        label = new


@pytest.fixture(scope="module")
def frames(spark):
    graphs = _graphs()
    nodes = spark.createDataFrame([(k, n) for k, (own, _) in graphs.items() for n in own], "k string, node long")
    edges = spark.createDataFrame([(k, a, b, 2.0) for k, (_, own) in graphs.items() for a, b in own], GRAPH)
    return graphs, nodes, edges


def _got(df):
    out: dict[str, dict[int, int]] = {}
    for r in df.collect():
        out.setdefault(r.k, {})[r.node] = r.domain
    return out


@pytest.mark.parametrize(("found", "plain"), [(clusters.greedy_communities, plain_greedy), (clusters.mutual_communities, plain_mutual), (clusters.markov_clusters, plain_markov)])
def test_plain(frames, found, plain):
    graphs, nodes, edges = frames
    if plain is plain_markov:
        # The ring settles in 59 rounds, the others in 14 at most.
        graphs = {k: g for k, g in graphs.items() if k != "ring"}
        nodes, edges = nodes.where("k <> 'ring'"), edges.where("k <> 'ring'")
    got = _got(found(nodes, edges, ["k"]))
    assert got == {k: plain(n, e) for k, (n, e) in graphs.items()}
    assert got["triangles"] == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1} and got["one"] == {7: 0} and got["none"] == {0: 0, 1: 1, 2: 2}


def test_weights(frames):
    """Equal weights change nothing; an empty table has no rows."""
    _, nodes, edges = frames
    nodes, edges = nodes.where("k in ('triangles', 'r7')"), edges.where("k in ('triangles', 'r7')")
    assert _got(clusters.markov_clusters(nodes, edges, ["k"], weight="w")) == _got(clusters.markov_clusters(nodes, edges, ["k"]))
    for f in (clusters.greedy_communities, clusters.mutual_communities, clusters.markov_clusters):
        assert f(nodes.limit(0), edges.limit(0), ["k"]).count() == 0


def test_large_graph_in_one_task():
    """A chain of ten thousand nodes in groups: the heap finds the groups."""
    edges = [(i, j) for g in range(0, 10_000, 10) for i in range(g, g + 10) for j in range(i + 1, g + 10)] + [(g, g + 10) for g in range(0, 9_990, 10)]
    label = clusters.agglomerate(list(range(10_000)), edges)
    assert all(label[g] == label[g + k] for g in range(0, 10_000, 10) for k in range(10))
