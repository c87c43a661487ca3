"""Components, distances and triangles against plain searches, and on graphs beyond one task."""

import random
from collections import defaultdict, deque

import pytest

from turnloom.operators import graphs as G
from turnloom.operators import reach

SCHEMA = "graph_id string, src string, dst string"


def found_from(start, step):
    distance, queue = {start: 0}, deque([start])
    while queue:
        here = queue.popleft()
        for there in step[here]:
            if there not in distance:
                distance[there] = distance[here] + 1
                queue.append(there)
    return distance


def searched(edges):
    forward, backward, around = defaultdict(set), defaultdict(set), defaultdict(set)
    for u, v in edges:
        forward[u].add(v), backward[v].add(u), around[u].add(v), around[v].add(u)
    weak = {n: frozenset(found_from(n, around)) for n in around}
    strong = {n: frozenset(found_from(n, forward)) & frozenset(found_from(n, backward)) for n in around}
    return weak, strong, {n: sum(found_from(n, around).values()) for n in around}


def random_graphs(seed):
    rng, graphs = random.Random(seed), {}
    for g in range(8):
        n = rng.randrange(1, 30)
        graphs[f"g{g}"] = {(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(rng.randrange(1, 2 * n + 2))}
    graphs["loop"] = {("x", "x")}
    graphs["line"] = {(f"l{i:02d}", f"l{i + 1:02d}") for i in range(9)}
    graphs["ring"] = {(f"r{i:02d}", f"r{(i + 1) % 8:02d}") for i in range(8)} | {("r00", "s"), ("s", "t"), ("t", "s")}
    return graphs


def groups(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.graph_id, r.root].add(r.node)
    return {(g, frozenset(m)) for (g, _), m in out.items()}


@pytest.mark.parametrize("steps", [2])
def test_components_of_many_graphs(spark, steps):
    graphs = random_graphs(steps)
    edges = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in sorted(es)], SCHEMA)
    want = {g: searched(es) for g, es in graphs.items()}
    weak = reach.weak(edges, steps).collect()
    assert groups(weak) == {(g, m) for g, (w, _, _) in want.items() for m in w.values()}
    assert all(r.root == min(want[r.graph_id][0][r.node]) for r in weak)
    assert groups(reach.strong(edges, steps).collect()) == {(g, m) for g, (_, s, _) in want.items() for m in s.values()}
    members = reach.weak(edges, steps).select("graph_id", "node")
    totals = {r.graph_id: r.total for r in reach.total_distances(edges, members, steps).collect()}
    assert totals == {g: sum(d.values()) for g, (_, _, d) in want.items()}
    got = {r.graph_id: r for r in G.components(edges).collect()}
    for g, (w, s, d) in want.items():
        largest = min(set(w.values()), key=lambda m: (-len(m), min(m)))
        assert (got[g].n_weak, got[g].n_strong) == (len(set(w.values())), len(set(s.values())))
        assert got[g].largest_strong_frac == max(map(len, s.values())) / len(w)
        mean = sum(d[n] for n in largest) / (len(largest) * (len(largest) - 1)) if len(largest) > 1 else None
        assert got[g].avg_shortest_path == (None if mean is None else pytest.approx(mean))


def test_numbering_in_parts(spark, monkeypatch):
    monkeypatch.setattr(reach, "NUMBERED", 70)
    rng = random.Random(5)
    es = {(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 300)}
    edges = spark.createDataFrame([("g", *e) for e in es], SCHEMA)
    members = reach.weak(edges).select("graph_id", "node")
    assert reach.total_distances(edges, members).first().total == sum(searched(es)[2].values())


def test_a_graph_of_a_hundred_thousand_nodes(spark):
    n, rng = 100_000, random.Random(9)
    ring = [(f"a{i}", f"a{rng.randrange(n // 2)}") for i in range(n // 2) for _ in range(3)]
    tail = [(f"a{rng.randrange(n // 2)}", f"b{i}") for i in range(n // 2 - 1000)]
    apart = [(f"c{i}", f"c{(i + 1) % 10 + i // 10 * 10}") for i in range(1000)]
    edges = spark.createDataFrame([("g", *e) for e in ring + tail + apart], SCHEMA).repartition(8)
    es = {e for e in ring + tail + apart}
    around = defaultdict(set)
    for u, v in es:
        around[u].add(v), around[v].add(u)
    weak = groups(reach.weak(edges).collect())
    left, want = set(around), set()
    while left:
        part = frozenset(found_from(next(iter(left)), around))
        want.add(("g", part))
        left -= part
    assert weak == want
    forward, backward = defaultdict(set), defaultdict(set)
    for u, v in es:
        forward[u].add(v), backward[v].add(u)
    strong = groups(reach.strong(edges).collect())
    assert sum(len(m) for _, m in strong) == len(around)
    core = max((m for _, m in strong), key=len)
    start = next(iter(core))
    assert core == set(found_from(start, forward)) & set(found_from(start, backward)) and len(core) > n // 4


def test_triangles_at_a_hub(spark):
    spokes = 3000
    es = [("hub", f"s{i}") for i in range(spokes)] + [(f"s{i}", f"s{i + 1}") for i in range(0, spokes, 2)]
    edges = spark.createDataFrame([("g", *e) for e in es], SCHEMA)
    closed = spokes // 2
    want = (2 * closed / (spokes * (spokes - 1)) + 2 * closed) / (spokes + 1)
    assert G.clustering(edges).first().clustering_coeff == pytest.approx(want)
