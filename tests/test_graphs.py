"""Graphs and spectra against sequential and dense reimplementations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import spectra
from turnloom.operators import graphs as G
from turnloom.operators import similarity as S
from turnloom.operators.ordered import Ordering
from turnloom.session import write_table


def sequences(seed, n, alphabet="ABCD"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        labels = [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]
        out.append([x for j, x in enumerate(labels) if j == 0 or labels[j - 1] != x])
    return out


def sequential_paths(seqs):
    """Path by path in order: assign alternating nodes, then repair reversals left to right."""
    weights = {}
    for labels in seqs:
        slots, seen = [], {}
        for x in labels:
            slots.append(seen.get(x, 0) % 2)
            seen[x] = seen.get(x, 0) + 1
        for i in range(len(labels) - 1):
            here, there = (labels[i], slots[i]), (labels[i + 1], slots[i + 1])
            other = (there[0], 1 - there[1])
            if (there, here) in weights and (other, here) not in weights:
                slots[i + 1] = other[1]
                slot = other[1]
                for j in range(i + 2, len(labels)):
                    if labels[j] == other[0]:
                        slot += 1
                        slots[j] = slot % 2
        nodes = list(zip(labels, slots))
        for edge in zip(nodes, nodes[1:]):
            weights[edge] = weights.get(edge, 0) + 1
    name = lambda n: f"{n[0]}_{'ab'[n[1]]}"
    return {(name(u), name(v)): w for (u, v), w in weights.items()}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_path_graphs_equal_the_sequential_fold(spark, chunk):
    graphs = {"g1": sequences(1, 60), "g2": sequences(2, 25, "ABCDEF"), "g3": sequences(3, 1)}
    rows = []
    for graph, seqs in graphs.items():
        for i, labels in enumerate(seqs):
            # sequences order by file, then by position
            rows += [(graph, f"f{i // 7:03d}", i * 100, i * 100 + j, x) for j, x in enumerate(labels)]
    random.Random(0).shuffle(rows)
    frame = spark.createDataFrame(rows, "graph_id string, source_file string, seq long, pos long, label string")
    got = {}
    for r in G.path_edges(frame, chunk=chunk).collect():
        got.setdefault(r.graph_id, {})[r.src, r.dst] = r.weight
    for graph, seqs in graphs.items():
        assert got.get(graph, {}) == sequential_paths(seqs)
        assert sum(got.get(graph, {}).values()) == sum(max(0, len(s) - 1) for s in seqs)


def test_rounds_of_path_graphs_do_not_grow_with_the_chunks(spark, monkeypatch):
    seqs, written = sequences(1, 2000), []

    def write(session, name, df):
        written.append(name)
        return write_table(session, name, df)

    monkeypatch.setattr(G, "write_table", write)
    rows = [("g", "f", i * 100, i * 100 + j, x) for i, labels in enumerate(seqs) for j, x in enumerate(labels)]
    frame = spark.createDataFrame(rows, "graph_id string, source_file string, seq long, pos long, label string")
    got = {(r.src, r.dst): r.weight for r in G.path_edges(frame, chunk=20).collect()}
    assert got == sequential_paths(seqs)
    assert written.count("path_walked") <= 16  # of 100 chunks


@pytest.mark.parametrize("segment", [None, 1, 3])
def test_alternating_visits(spark, segment):
    labels = list("ABABCABA")
    frame = spark.createDataFrame(
        [("f", 0, i, x) for i, x in enumerate(labels)], "source_file string, seq long, pos long, label string")
    out = G.alternate_visits(frame, Ordering(segment_rows=segment), "source_file").orderBy("pos")
    assert [r.label for r in out.collect()] == [
        "A_a", "B_a", "A_b", "B_b", "C_a", "A_a", "B_a", "A_b"]


def test_order_two_edges(spark):
    frame = spark.createDataFrame([(3, "ST -> Q -> A", 4)], "n int, ngram string, cnt long")
    row = G.edges_from(frame, 2).first()
    assert (row.src, row.dst, row.weight) == ("ST→Q", "Q→A", 4)


EDGES = {
    "chain": [("a", "b", 3), ("b", "c", 1)],
    "cycle": [("a", "b", 1), ("b", "c", 2), ("c", "a", 5), ("c", "d", 1)],
    "apart": [("a", "b", 1), ("c", "d", 9), ("d", "e", 2), ("e", "c", 2)],
    "both": [("a", "b", 2), ("b", "a", 3), ("a", "c", 1), ("b", "c", 4)],
}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(g, *e) for g, es in EDGES.items() for e in es]
    return spark.createDataFrame(rows, "graph_id string, src string, dst string, weight long")


def test_components_and_paths(edges):
    got = {r.graph_id: r for r in G.components(edges).collect()}
    assert (got["chain"].n_weak, got["chain"].n_strong) == (1, 3)
    assert (got["cycle"].n_weak, got["cycle"].n_strong) == (1, 2)
    assert (got["apart"].n_weak, got["apart"].n_strong) == (2, 3)
    assert got["apart"].largest_weak_frac == pytest.approx(3 / 5)
    assert got["cycle"].largest_strong_frac == pytest.approx(3 / 4)
    assert got["chain"].avg_shortest_path == pytest.approx((1 + 1 + 2) / 3)
    assert got["apart"].avg_shortest_path == pytest.approx(1.0)
    assert got["cycle"].avg_shortest_path == pytest.approx((1 + 1 + 1 + 1 + 2 + 2) / 6)


def test_clustering_degrees_and_top_edges(edges):
    cluster = {r.graph_id: r.clustering_coeff for r in G.clustering(edges).collect()}
    assert cluster["chain"] == 0
    assert cluster["both"] == pytest.approx(1.0)
    assert cluster["cycle"] == pytest.approx((1 + 1 + 1 / 3 + 0) / 4)
    degree = {r.graph_id: r for r in G.degrees(edges).collect()}
    assert degree["cycle"].max_out_degree_node == "c" and degree["cycle"].mean_in_degree == 1.0
    assert degree["both"].max_in_degree_node == "c"
    top = {r.graph_id: r for r in G.top_edges(edges).collect()}
    assert (top["cycle"].top_edge_1, top["cycle"].top_edge_1_weight) == ("c -> a", 5)
    assert (top["chain"].top_edge_3, top["chain"].top_edge_3_weight) == ("", None)


def test_pruning_removes_isolated_nodes(edges):
    kept = G.prune(edges, 2)
    assert {r.node for r in G.nodes(kept.filter("graph_id = 'chain'"), "graph_id").collect()} == {"a", "b"}


def test_heavy_edges_use_linear_percentiles(edges):
    rows = G.heavy_edges(edges).collect()
    for graph, es in EDGES.items():
        limit = np.percentile([w for *_, w in es], 80)
        for r in rows:
            if r.graph_id == graph:
                assert r.threshold == pytest.approx(limit) and r.heavy == (r.weight >= limit)


def dense(es):
    names = sorted({x for u, v, _ in es for x in (u, v)})
    w = np.zeros((len(names), len(names)))
    for u, v, n in es:
        w[names.index(u), names.index(v)] += n
    return w


def dense_laplacian_trace(h):
    d = np.abs(h).sum(1) if np.iscomplexobj(h) else h.sum(1)
    s = np.diag([1 / np.sqrt(x) if x else 0.0 for x in d])
    lam = np.clip(np.linalg.eigvalsh(np.eye(len(h)) - s @ h @ s), 0, None)
    return np.array([np.exp(-t * lam).sum() for t in spectra.TIMES]) / len(h)


def dense_traces(es, q=0.25):
    """Full matrices and all their eigenvalues."""
    w = dense(es)
    n = len(w)
    h = np.zeros((n, n), complex)
    for i, j in itertools.product(range(n), repeat=2):
        total = w[i, j] + w[j, i]
        if total:
            h[i, j] = total / 2 * np.exp(2j * np.pi * q * (w[i, j] - w[j, i]) / total)
    links = [(i, j) for i in range(n) for j in range(n) if w[i, j]]
    b = np.array([[w[s, t] if s == v and t != u else 0.0 for s, t in links] for u, v in links])
    lam = np.abs(np.linalg.eigvalsh((b + b.T) / 2))
    return {"netlsd": dense_laplacian_trace(w + w.T), "magnetic": dense_laplacian_trace(h),
            "hashimoto": np.array([np.exp(-t * lam).sum() / len(links) for t in spectra.TIMES])}


def random_edges(seed, n, m, loops=True):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}") for _ in range(m)}
    return [(u, v, rng.randrange(1, 40)) for u, v in sorted(pairs) if loops or u != v]


def test_heat_traces_equal_dense_matrices(spark):
    graphs = {**EDGES, "loop": [("x", "x", 3)], "few": random_edges(1, 12, 40), "many": random_edges(2, 40, 600),
              "blocks": random_edges(3, 150, 500), "pairs": random_edges(4, 10, 300, loops=False)}
    rows = [(g, *e) for g, es in graphs.items() for e in es]
    edges = spark.createDataFrame(rows, "graph_id string, src string, dst string, weight long")
    got = {r.graph_id: r for r in S.traces(edges).collect()}
    assert set(got) == set(graphs)
    for g, es in graphs.items():
        for kind, want in dense_traces(es).items():
            assert np.abs(np.array(got[g][kind]) - want).max() < 1e-9, (g, kind)


def test_traces_of_a_graph_without_dense_matrices(spark):
    n = 600  # a ring: its spectrum is known
    edges = spark.createDataFrame([("g", f"{i}", f"{(i + 1) % n}", 1) for i in range(n)],
                                  "graph_id string, src string, dst string, weight long")
    got = S.traces(edges).first()
    lam = 1 - np.cos(2 * np.pi * np.arange(n) / n)
    assert np.abs(np.array(got.netlsd) - np.exp(-np.outer(spectra.TIMES, lam)).mean(1)).max() < 1e-9
    half = np.abs(np.cos(2 * np.pi * np.arange(n) / n))  # each edge is followed by one and follows one
    assert np.abs(np.array(got.hashimoto) - np.exp(-np.outer(spectra.TIMES, half)).mean(1)).max() < 1e-6


def test_trace_distances_and_summary(edges):
    scoped = edges.withColumn("scope", F.lit("s"))
    traced = S.traces(edges).withColumn("scope", F.lit("s"))
    got = {(r.a, r.b): r for r in S.trace_distances(traced, ["scope"]).collect()}
    assert len(got) == 6
    for (a, b), r in got.items():
        left, right = dense_traces(EDGES[a]), dense_traces(EDGES[b])
        for name in S.SPECTRA:
            assert r[f"{name}_distance"] == pytest.approx(np.linalg.norm(left[name] - right[name]))
    summary = {(r.a, r.b): r for r in S.summary(scoped, ["scope"]).collect()}
    for key, r in summary.items():
        assert r.netlsd_similarity == pytest.approx(1 / (1 + got[key].netlsd_distance), abs=1e-4)
        assert r.js_divergence == pytest.approx(1 - r.js_similarity, abs=1e-9)


@pytest.mark.parametrize("js,mag,hsh,flag", [
    (0.8, 0.8, 0.9, "both_similar"), (0.1, 0.2, 0.3, "both_different"),
    (0.65, 0.2, 0.3, "same_transitions_diff_direction"), (0.45, 0.7, 0.7, "diff_transitions_same_topology"),
    (0.55, 0.9, 0.3, "directed_methods_disagree"), (0.55, 0.55, 0.55, "mixed"),
])
def test_agreement_flags(spark, js, mag, hsh, flag):
    row = spark.createDataFrame([(js, mag, hsh)], "j double, m double, h double")
    assert row.select(S.agreement(F.col("j"), F.col("m"), F.col("h")).alias("f")).first().f == flag


def test_graph_against_its_pool(spark):
    rows = [("t1", "x", "y", 2.0), ("t1", "y", "x", 1.0), ("t2", "x", "y", 1.0), ("t2", "y", "z", 3.0),
            ("u1", "x", "z", 1.0), ("u1", "z", "x", 2.0)]
    edges = spark.createDataFrame(rows, "graph_id string, src string, dst string, weight double")
    pool = F.concat(F.lit("whole_"), F.substring("graph_id", 1, 1))
    pooled = G.pool(edges, pool)
    got = {(r.a, r.b): r.asDict() for r in S.against_pool(edges, pooled, pool).collect()}
    assert set(got) == {("t1", "whole_t"), ("t2", "whole_t"), ("u1", "whole_u")}
    for a, b in got:
        pair = edges.where(F.col("graph_id") == a).unionByName(pooled.where(F.col("graph_id") == b))
        alone = S.summary(pair.withColumn("scope", F.lit(1)), ["scope"]).drop("scope").collect()
        assert [r.asDict() for r in alone] == [got[a, b]]
    assert got["u1", "whole_u"]["js_similarity"] == 1.0
