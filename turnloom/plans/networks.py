"""Queries over transition graphs and their similarity (inventory I and J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators import blocks as B
from turnloom.operators import graphs as G
from turnloom.operators import ngrams as N
from turnloom.operators import similarity as S
from turnloom.plans import bags, oracle, registry
from turnloom.plans.registry import registered
from turnloom.plans.tables import tables

MIN_WEIGHT = 2


def r6(column):
    return F.round(column, 6)


def code_edges(spark, sf_dir, target: str, k: int = 1) -> DataFrame:
    """One graph per code of a target."""
    return G.edges_from(bags._coded(spark, sf_dir, target), k).withColumnRenamed("code", "graph_id")


def speaker_edges(spark, sf_dir) -> DataFrame:
    """Pruned code graphs of both targets with their speaker."""
    return reduce(DataFrame.unionByName, [
        G.prune(code_edges(spark, sf_dir, target), MIN_WEIGHT).withColumn("speaker", F.lit(target))
        for target in B.TARGETS
    ])


def baseline_edges(spark, sf_dir) -> DataFrame:
    counts = tables(spark, sf_dir).ngram_counts().filter(
        (F.col("level") == "importance") & (F.col("group") == "non_important"))
    return G.prune(G.edges_from(counts).drop("level").withColumnRenamed("group", "graph_id"), MIN_WEIGHT)


def transcript_paths(spark, sf_dir) -> DataFrame:
    """Dual-node graph of every transcript. A graph built from one sequence has no earlier
    edges to avoid, so alternation alone gives it."""
    t = tables(spark, sf_dir)

    def build():
        rows = B.compress_runs(B.sequence_rows(t.hub(), "transcript"), "groups").select(
            "source_file", "seq", "pos", L.abbreviate(F.col("da_group"), "groups").alias("label"))
        dual = G.alternate_visits(rows, t.order, "source_file")
        counts = N.count_ngrams(N.ngrams(dual, t.order, (2,)), "source_file")
        return G.edges_from(counts).withColumnRenamed("source_file", "graph_id")

    return t.once("transcript_paths", build)


def dual_edges(spark, sf_dir) -> DataFrame:
    """Dual-node graphs with antiparallel avoidance, per code of each target and for the
    non-important runs; `speaker` is null for the latter."""
    t = tables(spark, sf_dir)

    def build():
        hub = t.hub()

        def rows(kind):
            return B.compress_runs(B.sequence_rows(hub, kind), "groups").select(
                "source_file", "seq", "pos", L.abbreviate(F.col("da_group"), "groups").alias("label"))

        parts = [rows("neither").withColumn("graph_id", F.lit("non_important"))]
        for target in B.TARGETS:
            codes = t.block_codes(target).select("source_file", F.col("block_start").alias("seq"), "code")
            parts.append(
                rows(target).join(codes, ["source_file", "seq"])
                .withColumn("graph_id", F.concat(F.lit(f"{target}_"), F.col("code"))).drop("code"))
        return G.path_edges(reduce(DataFrame.unionByName, parts))

    speaker = F.regexp_extract("graph_id", "^(patient|therapist)_", 1)
    return t.once("dual_edges", build).withColumn("speaker", F.when(speaker != "", speaker))


oracle.add_view("code_graphs", """
    SELECT target AS speaker, code AS graph_id, split_part(ngram, ' -> ', 1) AS src, split_part(ngram, ' -> ', 2) AS dst,
           cnt AS weight FROM coded_grams WHERE n = 2""")
oracle.add_view("kept_graphs", "SELECT * FROM code_graphs WHERE weight >= 2")
oracle.add_view("rest_graph", """
    SELECT 'non_important' AS graph_id, split_part(ngram, ' -> ', 1) AS src, split_part(ngram, ' -> ', 2) AS dst, cnt AS weight
    FROM levels WHERE level = 'importance' AND "group" = 'non_important' AND n = 2 AND cnt >= 2""")


@registered("i01_order_graphs", """
    SELECT speaker, graph_id, 1 AS k, src, dst, weight FROM code_graphs
    UNION ALL SELECT target, code, 2, split_part(ngram, ' -> ', 1) || '→' || split_part(ngram, ' -> ', 2),
      split_part(ngram, ' -> ', 2) || '→' || split_part(ngram, ' -> ', 3), cnt FROM coded_grams WHERE n = 3""")
def order_graphs(spark, sf_dir):
    """Order-1 and order-2 transition graphs per code of either side."""
    return reduce(DataFrame.unionByName, [
        code_edges(spark, sf_dir, target, k).select(
            F.lit(target).alias("speaker"), "graph_id", F.lit(k).alias("k"), "src", "dst", "weight")
        for target in B.TARGETS for k in (1, 2)
    ])


@registered("i02_pruned_nodes", """
    SELECT DISTINCT speaker, graph_id, unnest([src, dst]) AS node FROM kept_graphs""")
def pruned_nodes(spark, sf_dir):
    """Nodes left once rare edges are gone."""
    return G.nodes(speaker_edges(spark, sf_dir), "speaker", "graph_id")


@registered("i03_code_graphs", "SELECT speaker, graph_id, src, dst, weight FROM kept_graphs")
def code_graphs(spark, sf_dir):
    return speaker_edges(spark, sf_dir).select("speaker", "graph_id", "src", "dst", "weight")


oracle.add_view("dual_rows", """
    SELECT source_file, pos, label || CASE row_number() OVER (PARTITION BY source_file, label ORDER BY pos) % 2
             WHEN 1 THEN '_a' ELSE '_b' END AS label FROM seqs WHERE cls = 'transcript'""")
oracle.add_view("transcript_graphs", """
    SELECT source_file AS graph_id, label AS src, dst, count(*) AS weight FROM (
      SELECT *, lead(label) OVER (PARTITION BY source_file ORDER BY pos) AS dst FROM dual_rows)
    WHERE dst IS NOT NULL GROUP BY ALL""")


@registered("i04_alternating_paths", "SELECT * FROM transcript_graphs")
def alternating_paths(spark, sf_dir):
    return transcript_paths(spark, sf_dir).select("graph_id", "src", "dst", "weight")


oracle.add_view("path_rows", """
    SELECT graph_id, label, pos = min(pos) OVER (PARTITION BY graph_id, source_file, seq) AS opens,
           row_number() OVER (PARTITION BY graph_id ORDER BY source_file, seq, pos) AS rn FROM (
      SELECT 'non_important' AS graph_id, source_file, seq, pos, label FROM seqs WHERE cls = 'neither'
      UNION ALL SELECT target || '_' || code, s.source_file, seq, pos, label FROM seqs s JOIN target_codes c
        ON c.target = s.cls AND c.source_file = s.source_file AND c.block_start = s.seq)""")


@registered("i05_path_graphs", """
    WITH RECURSIVE walk AS (
      SELECT DISTINCT graph_id, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS known, CAST([] AS VARCHAR[]) AS fresh,
             CAST([] AS VARCHAR[]) AS second, CAST(NULL AS VARCHAR) AS here, CAST(NULL AS VARCHAR) AS edge FROM path_rows
      UNION ALL
      SELECT graph_id, rn, known, CASE WHEN here IS NULL OR list_contains(known, here || '>' || node) THEN fresh
               ELSE list_distinct(list_append(fresh, here || '>' || node)) END,
             CASE WHEN node = label || '_a' THEN list_append(second, label) ELSE list_filter(second, lambda x: x <> label) END,
             node, here || '>' || node
      FROM (SELECT *, CASE WHEN here IS NOT NULL AND list_contains(known, own || '>' || here)
                             AND NOT list_contains(known, other || '>' || here) THEN other ELSE own END AS node
            FROM (SELECT *, label || CASE WHEN list_contains(second, label) THEN '_b' ELSE '_a' END AS own,
                         label || CASE WHEN list_contains(second, label) THEN '_a' ELSE '_b' END AS other
                  FROM (SELECT r.graph_id, r.rn, r.label,
                               CASE WHEN opens THEN list_concat(known, fresh) ELSE known END AS known,
                               CASE WHEN opens THEN [] ELSE fresh END AS fresh,
                               CASE WHEN opens THEN [] ELSE second END AS second, CASE WHEN opens THEN NULL ELSE here END AS here
                        FROM walk w JOIN path_rows r ON r.graph_id = w.graph_id AND r.rn = w.rn + 1))))
    SELECT graph_id, split_part(edge, '>', 1) AS src, split_part(edge, '>', 2) AS dst, count(*) AS weight
    FROM walk WHERE edge IS NOT NULL GROUP BY ALL""")
def path_graphs(spark, sf_dir):
    return dual_edges(spark, sf_dir).select("graph_id", "src", "dst", "weight")


def _cluster(speaker):
    side = F.when(F.col("graph_id").isin(*L.CLUSTER_A_CODES), "_cluster_a").otherwise("_cluster_b")
    return F.concat(speaker, side)


def pooled(spark, sf_dir) -> DataFrame:
    edges = speaker_edges(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        G.pool(edges, F.col("speaker")),
        G.pool(edges, _cluster(F.col("speaker"))),
        G.pool(transcript_paths(spark, sf_dir), F.concat(
            F.lit("rater_"), L.therapist_before_marker(F.col("graph_id")))),
    ])


@registered("i06_pooled_graphs", """
    SELECT speaker AS graph_id, src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM kept_graphs GROUP BY ALL
    UNION ALL SELECT speaker || CASE WHEN graph_id IN ('IAI', 'BCS', 'FSU', 'VLD') THEN '_cluster_a' ELSE '_cluster_b' END,
      src, dst, CAST(sum(weight) AS BIGINT) FROM kept_graphs GROUP BY ALL
    UNION ALL SELECT 'rater_' || regexp_extract(graph_id, '(.)_with', 1), src, dst, CAST(sum(weight) AS BIGINT)
    FROM transcript_graphs GROUP BY ALL""")
def pooled_graphs(spark, sf_dir):
    """Codes merged per speaker and cluster, transcripts merged per therapist."""
    return pooled(spark, sf_dir)


@registered("i07_transition_vectors", """
    SELECT speaker, graph_id, src, dst, round(weight / sum(weight) OVER (PARTITION BY speaker, graph_id), 6) AS share
    FROM kept_graphs""")
def transition_vectors(spark, sf_dir):
    edges = speaker_edges(spark, sf_dir).withColumn("graph_id", F.concat_ws(":", "speaker", "graph_id"))
    return G.transition_vectors(edges).select(
        "speaker", F.element_at(F.split("graph_id", ":"), 2).alias("graph_id"), "src", "dst",
        r6("share").alias("share"))


oracle.add_view("transcript_nodes", "SELECT DISTINCT graph_id, unnest([src, dst]) AS node FROM transcript_graphs")


@registered("i08_graph_sizes", """
    SELECT graph_id, n_nodes, n_edges, round(CASE WHEN n_nodes > 1 THEN n_edges / (n_nodes * (n_nodes - 1)) ELSE 0 END, 6) AS density
    FROM (SELECT graph_id, count(*) AS n_nodes FROM transcript_nodes GROUP BY ALL)
    JOIN (SELECT graph_id, count(*) AS n_edges FROM transcript_graphs GROUP BY ALL) USING (graph_id)""")
def graph_sizes(spark, sf_dir):
    return G.sizes(transcript_paths(spark, sf_dir)).select(
        "graph_id", "n_nodes", "n_edges", r6("density").alias("density"))


oracle.add_view("arcs", """
    SELECT graph_id, src AS u, dst AS v FROM transcript_graphs UNION SELECT graph_id, dst, src FROM transcript_graphs""")


@registered("i09_components", """
    WITH RECURSIVE walk AS (
        SELECT graph_id, node AS a, node AS b, 0 AS d FROM transcript_nodes
        UNION SELECT w.graph_id, w.a, x.v, w.d + 1 FROM walk w JOIN arcs x ON w.graph_id = x.graph_id AND w.b = x.u
        WHERE w.d < 6),
    reach AS (
        SELECT graph_id, node AS a, node AS b FROM transcript_nodes
        UNION SELECT r.graph_id, r.a, t.dst FROM reach r JOIN transcript_graphs t ON r.graph_id = t.graph_id AND r.b = t.src),
    weak AS (SELECT graph_id, a, min(b) AS root, CAST(sum(d) AS BIGINT) AS far, count(*) AS met
             FROM (SELECT graph_id, a, b, min(d) AS d FROM walk GROUP BY ALL) GROUP BY ALL),
    strong AS (SELECT r.graph_id, r.a, min(r.b) AS root FROM reach r
               JOIN reach s ON r.graph_id = s.graph_id AND r.a = s.b AND r.b = s.a GROUP BY ALL),
    ws AS (SELECT graph_id, root, count(*) AS m, sum(far) AS far FROM weak GROUP BY ALL),
    ss AS (SELECT graph_id, root, count(*) AS m FROM strong GROUP BY ALL)
    SELECT w.graph_id, n_weak, n_strong, round(wf, 6) AS largest_weak_frac, round(sf, 6) AS largest_strong_frac,
           round(avg_path, 6) AS avg_shortest_path
    FROM (SELECT graph_id, count(*) AS n_weak, max(m) / sum(m) AS wf,
                 arg_max(far, (m, -ascii(root))) / (max(m) * (max(m) - 1)) AS avg_path FROM ws GROUP BY ALL) w
    JOIN (SELECT graph_id, count(*) AS n_strong, max(m) / sum(m) AS sf FROM ss GROUP BY ALL) USING (graph_id)""")
def graph_components(spark, sf_dir):
    """Weak and strong components, and mean shortest path of the largest weak one."""
    return G.components(transcript_paths(spark, sf_dir)).select(
        "graph_id", "n_weak", "n_strong", *[r6(c).alias(c) for c in (
            "largest_weak_frac", "largest_strong_frac", "avg_shortest_path")])


oracle.add_view("node_degrees", """
    SELECT n.graph_id, n.node, count(DISTINCT i.src) AS in_degree, count(DISTINCT o.dst) AS out_degree
    FROM transcript_nodes n LEFT JOIN transcript_graphs i ON i.graph_id = n.graph_id AND i.dst = n.node
    LEFT JOIN transcript_graphs o ON o.graph_id = n.graph_id AND o.src = n.node GROUP BY ALL""")


@registered("i10_degrees", """
    SELECT graph_id, round(avg(in_degree), 6) AS mean_in_degree, round(avg(out_degree), 6) AS mean_out_degree,
           arg_min(node, (-in_degree, node)) AS max_in_degree_node, arg_min(node, (-out_degree, node)) AS max_out_degree_node
    FROM node_degrees GROUP BY ALL""")
def graph_degrees(spark, sf_dir):
    return G.degrees(transcript_paths(spark, sf_dir)).select(
        "graph_id", r6("mean_in_degree").alias("mean_in_degree"),
        r6("mean_out_degree").alias("mean_out_degree"), "max_in_degree_node", "max_out_degree_node")


@registered("i11_clustering", """
    WITH d AS (SELECT graph_id, u, count(*) AS k FROM arcs GROUP BY ALL),
    t AS (SELECT a.graph_id, a.u, count(*) AS closed FROM arcs a JOIN arcs b ON a.graph_id = b.graph_id AND a.u = b.u AND a.v <> b.v
          JOIN arcs c ON c.graph_id = a.graph_id AND c.u = a.v AND c.v = b.v GROUP BY ALL)
    SELECT graph_id, round(avg(CASE WHEN k > 1 THEN coalesce(closed, 0) / (k * (k - 1)) ELSE 0 END), 6) AS clustering_coeff
    FROM d LEFT JOIN t USING (graph_id, u) GROUP BY ALL""")
def graph_clustering(spark, sf_dir):
    return G.clustering(transcript_paths(spark, sf_dir)).select(
        "graph_id", r6("clustering_coeff").alias("clustering_coeff"))


@registered("i13_top_edges", """
    SELECT graph_id, """ + ", ".join(
        f"coalesce(max(e) FILTER (WHERE r = {r}), '') AS top_edge_{r}, max(weight) FILTER (WHERE r = {r}) AS top_edge_{r}_weight"
        for r in (1, 2, 3)) + """
    FROM (SELECT graph_id, src || ' -> ' || dst AS e, weight,
                 row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, src, dst) AS r FROM transcript_graphs)
    GROUP BY ALL""")
def heaviest_edges(spark, sf_dir):
    return G.top_edges(transcript_paths(spark, sf_dir))


def _metric_sql() -> str:
    parts = [registry.sql_of(name) for name in (
        "i08_graph_sizes", "i09_components", "i10_degrees", "i11_clustering", "i13_top_edges")]
    joined = f"({parts[0]})" + "".join(f" JOIN ({sql}) USING (graph_id)" for sql in parts[1:])
    return f"SELECT *, regexp_extract(graph_id, '(.)_with', 1) AS therapist_id FROM {joined}"


@registered("i14_graph_metrics", _metric_sql())
def graph_metrics(spark, sf_dir):
    """Every metric of every transcript graph in one table."""
    rounded = ["density", "mean_in_degree", "mean_out_degree", "clustering_coeff", "largest_weak_frac",
               "largest_strong_frac", "avg_shortest_path"]
    return G.metrics(transcript_paths(spark, sf_dir)).withColumns({
        **{c: r6(c) for c in rounded},
        "therapist_id": L.therapist_before_marker(F.col("graph_id")),
    })


@registered("i15_heavy_edges", """
    SELECT speaker, graph_id, src, dst, weight, round(weight / max(weight) OVER (PARTITION BY speaker, graph_id), 6) AS relative_weight,
           weight >= quantile_cont(weight, 0.8) OVER (PARTITION BY speaker, graph_id) AS heavy FROM kept_graphs""")
def heavy_edges(spark, sf_dir):
    return reduce(DataFrame.unionByName, [
        G.heavy_edges(G.prune(code_edges(spark, sf_dir, target), MIN_WEIGHT)).select(
            F.lit(target).alias("speaker"), "graph_id", "src", "dst", "weight",
            r6("relative_weight").alias("relative_weight"), "heavy")
        for target in B.TARGETS
    ])


@registered("i16_node_attributes", """
    WITH n AS (SELECT DISTINCT graph_id, unnest([src, dst]) AS node FROM transcript_graphs),
    r AS (SELECT source_file AS graph_id, label, avg(run_length) AS mean_run_length FROM seqs WHERE cls = 'transcript' GROUP BY ALL)
    SELECT n.graph_id, n.node, coalesce(CAST(o.w AS BIGINT), 0) AS out_weight, round(r.mean_run_length, 6) AS mean_run_length
    FROM n LEFT JOIN (SELECT graph_id, src, sum(weight) AS w FROM transcript_graphs GROUP BY ALL) o
      ON o.graph_id = n.graph_id AND o.src = n.node
    LEFT JOIN r ON r.graph_id = n.graph_id AND r.label = regexp_replace(n.node, '_[ab]$', '')""")
def node_attributes(spark, sf_dir):
    lengths = B.mean_run_lengths(
        B.sequence_rows(tables(spark, sf_dir).hub(), "transcript"), "groups", "source_file",
    ).select(F.col("source_file").alias("graph_id"),
             L.abbreviate(F.col("label"), "groups").alias("label"), "mean_run_length")
    return G.node_attributes(transcript_paths(spark, sf_dir), lengths).select(
        "graph_id", "node", "out_weight", r6("mean_run_length").alias("mean_run_length"))


@registered("j01_edge_divergence", """
    WITH v AS (SELECT DISTINCT speaker, src, dst FROM kept_graphs),
    s AS (SELECT speaker, count(*) AS vocab FROM v GROUP BY ALL),
    f AS (SELECT *, weight / sum(weight) OVER (PARTITION BY speaker, graph_id) AS share FROM kept_graphs),
    p AS (SELECT g.speaker, g.graph_id, v.src, v.dst, (coalesce(f.share, 0) + 1e-9) / (1 + vocab * 1e-9) AS p
          FROM (SELECT DISTINCT speaker, graph_id FROM kept_graphs) g JOIN v ON g.speaker = v.speaker JOIN s ON s.speaker = v.speaker
          LEFT JOIN f ON f.speaker = v.speaker AND f.graph_id = g.graph_id AND f.src = v.src AND f.dst = v.dst)
    SELECT speaker, a, b, round(js, 6) AS js_divergence, round(1 - js, 6) AS js_similarity FROM (
      SELECT x.speaker, x.graph_id AS a, y.graph_id AS b, greatest(sum(0.5 * x.p * log2(2 * x.p / (x.p + y.p))
             + 0.5 * y.p * log2(2 * y.p / (x.p + y.p))), 0) AS js
      FROM p x JOIN p y ON x.speaker = y.speaker AND x.src = y.src AND x.dst = y.dst AND x.graph_id < y.graph_id GROUP BY ALL)""")
def edge_divergence(spark, sf_dir):
    return S.edge_divergence(speaker_edges(spark, sf_dir), ["speaker"]).select(
        "speaker", "a", "b", r6("js").alias("js_divergence"), r6(1 - F.col("js")).alias("js_similarity"))


def _speaker_graphs(spark, sf_dir) -> DataFrame:
    edges = speaker_edges(spark, sf_dir)
    return edges.withColumn("graph_id", F.concat_ws("_", "speaker", "graph_id"))


# exp(-t L) = exp(-t) * sum of t^k / k! * M^k for the normalised adjacency M, so traces of its
# powers give the heat trace without eigenvalues. M is complex for the magnetic Laplacian.
oracle.add_view("spectral_graphs", """
    SELECT speaker || '_' || graph_id AS g, src AS i, dst AS j, weight AS w FROM kept_graphs""")
oracle.add_view("spectral_pairs", """
    SELECT g, i, j, sum(forward) AS f, sum(backward) AS b FROM (
      SELECT g, i, j, w AS forward, 0 AS backward FROM spectral_graphs
      UNION ALL SELECT g, j, i, 0, w FROM spectral_graphs) GROUP BY ALL""")
oracle.add_view("spectral_degrees", "SELECT g, i, sum(f + b) AS d FROM spectral_pairs GROUP BY ALL")
oracle.add_view("spectral_entries", """
    SELECT p.g, p.i, p.j, (f + b) / sqrt(x.d * y.d) AS v, 0.5 * pi() * (f - b) / (f + b) AS phase
    FROM spectral_pairs p JOIN spectral_degrees x ON x.g = p.g AND x.i = p.i JOIN spectral_degrees y ON y.g = p.g AND y.i = p.j""")
oracle.add_view("trace_steps", "SELECT CAST(s AS BIGINT) AS step, pow(10, -2 + 3 * s / 249) AS t FROM range(250) r(s)")


def _trace_sql(real: str, imaginary: str) -> str:
    return f"""
      WITH RECURSIVE m AS (SELECT g, i, j, {real} AS re, {imaginary} AS im FROM spectral_entries),
      power AS (
        SELECT g, 0 AS k, i, i AS j, 1.0::DOUBLE AS re, 0.0::DOUBLE AS im FROM spectral_degrees
        UNION ALL SELECT p.g, p.k + 1, p.i, m.j, sum(p.re * m.re - p.im * m.im), sum(p.re * m.im + p.im * m.re)
        FROM power p JOIN m ON p.g = m.g AND p.j = m.i WHERE p.k < 70 GROUP BY p.g, p.k, p.i, m.j),
      moments AS (SELECT g, k, sum(re) AS moment FROM power WHERE i = j GROUP BY ALL),
      n AS (SELECT g, count(*) AS n FROM spectral_degrees GROUP BY ALL)
      SELECT g AS graph_id, step, exp(-t) * sum(exp(k * ln(t) - lgamma(k + 1)) * moment) / max(n) AS value
      FROM moments JOIN n USING (g), trace_steps GROUP BY g, step, t"""


oracle.add_view("netlsd_traces", _trace_sql("v", "0.0"))
oracle.add_view("magnetic_traces", _trace_sql("v * cos(phase)", "v * sin(phase)"))


def _trace_query(spectrum: str):
    def query(spark, sf_dir):
        """One heat trace per code graph, point by point."""
        traced = S.traces(_speaker_graphs(spark, sf_dir), [spectrum])
        return traced.select("graph_id", F.posexplode(spectrum).alias("step", "value")).select(
            "graph_id", F.col("step").cast("long").alias("step"), r6("value").alias("value"))

    return query


registered("j02_netlsd_traces", "SELECT graph_id, step, round(value, 6) AS value FROM netlsd_traces")(
    _trace_query("netlsd"))
registered("j03_magnetic_traces", "SELECT graph_id, step, round(value, 6) AS value FROM magnetic_traces")(
    _trace_query("magnetic"))
registered("j04_hashimoto_traces")(_trace_query("hashimoto"))


@registered("j05_trace_distances", """
    SELECT split_part(a.graph_id, '_', 1) AS speaker, a.graph_id AS a, b.graph_id AS b,
           round(sqrt(sum((a.x - b.x) ** 2)), 6) AS netlsd_distance, round(sqrt(sum((a.y - b.y) ** 2)), 6) AS magnetic_distance
    FROM (SELECT n.graph_id, step, n.value AS x, m.value AS y FROM netlsd_traces n JOIN magnetic_traces m USING (graph_id, step)) a
    JOIN (SELECT n.graph_id, step, n.value AS x, m.value AS y FROM netlsd_traces n JOIN magnetic_traces m USING (graph_id, step)) b
      ON a.step = b.step AND a.graph_id < b.graph_id AND split_part(a.graph_id, '_', 1) = split_part(b.graph_id, '_', 1)
    GROUP BY ALL""")
def trace_distances(spark, sf_dir):
    """Distances of the traces per node; those of the trace per edge are query j09."""
    edges = _speaker_graphs(spark, sf_dir)
    traced = S.traces(edges, ["netlsd", "magnetic"]).withColumn("speaker", F.split("graph_id", "_")[0])
    return S.trace_distances(traced, ["speaker"], ["netlsd", "magnetic"]).select(
        "speaker", "a", "b", *[r6(f"{s}_distance").alias(f"{s}_distance") for s in ("netlsd", "magnetic")])


@registered("j06_similarity_summary")
def similarity_summary(spark, sf_dir):
    return S.summary(_speaker_graphs(spark, sf_dir), ["speaker"])


@registered("j07_extreme_pairs")
def extreme_pairs(spark, sf_dir):
    return S.extremes(S.summary(_speaker_graphs(spark, sf_dir), ["speaker"]), ["speaker"], "js_similarity")


@registered("j08_codes_against_baseline")
def codes_against_baseline(spark, sf_dir):
    """Non-backtracking distance of every dual-node code graph to the non-important graph of
    its speaker's comparison, nearest and farthest three marked."""
    edges = dual_edges(spark, sf_dir)
    speaker = F.when(F.col("speaker").isNotNull(), F.array("speaker")).otherwise(
        F.array(*[F.lit(t) for t in B.TARGETS]))
    keys = edges.select("graph_id", F.explode(speaker).alias("speaker")).distinct()
    traced = S.traces(edges, ["hashimoto"]).join(keys, "graph_id")
    pairs = S.trace_distances(traced, ["speaker"], ["hashimoto"])
    return S.distances_to(pairs, "non_important", ["speaker"], "hashimoto_distance")


@registered("j09_all_code_distances")
def all_code_distances(spark, sf_dir):
    """One distance table over the code graphs of both speakers and the baseline."""
    traced = S.traces(dual_edges(spark, sf_dir), ["hashimoto"]).withColumn("scope", F.lit("all_codes"))
    return S.trace_distances(traced, ["scope"], ["hashimoto"])


@registered("j09_nearest_to_baseline")
def nearest_to_baseline(spark, sf_dir):
    """Code graphs of both speakers nearest to and farthest from the non-important graph."""
    return S.distances_to(
        all_code_distances(spark, sf_dir), "non_important", ["scope"], "hashimoto_distance")


def _scope(edges: DataFrame, name: str) -> DataFrame:
    return edges.select("graph_id", "src", "dst", "weight").withColumn("scope", F.lit(name))


@registered("j10_partition_similarity")
def partition_similarity(spark, sf_dir):
    """Patient, therapist and non-important graphs, and the same with codes in two clusters."""
    edges, baseline = speaker_edges(spark, sf_dir), baseline_edges(spark, sf_dir)
    scoped = reduce(DataFrame.unionByName, [
        _scope(G.pool(edges, F.col("speaker")), "partitions"),
        _scope(baseline, "partitions"),
        _scope(G.pool(edges, _cluster(F.col("speaker"))), "clusters"),
        _scope(baseline, "clusters"),
    ]).withColumn("graph_id", F.concat_ws(":", "scope", "graph_id"))
    return S.summary(scoped, ["scope"])


@registered("j11_therapist_similarity")
def therapist_similarity(spark, sf_dir):
    """Therapists against each other, and each transcript against its therapist."""
    paths = transcript_paths(spark, sf_dir)
    therapist = F.concat(F.lit("therapist_"), L.therapist_before_marker(F.col("graph_id")))
    pooled = G.pool(paths, therapist)
    return S.summary(_scope(pooled, "therapists"), ["scope"], rounded_first=False).unionByName(
        S.against_pool(paths, pooled, therapist, rounded_first=False).withColumn("scope", F.lit("transcripts")))
