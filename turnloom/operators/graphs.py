"""Transition graphs as edge tables `(graph_id, src, dst, weight)` and their metrics.

Edges are counted with map-side aggregation, so the number of rows behind a graph does not
matter. Degrees, triangles, components and paths are joins over the edge table (`reach`), for graphs
of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators import ngrams as N
from turnloom.operators import reach
from turnloom.operators.ordered import Ordering, carry, running_total
from turnloom.session import write_table

NODE_SEPARATOR = "→"


def edges_from(counts: DataFrame, k: int = 1) -> DataFrame:
    """Order-k edges from n-gram counts: the first k labels of a (k+1)-gram are the source
    node, the last k the destination, and the count is the weight."""
    parts = F.split("ngram", N.SEPARATOR)
    node = lambda first: F.array_join(F.slice(parts, first, k), NODE_SEPARATOR)
    return (
        counts.filter(F.col("n") == k + 1)
        .withColumns({"src": node(1), "dst": node(2)})
        .withColumnRenamed("cnt", "weight")
        .drop("n", "ngram")
    )


def prune(edges: DataFrame, min_weight: int) -> DataFrame:
    """Drop rare edges. Nodes are the endpoints of the rest, so isolated ones go too."""
    return edges.filter(F.col("weight") >= min_weight)


def nodes(edges: DataFrame, *by: str) -> DataFrame:
    ends = F.explode(F.array(F.col("src"), F.col("dst")))
    return edges.select(*by, ends.alias("node")).distinct()


def alternate_visits(rows: DataFrame, order: Ordering, *by: str) -> DataFrame:
    """Dual-node labels: the 1st, 3rd, ... visit of a label in a sequence is `<label>_a`, the
    others `<label>_b`."""
    visits = order.keyed(*by, "seq", "label")
    counted = carry(rows, visits, running={"_visit": F.lit(1).cast("long")})
    slot = F.when(F.col("_visit") % 2 == 1, "_a").otherwise("_b")
    return counted.withColumn("label", F.concat("label", slot)).drop("_visit")


class PathWalker:
    """Walks the labels of one sequence and yields its dual-node edges.

    A step whose reverse edge exists already moves to the other node of the label, unless
    that would reverse an edge as well; later visits then alternate from there.
    """

    def __init__(self, known: set[tuple[str, str]]):
        self._known = known
        self._turn: dict[str, int] = {}
        self._at: str | None = None

    def step(self, label: str) -> tuple[str, str] | None:
        slot = self._turn.get(label, 0)
        node = f"{label}_{'ab'[slot]}"
        previous = self._at
        if previous is not None and (node, previous) in self._known:
            other = f"{label}_{'ab'[1 - slot]}"
            if (other, previous) not in self._known:
                slot, node = 1 - slot, other
        self._turn[label] = 1 - slot
        self._at = node
        return None if previous is None else (previous, node)


def _walk_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edge counts of each chunk. A chunk's rows begin with the edges known before it (no label);
    then its sequences follow in order, and each one's edges are known to the next."""
    names = ["graph_id", "chunk", "src", "dst", "weight"]
    chunk = sequence = walker = None
    known: set[tuple[str, str]] = set()
    fresh: set[tuple[str, str]] = set()
    weights: dict[tuple[str, str], int] = {}

    def made() -> pd.DataFrame:
        return pd.DataFrame([(*chunk, *edge, n) for edge, n in weights.items()], columns=names)

    for batch in batches:
        for graph, number, source, seq, label, src, dst in zip(*(batch[c] for c in (
                "graph_id", "chunk", "source_file", "seq", "label", "src", "dst"))):
            if chunk != (graph, number):
                if weights:
                    yield made()
                chunk, sequence, walker, known, fresh, weights = (graph, number), None, None, set(), set(), {}
            if label is None:
                known.add((src, dst))
                continue
            if sequence != (source, seq):
                sequence = (source, seq)
                known |= fresh
                fresh, walker = set(), PathWalker(known)
            edge = walker.step(label)
            if edge is not None:
                fresh.add(edge)
                weights[edge] = weights.get(edge, 0) + 1
    if weights:
        yield made()


def path_edges(rows: DataFrame, chunk: int = 1000, salts: int = 16) -> DataFrame:
    """Dual-node edge counts with antiparallel avoidance, sequences taken in the order of
    (source_file, seq).

    A sequence depends on earlier ones only through which edges exist. Sequences are numbered along
    their graph and cut into chunks of `chunk`. Of every graph the chunks up to `upto` are done; as many
    chunks again are walked in parallel, each from the edges of the done ones. The first chunk that makes
    a new edge is right, as are those before it, which made none; those after it are walked again with its
    edges. So a round doubles what is done of a graph or finds a new edge of it, and a graph has at most
    (2 * labels)^2 edges, the only state a walk holds.
    """
    spark = rows.sparkSession
    by = ["graph_id", "source_file", "seq"]
    rows = write_table(spark, "path_rows", rows.select(*by, "pos", "label"))
    number = running_total(rows.select(*by).distinct(), by[:1], by[1:], name="chunk")
    rows = write_table(spark, "path_chunks", rows.join(
        number.withColumn("chunk", F.floor(F.col("chunk") / chunk)), by))
    none = F.lit(None).cast("string")
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    end = F.least(F.col("last"), 2 * F.col("upto") + 2)
    edges = spark.createDataFrame([], "graph_id string, src string, dst string, weight long")
    graphs = write_table(spark, "path_done", rows.groupBy("graph_id").agg(F.max("chunk").alias("last")).withColumn(
        "upto", F.lit(-1).cast("long")))
    while True:
        live = graphs.filter("upto < last")
        low, high = live.agg(F.min("upto"), F.max(end)).first()
        if low is None:
            return edges
        todo = live.select("graph_id", F.explode(F.sequence(F.col("upto") + 1, end)).alias("chunk"))
        before = todo.withColumn("salt", F.col("chunk") % salts).join(edges.withColumn("salt", salt), ["graph_id", "salt"])
        given = before.select("graph_id", "chunk", none.alias("source_file"), F.lit(None).cast("long").alias("seq"),
                              F.lit(None).cast("long").alias("pos"), none.alias("label"), "src", "dst")
        own = rows.filter((F.col("chunk") > low) & (F.col("chunk") <= high)).join(
            todo, ["graph_id", "chunk"], "left_semi").select(*given.columns[:-2], none.alias("src"), none.alias("dst"))
        ordered = given.unionByName(own).repartition("graph_id", "chunk").sortWithinPartitions(
            "graph_id", "chunk", F.col("source_file").asc_nulls_first(), F.col("seq").asc_nulls_first(), "pos")
        walked = write_table(spark, "path_walked", ordered.mapInPandas(
            _walk_chunks, "graph_id string, chunk long, src string, dst string, weight long"))
        new = walked.join(edges, ["graph_id", "src", "dst"], "left_anti").groupBy("graph_id").agg(F.min("chunk").alias("new"))
        graphs = write_table(spark, "path_done", graphs.join(new, "graph_id", "left").select(
            "graph_id", "last", F.coalesce("new", end).alias("upto")))
        right = walked.join(graphs, "graph_id").filter(F.col("chunk") <= F.col("upto")).select(*edges.columns)
        edges = write_table(spark, "path_edges", edges.unionByName(right).groupBy("graph_id", "src", "dst").agg(
            F.sum("weight").alias("weight")))


def pool(edges: DataFrame, pool_id: Column) -> DataFrame:
    """Merge graphs by summing weights; rows whose pool is null are left out."""
    return (
        edges.withColumn("graph_id", pool_id).filter(F.col("graph_id").isNotNull())
        .groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("weight"))
    )


def transition_vectors(edges: DataFrame) -> DataFrame:
    """Each edge's share of its graph's weight."""
    totals = edges.groupBy("graph_id").agg(F.sum("weight").alias("_all"))
    return edges.join(totals, "graph_id").withColumn("share", F.col("weight") / F.col("_all")).drop("_all")


def sizes(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges and density e / (n (n - 1)) per graph."""
    n_nodes = nodes(edges, "graph_id").groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    n_edges = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    n, e = F.col("n_nodes"), F.col("n_edges")
    return n_nodes.join(n_edges, "graph_id").withColumn(
        "density", F.when(n > 1, e / (n * (n - 1))).otherwise(0.0))


def degrees(edges: DataFrame) -> DataFrame:
    """Mean in/out degree and the node with the largest one, ties to the smaller name."""
    ends = F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    ))
    per_node = edges.select("graph_id", ends).groupBy("graph_id", "node").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    top = lambda degree: F.min_by("node", F.struct(-F.col(degree), F.col("node")))
    return per_node.groupBy("graph_id").agg(
        F.avg("in_degree").alias("mean_in_degree"),
        F.avg("out_degree").alias("mean_out_degree"),
        top("in_degree").alias("max_in_degree_node"),
        top("out_degree").alias("max_out_degree_node"),
    )


def clustering(edges: DataFrame) -> DataFrame:
    """Average clustering coefficient of the undirected graph.

    Each link points from the end of lower degree to the higher one, so no node has more than
    sqrt(2 m) links out and the wedges that are tested stay below m^1.5, hubs included. A triangle
    is met once, at its lowest corner, and counts for all three.
    """
    undirected = edges.filter(F.col("src") != F.col("dst")).select(
        "graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    degree = undirected.select("graph_id", F.explode(F.array("u", "v")).alias("node")).groupBy(
        "graph_id", "node").agg(F.count("*").alias("_degree"))
    rank = lambda name: degree.select(
        "graph_id", F.col("node").alias(name), F.struct("_degree", "node").alias(f"_{name}"))
    ranked = undirected.join(rank("u"), ["graph_id", "u"]).join(rank("v"), ["graph_id", "v"])
    pointed = write_table(edges.sparkSession, "pointed", ranked.select(
        "graph_id", F.least("_u", "_v").alias("low"), F.greatest("_u", "_v").alias("high")))
    to = lambda name: pointed.select("graph_id", "low", F.col("high").alias(name))
    wedges = to("a").join(to("b"), ["graph_id", "low"]).filter(F.col("a") < F.col("b"))
    closed = wedges.join(pointed.select("graph_id", F.col("low").alias("a"), F.col("high").alias("b")),
                         ["graph_id", "a", "b"], "left_semi")
    corners = closed.select("graph_id", F.explode(F.array("low.node", "a.node", "b.node")).alias("node")).groupBy(
        "graph_id", "node").agg(F.count("*").alias("_triangles"))
    d, t = F.col("_degree"), F.coalesce(F.col("_triangles"), F.lit(0))
    return (
        degree.join(corners, ["graph_id", "node"], "left")
        .groupBy("graph_id")
        .agg(F.avg(F.when(d > 1, 2 * t / (d * (d - 1))).otherwise(0.0)).alias("clustering_coeff"))
    )


def components(edges: DataFrame) -> DataFrame:
    """Weak and strong components and the mean shortest path of the largest weak one (of equal
    ones that with the least name)."""
    spark = edges.sparkSession
    edges = write_table(spark, "component_edges", edges.select("graph_id", "src", "dst"))
    weak = write_table(spark, "weak", reach.weak(edges))
    held = weak.groupBy("graph_id", "root").agg(F.count("*").alias("m"))
    largest = held.groupBy("graph_id").agg(
        F.count("*").alias("n_weak"), F.sum("m").alias("_nodes"),
        F.min_by("root", F.struct(-F.col("m"), F.col("root"))).alias("root"), F.max("m").alias("_m"))
    members = weak.join(largest.filter(F.col("_m") > 1).select("graph_id", "root"), ["graph_id", "root"]).select("graph_id", "node")
    strong = reach.strong(edges).groupBy("graph_id", "root").agg(F.count("*").alias("m")).groupBy("graph_id").agg(
        F.count("*").alias("n_strong"), F.max("m").alias("_s"))
    totals = reach.total_distances(edges, members)
    return write_table(spark, "components", largest.join(strong, "graph_id").join(totals, "graph_id", "left").select(
        "graph_id", "n_weak", "n_strong", (F.col("_m") / F.col("_nodes")).alias("largest_weak_frac"),
        (F.col("_s") / F.col("_nodes")).alias("largest_strong_frac"),
        (F.col("total") / (F.col("_m") * (F.col("_m") - 1))).alias("avg_shortest_path")))


def top_edges(edges: DataFrame, top: int = 3) -> DataFrame:
    """The heaviest edges side by side, blank where a graph has fewer; ties by name."""
    w = Window.partitionBy("graph_id").orderBy(F.col("weight").desc(), "src", "dst")
    ranked = edges.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top)
    pick = lambda rank, c: F.max(F.when(F.col("_rank") == rank, c))
    return ranked.groupBy("graph_id").agg(*[
        column
        for rank in range(1, top + 1)
        for column in (
            F.coalesce(pick(rank, F.concat_ws(" -> ", "src", "dst")), F.lit("")).alias(f"top_edge_{rank}"),
            pick(rank, F.col("weight")).alias(f"top_edge_{rank}_weight"),
        )
    ])


def metrics(edges: DataFrame) -> DataFrame:
    """All structural metrics, one row per graph."""
    out = sizes(edges)
    for part in (degrees(edges), clustering(edges), components(edges), top_edges(edges)):
        out = out.join(part, "graph_id")
    return write_table(edges.sparkSession, "graph_metrics", out)


def heavy_edges(edges: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Edges at or above a weight percentile of their graph, and weight over the maximum."""
    limits = edges.groupBy("graph_id").agg(
        F.percentile("weight", quantile).alias("threshold"), F.max("weight").alias("_top"))
    return (
        edges.join(limits, "graph_id")
        .withColumns({"relative_weight": F.col("weight") / F.col("_top"),
                      "heavy": F.col("weight") >= F.col("threshold")})
        .drop("_top")
    )


def node_attributes(edges: DataFrame, run_lengths: DataFrame) -> DataFrame:
    """Total outgoing weight per node and the mean run length of its last label.

    `run_lengths` has graph_id, label, mean_run_length; dual-node suffixes are ignored.
    """
    outgoing = edges.groupBy("graph_id", F.col("src").alias("node")).agg(
        F.sum("weight").alias("out_weight"))
    last = F.element_at(F.split("node", NODE_SEPARATOR), -1)
    return (
        nodes(edges, "graph_id").join(outgoing, ["graph_id", "node"], "left")
        .fillna(0, ["out_weight"])
        .withColumn("label", F.regexp_replace(last, "_[ab]$", ""))
        .join(run_lengths, ["graph_id", "label"], "left")
    )
