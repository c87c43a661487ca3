"""Similarity of transition graphs: shared transitions and spectra."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import spectra
from turnloom.operators import pairs as P

SPECTRA = ("netlsd", "magnetic", "hashimoto")


def _moment_traces(edges: DataFrame) -> DataFrame:
    """netlsd and magnetic of every graph. A task holds the links of one graph and one block of unit
    vectors; the moments of a graph's blocks are summed."""
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    blocks = nodes.groupBy("graph_id").agg(F.ceil(F.count("*") / spectra.BLOCK).cast("int").alias("_blocks"))
    dealt = edges.join(blocks, "graph_id").select(
        "graph_id", "src", "dst", "weight", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    found = dealt.groupBy("graph_id", "block").applyInPandas(
        spectra.block_moments, "graph_id string, n long, plain array<double>, turned array<double>")
    summed = found.groupBy("graph_id").agg(F.max("n").alias("n"), *[
        F.array(*[F.sum(F.col(kind)[k]) for k in range(spectra.MOMENTS)]).alias(kind) for kind in ("plain", "turned")])

    def heat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"graph_id": pdf["graph_id"], **{
                name: [spectra.traces_of(np.asarray(x), n) for x, n in zip(pdf[kind], pdf["n"])]
                for name, kind in (("netlsd", "plain"), ("magnetic", "turned"))}})

    return summed.mapInPandas(heat, "graph_id string, netlsd array<double>, magnetic array<double>")


def traces(edges: DataFrame, kinds: Sequence[str] = SPECTRA) -> DataFrame:
    """Heat traces of every graph."""
    edges = edges.select("graph_id", "src", "dst", "weight")
    parts = []
    if set(kinds) & {"netlsd", "magnetic"}:
        parts.append(_moment_traces(edges))
    if "hashimoto" in kinds:
        parts.append(edges.groupBy("graph_id").applyInPandas(
            spectra.hashimoto_traces, "graph_id string, hashimoto array<double>"))
    out = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "graph_id")
    return out.select("graph_id", *kinds)


def l2_distance(x: Column, y: Column) -> Column:
    squares = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def edge_divergence(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of transition vectors, over the edges the graphs
    of a key have in union."""
    features = edges.withColumn("_edge", F.concat_ws(" -> ", "src", "dst"))
    return P.frequency_divergence(features, keys, "graph_id", "_edge", "weight")


def trace_distances(traced: DataFrame, keys: Sequence[str],
                    kinds: Sequence[str] = SPECTRA) -> DataFrame:
    pairs = P.all_pairs(traced, keys, "graph_id", *kinds)
    return pairs.select(
        *keys, "a", "b",
        *[l2_distance(F.col(f"{s}_a"), F.col(f"{s}_b")).alias(f"{s}_distance") for s in kinds])


def similarity_of(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def agreement(js: Column, magnetic: Column, hashimoto: Column) -> Column:
    """What the shared-transition and the directed spectral similarities say together."""
    directed = (magnetic + hashimoto) / 2
    return (
        F.when((js > 0.7) & (directed > 0.7), "both_similar")
        .when((js < 0.4) & (directed < 0.4), "both_different")
        .when((js > 0.6) & (directed < 0.5), "same_transitions_diff_direction")
        .when((js < 0.5) & (directed > 0.6), "diff_transitions_same_topology")
        .when(F.abs(magnetic - hashimoto) > 0.25, "directed_methods_disagree")
        .otherwise("mixed")
    )


def summary(edges: DataFrame, keys: Sequence[str], rounded_first: bool = True,
            traced: DataFrame | None = None) -> DataFrame:
    """All four similarities of each pair of graphs sharing a key, with the agreement flag.

    `edges` carries the key columns; a graph id belongs to one key unless `traced` has the
    traces of all graphs. Scores are rounded to four digits before the flag is set unless
    `rounded_first` is off.
    """
    key_of = edges.select(*keys, "graph_id").distinct()
    traced = (traces(edges) if traced is None else traced).join(key_of, "graph_id")
    scores = (
        edge_divergence(edges, keys).join(trace_distances(traced, keys), [*keys, "a", "b"])
        .withColumns({
            "js_similarity": 1.0 - F.col("js"),
            **{f"{s}_similarity": similarity_of(F.col(f"{s}_distance")) for s in SPECTRA},
        })
    )
    exact = [f"{m}_similarity" for m in ("js", *SPECTRA)]
    shown = {name: F.round(name, 4) for name in exact}
    used = {name: shown[name] if rounded_first else F.col(name) for name in exact}
    flag = agreement(
        used["js_similarity"], used["magnetic_similarity"], used["hashimoto_similarity"])
    return scores.select(
        *keys, "a", "b",
        *[shown[name].alias(name) for name in exact],
        F.round(1.0 - (shown["js_similarity"] if rounded_first else F.col("js_similarity")), 4)
        .alias("js_divergence"),
        flag.alias("agreement"),
    )


def extremes(scores: DataFrame, keys: Sequence[str], value: str, top: int = 3) -> DataFrame:
    """The `top` most and least similar pairs per key, ties by name."""
    parts = []
    for kind, direction in (("most", F.col(value).desc()), ("least", F.col(value).asc())):
        w = Window.partitionBy(*keys).orderBy(direction, "a", "b")
        parts.append(
            scores.withColumns({"rank": F.row_number().over(w), "kind": F.lit(kind)})
            .filter(F.col("rank") <= top))
    return parts[0].unionByName(parts[1])


def distances_to(pairs: DataFrame, baseline: str, keys: Sequence[str], value: str,
                 top: int = 3) -> DataFrame:
    """Distance of each graph to the baseline graph, with ranks from both ends."""
    other = F.when(F.col("a") == baseline, F.col("b")).otherwise(F.col("a"))
    rows = pairs.filter((F.col("a") == baseline) | (F.col("b") == baseline)).select(
        *keys, other.alias("graph_id"), F.col(value).alias("distance"))
    near = Window.partitionBy(*keys).orderBy(F.round("distance", 9), "graph_id")
    far = Window.partitionBy(*keys).orderBy(F.round("distance", 9).desc(), "graph_id")
    ranked = rows.withColumns({
        "nearest": F.row_number().over(near), "farthest": F.row_number().over(far)})
    return ranked.withColumns({
        "nearest": F.col("nearest") <= top, "farthest": F.col("farthest") <= top})


def against_pool(edges: DataFrame, pooled: DataFrame, pool: Column, rounded_first: bool = True) -> DataFrame:
    """`summary` of each graph and the pooled graph that `pool` names: one row per graph."""
    columns = ["graph_id", "src", "dst", "weight"]
    pair = edges.select(F.col("graph_id").alias("pair"), pool.alias("graph_id")).distinct()
    both = edges.select(F.col("graph_id").alias("pair"), *columns).unionByName(
        pair.join(pooled.select(*columns), "graph_id").select("pair", *columns))
    traced = traces(edges.select(*columns).unionByName(pooled.select(*columns)))
    return summary(both, ["pair"], rounded_first, traced).drop("pair")
