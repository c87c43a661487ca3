"""Components and shortest paths of all graphs of an edge table at once, by rounds of joins.

Nodes are (graph_id, node) and no graph is ever held by one task. Each function repeats a step that is a
join with the edges and an aggregation; `STEPS` steps go into one job, whose result is written, so
lineage stays short and a lost executor costs one job. The driver sees a count or a checksum a job.
A hub is one key of one side only, the other side being one row per node, so a skewed join can be split.

* `weak`: alternating large and small stars; the number of rounds grows with the logarithm of the size.
* `strong`: nodes without an edge in or out are trimmed; the largest name that reaches a node colours
  it; edges between colours are dropped; what reaches the colour's own node backwards is its component.
  The rest goes round again. Rounds grow with the longest shortest path.
* `total_distances`: breadth-first from all nodes at once. Sources are numbered and 64 of them share a
  long, so a level is a bitwise OR over neighbours; rows grow with nodes * (nodes / 64 + 1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from turnloom.session import write_table

STEPS = 4
NUMBERED = 1 << 16  # nodes of a graph that one window numbers


def _written(df: DataFrame) -> tuple[DataFrame, tuple]:
    """The table written, with its count and a checksum that were taken on the way."""
    seen = Observation()
    hashed = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    table = write_table(df.sparkSession, "reach", df.observe(seen, F.count(F.lit(1)).alias("n"), hashed.alias("sum")))
    return table, (seen.get["n"], seen.get["sum"])


def _until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int) -> DataFrame:
    """Apply `step` until the table no longer changes."""
    (now, state), mark = _written(df), None
    while state != mark:
        mark, after = state, now
        for _ in range(steps):
            after = step(after)
        now, state = _written(after)
    return now


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("graph_id").alias("g"), F.col("src").alias("u"), F.col("dst").alias("v")).filter(
        F.col("u") != F.col("v")).distinct()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("graph_id").alias("g"), F.explode(F.array("src", "dst")).alias("node")).distinct()


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """(g, u, v) with u > v: point the neighbours above a node (large), or the node and those below it
    (small), to the least of all."""
    both = (pairs.unionByName(pairs.select("g", F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs)
    low = both.groupBy("g", "u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    hit = both.join(low, ["g", "u"])
    if large:
        made = hit.filter(F.col("v") > F.col("u")).select("g", F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        made = hit.select("g", F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            low.select("g", "u", F.col("low").alias("v")))
    return made.filter(F.col("u") != F.col("v")).distinct()


def weak(edges: DataFrame, steps: int = 2) -> DataFrame:
    """(graph_id, node, root) of every node; root is the component's least name."""
    pairs = _links(edges).select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = _until_stable(pairs, lambda p: _star(_star(p, True), False), steps)
    return _nodes(edges).join(stars.select("g", F.col("u").alias("node"), F.col("v").alias("root")), ["g", "node"], "left").select(
        F.col("g").alias("graph_id"), "node", F.coalesce("root", "node").alias("root"))


def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose source has a link in and whose end has a link out."""
    entered, left = links.select("g", F.col("v").alias("u")), links.select("g", F.col("u").alias("v"))
    return links.join(entered, ["g", "u"], "left_semi").join(left, ["g", "v"], "left_semi")


def strong(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(graph_id, node, root) of every node; root is one of the component's names."""
    spark = edges.sparkSession
    live, found = _links(edges), []
    while True:
        live = write_table(spark, "live", _trimmed(_trimmed(live)))
        if live.isEmpty():
            break

        def spread(colours: DataFrame, live=live) -> DataFrame:
            passed = live.join(colours.withColumnRenamed("node", "u"), ["g", "u"]).select("g", F.col("v").alias("node"), "colour")
            return colours.unionByName(passed).groupBy("g", "node").agg(F.max("colour").alias("colour"))

        names = live.select("g", F.explode(F.array("u", "v")).alias("node")).distinct()
        colours = _until_stable(names.withColumn("colour", F.col("node")), spread, steps)
        inner = write_table(spark, "inner", live.join(
            colours.select("g", F.col("node").alias("u"), "colour"), ["g", "u"]).join(
            colours.select("g", F.col("node").alias("v"), F.col("colour").alias("other")), ["g", "v"]).filter(
            F.col("colour") == F.col("other")).select("g", "u", "v", "colour"))

        def back(reached: DataFrame, inner=inner) -> DataFrame:
            came = inner.join(reached.select("g", F.col("node").alias("v")), ["g", "v"], "left_semi")
            return reached.unionByName(came.select("g", F.col("u").alias("node"), "colour")).distinct()

        own = _until_stable(colours.filter(F.col("node") == F.col("colour")), back, steps)
        found.append(own)
        gone = own.select("g", "node")
        live = inner.select("g", "u", "v").join(gone.withColumnRenamed("node", "u"), ["g", "u"], "left_anti").join(
            gone.withColumnRenamed("node", "v"), ["g", "v"], "left_anti")
    roots = _nodes(edges).withColumn("colour", F.lit(None).cast("string"))
    for own in found:
        roots = roots.unionByName(own)
    return roots.groupBy("g", "node").agg(F.max("colour").alias("colour")).select(
        F.col("g").alias("graph_id"), "node", F.coalesce("colour", "node").alias("root"))


def total_distances(edges: DataFrame, members: DataFrame, steps: int = STEPS) -> DataFrame:
    """(graph_id, total): the sum of shortest paths, directions ignored, between all ordered pairs of
    `members` (graph_id, node), which must hold whole weak components."""
    sizes = members.groupBy("graph_id").agg(F.ceil(F.count("*") / NUMBERED).alias("parts"))
    order = Window.partitionBy("graph_id", "part").orderBy("node")
    numbered = members.join(sizes, "graph_id").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn(
        "i", F.row_number().over(order) - 1)
    start = numbered.select(
        F.col("graph_id").alias("g"), "node", (F.col("part") * NUMBERED + F.floor(F.col("i") / 64)).alias("block"),
        F.expr("shiftleft(1L, CAST(i % 64 AS int))").alias("seen")).withColumns(
        {"new": F.col("seen"), "far": F.lit(0).cast("long"), "level": F.lit(0).cast("long")})
    links = _links(edges)
    arcs = write_table(edges.sparkSession, "arcs", links.unionByName(
        links.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    none = F.lit(0).cast("long")

    def level(state: DataFrame) -> DataFrame:
        passed = state.filter("new != 0").withColumnRenamed("node", "u").join(arcs, ["g", "u"]).select(
            "g", F.col("v").alias("node"), "block", none.alias("seen"), "new", none.alias("far"), "level")
        kept = state.withColumn("new", none)
        merged = kept.unionByName(passed).groupBy("g", "node", "block").agg(
            F.bit_or("seen").alias("seen"), F.bit_or("new").alias("came"), F.sum("far").alias("far"),
            (F.max("level") + 1).alias("level"))
        fresh = F.col("came").bitwiseAND(F.bitwise_not("seen"))
        return merged.select("g", "node", "block", F.col("seen").bitwiseOR(F.col("came")).alias("seen"), fresh.alias("new"),
                             (F.col("far") + F.col("level") * F.bit_count(fresh)).alias("far"), "level")

    spark = edges.sparkSession
    state = write_table(spark, "levels", start)
    while not state.filter("new != 0").isEmpty():
        for _ in range(steps):
            state = level(state)
        state = write_table(spark, "levels", state)
    return state.groupBy(F.col("g").alias("graph_id")).agg(F.sum("far").alias("total"))
