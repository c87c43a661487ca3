"""The k most similar items of other owners by Jensen-Shannon divergence, without all pairs.

The square root of the divergence is a metric, so distances to a few pivots bound all others.
Items with the same shares are one class and are compared once. Classes go to the cell of
their nearest pivot; the items nearest to each pivot bound how far a class has to look, and
the triangle inequality leaves the cells, and the rings of a cell, that can hold an answer.
Only those meet, and their divergence is computed exactly from shared features.

What grows: one row per item and pivot, k rows per item in the result, and the candidates.
How many candidates are left depends on how well the pivots separate the classes; nothing is
cut off, so results are those of a comparison with every item. Where fewer than k + 1 owners
exist for a key, nothing bounds the search and all classes of the key meet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import write_table

PIVOTS = 32
RING = 0.02
DECIMALS = 4
FARTHEST = math.log(2.0)
# divergences that round to the same value differ by no more than this
TIE = 1.1 * 10.0 ** -DECIMALS
# room for rounding errors of distances, sqrt(1e-15) is 3e-8
SLACK = 1e-6


def common(p: Column, q: Column) -> Column:
    """What a feature two sides share takes off the largest divergence, ln 2."""
    return 0.5 * (p * F.log((p + q) / p) + q * F.log((p + q) / q))


def distribution_classes(counts: DataFrame, keys: Sequence[str], owner: str, item: str,
                         feature: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(members, shares): the class of each item and the shares of each class.

    Equal rationals give equal doubles, so proportional counts are one class.
    """
    keys = list(keys)
    per_item = counts.groupBy(*keys, owner, item).agg(
        F.sum(value).alias("size"),
        F.sort_array(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).alias("v")))).alias("_counts"))
    shares = F.transform("_counts", lambda x: F.struct(x["f"].alias("f"), (x["v"] / F.col("size")).alias("p")))
    members = write_table(counts.sparkSession, "members", per_item.withColumn("_shares", shares).select(
        *keys, owner, item, "size", F.sha2(F.to_json("_shares"), 256).alias("class"), "_shares"))
    classes = members.groupBy(*keys, "class").agg(F.first("_shares").alias("_shares"))
    return (members.drop("_shares"),
            classes.select(*keys, "class", F.inline("_shares")).withColumnsRenamed({"f": "feature", "p": "share"}))


def first_of_owners(rows: DataFrame, keys: Sequence[str], owner: str, order: Sequence[str], k: int) -> DataFrame:
    """What is left holds, whichever one owner is left out, the first k rows of a key."""
    own = Window.partitionBy(*keys, owner).orderBy(*order)
    best = rows.withColumn("_own", F.row_number().over(own)).filter(F.col("_own") <= k)
    owners = best.filter(F.col("_own") == 1).withColumn(
        "_owner", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_owner") <= k + 1)
    return best.join(owners.select(*keys, owner), [*keys, owner], "left_semi").drop("_own")


def _pivot_distances(shares: DataFrame, keys: list[str], pivots: int) -> DataFrame:
    """One row per class: distances to the pivots, its cell and its distance to the cell's."""
    classes = shares.select(*keys, "class").distinct()
    chosen = classes.withColumn("pivot", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.xxhash64("class"), "class"))).filter(F.col("pivot") <= pivots)
    of_pivots = shares.join(chosen, [*keys, "class"]).select(*keys, "feature", "pivot", F.col("share").alias("_q"))
    met = (
        shares.join(of_pivots, [*keys, "feature"])
        .groupBy(*keys, "class", "pivot").agg(F.sum(common(F.col("share"), F.col("_q"))).alias("common"))
        .groupBy(*keys, "class").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "common"))).alias("_met"))
    )

    def distance(pivot: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), FARTHEST - F.coalesce(F.col("_met")[pivot], F.lit(0.0))))

    numbers = F.sequence(F.lit(1), F.lit(pivots))
    return (
        classes.join(met, [*keys, "class"], "left")
        .withColumn("_d", F.transform(numbers, distance))
        .withColumn("own", F.array_min("_d"))
        .withColumn("cell", F.array_position("_d", F.col("own")).cast("int"))
        .drop("_met")
    )


def _cells(placed: DataFrame, members: DataFrame, keys: list[str], owner: str, k: int) -> DataFrame:
    """One row per key with its cells: the least and greatest distance, and the nearest entries
    of k + 1 owners. At most `PIVOTS` cells of bounded size."""
    extent = placed.groupBy(*keys, "cell").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    entries = (
        members.select(*keys, "class", owner).distinct()
        .join(placed.select(*keys, "class", "cell", "own"), [*keys, "class"])
        .groupBy(*keys, "cell", owner).agg(F.min("own").alias("own"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("own", owner)))
        .filter(F.col("_rank") <= k + 1)
        .groupBy(*keys, "cell").agg(F.collect_list(F.struct("own", F.col(owner).alias("owner"))).alias("seeds"))
    )
    return extent.join(entries, [*keys, "cell"]).groupBy(*keys).agg(
        F.collect_list(F.struct("cell", "low", "high", "seeds")).alias("_cells"))


def candidates(members: DataFrame, shares: DataFrame, keys: Sequence[str], owner: str, k: int,
               pivots: int = PIVOTS, ring: float = RING) -> DataFrame:
    """Pairs of classes (`a` asks, `b` may answer) that the bounds leave; a class is its own
    candidate."""
    keys = list(keys)
    placed = write_table(shares.sparkSession, "pivot_distances", _pivot_distances(shares, keys, pivots))
    cells = _cells(placed, members, keys, owner, k)

    def to(cell: Column) -> Column:
        return F.col("_d")[cell["cell"] - 1]

    bounds = F.array_sort(F.flatten(F.transform("_cells", lambda c: F.transform(
        c["seeds"], lambda s: F.struct((to(c) + s["own"]).alias("bound"), s["owner"].alias("owner"))))))
    nearest_owners = F.array_distinct(F.transform("_bounds", lambda b: b["owner"]))
    # the first k + 1 owners stand for k others, whoever asks
    last = F.try_element_at("_owners", F.lit(k + 1))
    bound = F.get(F.filter("_bounds", lambda b: b["owner"] == F.col("_last")), F.lit(0))["bound"]
    reach = F.sqrt(F.coalesce(F.pow(F.col("_bound"), 2), F.lit(FARTHEST)) + TIE) + SLACK

    def open_cell(c: Column) -> Column:
        return (
            (to(c) - c["high"] <= F.col("_reach")) & (c["low"] - to(c) <= F.col("_reach"))
            & (to(c) - F.col("own") <= 2.0 * F.col("_reach")))

    def rings(c: Column) -> Column:
        first = F.floor(F.greatest(c["low"], to(c) - F.col("_reach")) / ring)
        final = F.floor(F.least(c["high"], to(c) + F.col("_reach")) / ring)
        return F.transform(F.sequence(first, F.greatest(first, final)), lambda r: F.struct(
            c["cell"].alias("cell"), r.alias("ring")))

    asking = (
        placed.join(cells, keys)
        .withColumn("_bounds", bounds).withColumn("_owners", nearest_owners).withColumn("_last", last)
        .withColumn("_bound", bound).withColumn("_reach", reach)
        .select(*keys, F.col("class").alias("a"), F.col("_d").alias("_da"), "_reach", F.explode(
            F.flatten(F.transform(F.filter("_cells", open_cell), rings))).alias("_at"))
        .select(*keys, "a", "_da", "_reach", "_at.*")
    )
    answering = placed.select(
        *keys, F.col("class").alias("b"), F.col("_d").alias("_db"), "cell", F.floor(F.col("own") / ring).alias("ring"))
    within = F.forall(F.zip_with("_da", "_db", lambda x, y: F.abs(x - y)), lambda gap: gap <= F.col("_reach"))
    return asking.join(answering, [*keys, "cell", "ring"]).filter(within).select(*keys, "a", "b")


def nearest(counts: DataFrame, keys: Sequence[str], owner: str, item: str, feature: str, value: str,
            k: int, pivots: int = PIVOTS, ring: float = RING) -> DataFrame:
    """For each (owner, item) of a key the k least divergent items of other owners.

    keys, owner, item, size, `rank` from 1, `other_owner`, `other_item`, `other_size`, `js`
    (natural log, not rounded). Divergences equal to four digits are ties, settled by owner and
    item. Input is one row per (keys, owner, item, feature) with a positive count.
    """
    keys = list(keys)
    members, shares = distribution_classes(counts, keys, owner, item, feature, value)
    shares = write_table(counts.sparkSession, "class_shares", shares)
    pairs = write_table(
        counts.sparkSession, "class_pairs", candidates(members, shares, keys, owner, k, pivots, ring))

    def side(name: str, share: str) -> DataFrame:
        return shares.select(*keys, F.col("class").alias(name), "feature", F.col("share").alias(share))

    met = (
        pairs.join(side("a", "_p"), [*keys, "a"]).join(side("b", "_q"), [*keys, "b", "feature"])
        .groupBy(*keys, "a", "b").agg(F.sum(common(F.col("_p"), F.col("_q"))).alias("_common"))
    )
    divergence = F.greatest(F.lit(0.0), FARTHEST - F.coalesce(F.col("_common"), F.lit(0.0)))
    scored = pairs.join(met, [*keys, "a", "b"], "left").withColumn(
        "js", F.when(F.col("a") == F.col("b"), 0.0).otherwise(divergence)).drop("_common")

    named = members.withColumnsRenamed({owner: "other_owner", item: "other_item", "size": "other_size"})
    speakers = first_of_owners(named, [*keys, "class"], "other_owner", ["other_owner", "other_item"], k)
    order = ["_tie", "other_owner", "other_item"]
    answers = first_of_owners(
        scored.join(speakers.withColumnRenamed("class", "b"), [*keys, "b"]).withColumn("_tie", F.round("js", DECIMALS)),
        [*keys, "a"], "other_owner", order, k)
    # at most k * (k + 1) answers of a class
    lists = answers.groupBy(*keys, F.col("a").alias("class")).agg(F.sort_array(F.collect_list(F.struct(
        *order, "other_size", "js"))).alias("_answers"))
    others = F.slice(F.filter("_answers", lambda x: x["other_owner"] != F.col(owner)), 1, k)
    return (
        members.join(lists, [*keys, "class"])
        .select(*keys, owner, item, "size", F.posexplode(others).alias("_rank", "_other"))
        .select(*keys, owner, item, "size", (F.col("_rank") + 1).alias("rank"), "_other.other_owner",
                "_other.other_item", "_other.other_size", "_other.js")
    )
