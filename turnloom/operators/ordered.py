"""Order-dependent primitives that never put one whole sequence in one task.

A sequence (a transcript, or one class of rows of it) may hold a large share of all rows, so
`Window.partitionBy(source_file)` alone is not safe. Every primitive here works on
`(keys, segment)` where a segment is a fixed range of positions. What crosses a segment edge
travels as copied edge rows (`nearby`, `ahead`) or as one summary row per segment (`carry`).
With `segment_rows=None` the same functions use one window per sequence; choose that only
when the longest sequence has been measured (see `plans.tables`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from turnloom.session import write_table

SEGMENT_ROWS = 1 << 18

WindowExpression = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Ordering:
    """Which rows form a sequence, what orders them, and how long a segment is."""

    keys: tuple[str, ...] = ("source_file",)
    pos: str = "pos"
    segment_rows: int | None = SEGMENT_ROWS

    def keyed(self, *keys: str) -> Ordering:
        return replace(self, keys=keys)

    def by(self, pos: str) -> Ordering:
        return replace(self, pos=pos)

    def segment(self) -> Column:
        return F.floor(F.col(self.pos) / F.lit(self.segment_rows)).cast("long")

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.pos)

    def segment_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_segment").orderBy(self.pos)


def nearby(
    df: DataFrame,
    order: Ordering,
    columns: dict[str, WindowExpression],
    before: int = 0,
    after: int = 0,
    keep_segment: bool = False,
) -> DataFrame:
    """Window expressions that look at most `before` positions back and `after` ahead.

    Positions must be dense. Edge rows are copied into the neighbouring segments they are
    visible from, and dropped again after the window ran. With `keep_segment` a following
    `carry` finds its rows partitioned already.
    """
    if order.segment_rows is None:
        return df.withColumns({name: make(order.window()) for name, make in columns.items()})
    size = F.lit(order.segment_rows)
    first = F.greatest(F.floor((F.col(order.pos) - after) / size), F.lit(0).cast("long"))
    last = F.floor((F.col(order.pos) + before) / size)
    wide = df.withColumn("_segment", F.explode(F.sequence(first, last)))
    w = order.segment_window()
    own = wide.withColumns({name: make(w) for name, make in columns.items()}).filter(
        F.col("_segment") == order.segment())
    return own if keep_segment else own.drop("_segment")


def carry(
    df: DataFrame,
    order: Ordering,
    latest: dict[str, Column] | None = None,
    upcoming: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Unbounded-frame values per row: the latest non-null value at or before it, the first
    non-null value at or after it, and running sums up to and including it.

    One summary row per segment carries the state, so no task sees a whole sequence.
    """
    latest, upcoming, running = latest or {}, upcoming or {}, running or {}
    inputs = {f"_in_{name}": c for group in (latest, upcoming, running) for name, c in group.items()}
    df = df.withColumns(inputs)
    segmented = order.segment_rows is not None
    if segmented:
        if "_segment" not in df.columns:
            df = df.withColumn("_segment", order.segment())
        position = F.col(order.pos)

        def value(name: str) -> Column:
            return F.col(f"_in_{name}")

        at = {n: F.when(value(n).isNotNull(), position) for n in (*latest, *upcoming)}
        summary = df.groupBy(*order.keys, "_segment").agg(
            *[F.max_by(value(n), at[n]).alias(f"_s_{n}") for n in latest],
            *[F.min_by(value(n), at[n]).alias(f"_s_{n}") for n in upcoming],
            *[F.sum(value(n)).alias(f"_s_{n}") for n in running],
        )
        earlier = (
            Window.partitionBy(*order.keys).orderBy("_segment")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        later = (
            Window.partitionBy(*order.keys).orderBy(F.col("_segment").desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        summary = summary.select(
            *order.keys,
            "_segment",
            *[F.last(f"_s_{n}", True).over(earlier).alias(f"_c_{n}") for n in latest],
            *[F.last(f"_s_{n}", True).over(later).alias(f"_c_{n}") for n in upcoming],
            *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}")
              for n in running],
        )
        df = df.join(summary, [*order.keys, "_segment"])
        partition = [*order.keys, "_segment"]
    else:
        partition = list(order.keys)

    forward = (
        Window.partitionBy(*partition).orderBy(order.pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    backward = (
        Window.partitionBy(*partition).orderBy(F.col(order.pos).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def with_carry(name: str, local: Column) -> Column:
        return F.coalesce(local, F.col(f"_c_{name}")) if segmented else local

    out: dict[str, Column] = {}
    for name in latest:
        out[name] = with_carry(name, F.last(f"_in_{name}", True).over(forward))
    for name in upcoming:
        out[name] = with_carry(name, F.last(f"_in_{name}", True).over(backward))
    for name in running:
        local = F.sum(f"_in_{name}").over(forward)
        out[name] = local + F.col(f"_c_{name}") if segmented else local
    df = df.withColumns(out)
    names = (*latest, *upcoming, *running)
    return df.drop("_segment", *[f"_in_{n}" for n in names], *[f"_c_{n}" for n in names])


def overall(df: DataFrame, order: Ordering, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Aggregates of whole sequences on each of their rows: name -> ("min" | "max" | "sum",
    column).

    Per-segment results combine per sequence and return by (keys, segment), so rows of a long
    sequence never meet on its key alone.
    """
    combine = {"min": F.min, "max": F.max, "sum": F.sum}
    if order.segment_rows is None:
        whole = Window.partitionBy(*order.keys)
        return df.withColumns({n: combine[how](c).over(whole) for n, (how, c) in values.items()})
    df = df.withColumn("_segment", order.segment())
    parts = df.groupBy(*order.keys, "_segment").agg(
        *[combine[how](c).alias(n) for n, (how, c) in values.items()])
    whole = Window.partitionBy(*order.keys)
    totals = parts.select(
        *order.keys, "_segment", *[combine[how](n).over(whole).alias(n) for n, (how, _) in values.items()])
    return df.join(totals, [*order.keys, "_segment"]).drop("_segment")


def ahead(
    df: DataFrame,
    order: Ordering,
    reach: int,
    payload: list[str],
    columns: dict[str, WindowExpression],
) -> DataFrame:
    """Window expressions over a row and the next `reach` rows, when positions have gaps.

    Each segment borrows the first `reach` rows that follow it; `payload` names the columns
    the expressions read.
    """
    if order.segment_rows is None:
        return df.withColumns({name: make(order.window()) for name, make in columns.items()})
    df = df.withColumn("_segment", order.segment())
    w = order.segment_window()
    head = (
        df.select(*order.keys, "_segment", order.pos, *payload)
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= reach)
        .groupBy(*order.keys, "_segment")
        .agg(F.sort_array(F.collect_list(F.struct(order.pos, *payload))).alias("_head"))
    )
    following = Window.partitionBy(*order.keys).orderBy("_segment").rowsBetween(1, reach)
    borrowed = (
        head.withColumn("_tail", F.flatten(F.collect_list("_head").over(following)))
        .select(*order.keys, "_segment", F.explode(F.slice("_tail", 1, reach)).alias("_row"))
        .select(*order.keys, "_segment", "_row.*", F.lit(True).alias("_borrowed"))
    )
    wide = df.withColumn("_borrowed", F.lit(False)).unionByName(
        borrowed, allowMissingColumns=True
    )
    return (
        wide.withColumns({name: make(w) for name, make in columns.items()})
        .filter(~F.col("_borrowed"))
        .drop("_segment", "_borrowed")
    )


def renumber(df: DataFrame, order: Ordering, out: str = "pos") -> DataFrame:
    """Dense 0-based positions after rows were dropped."""
    numbered = carry(df, order, running={"_row": F.lit(1).cast("long")})
    return numbered.withColumn(out, F.col("_row") - 1).drop("_row")


def _slice_long_groups(df: DataFrame, keys: list[str], value: Column, out: str, limit: int,
                       exact: bool = False) -> DataFrame:
    """Cut every group of more than `limit` rows into even slices of `value`, or one slice per
    value when `exact`; other groups get slice 0.

    At most (all rows / limit) groups are that long, which bounds the broadcast.
    """
    valued = df.withColumn("_value", value)
    width = (F.col("_to") - F.col("_from") + 1) / (8 * F.ceil(F.col("_n") / limit))
    long_groups = (
        valued.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min("_value").alias("_from"), F.max("_value").alias("_to"))
        .filter((F.col("_n") > limit) & (F.col("_to") > F.col("_from")))
        .select(*keys, "_from", (F.lit(1.0) if exact else width).alias("_width"))
    )
    position = F.floor((F.col("_value") - F.col("_from")) / F.col("_width"))
    return (
        valued.join(F.broadcast(long_groups), keys, "left")
        .withColumn(out, F.coalesce(position, F.lit(0)).cast("long"))
        .drop("_value", "_from", "_width")
    )


def number_by_time(
    df: DataFrame,
    key: str,
    time: str,
    ties: list[str],
    out: str = "pos",
    segment_rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Dense 0-based positions of rows ordered by `time`, then `ties`, inside each key.

    A key with more than `segment_rows` rows is cut into even time slices, a slice that is
    still too long into finer ones, then into single instants, and a crowded instant by the
    first tie-breaker where that is a whole number. Rows are numbered slice by slice.
    """
    if segment_rows is None:
        w = Window.partitionBy(key).orderBy(time, *ties)
        return df.withColumn(out, F.row_number().over(w).cast("long") - 1)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    steps: list[tuple[Column, bool]] = [(micros, False), (micros, False), (micros, True)]
    if ties and isinstance(df.schema[ties[0]].dataType, IntegralType):
        steps.append((F.col(ties[0]).cast("long"), False))
    slices: list[str] = []
    for step, (value, exact) in enumerate(steps):
        df = _slice_long_groups(df, [key, *slices], value, f"_slice{step}", segment_rows, exact)
        slices.append(f"_slice{step}")
    counts = df.groupBy(key, *slices).agg(F.count("*").alias("_rows"))
    earlier = (
        Window.partitionBy(key).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        key, *slices, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(key, *slices).orderBy(time, *ties)
    return (
        df.join(offsets, [key, *slices])
        .withColumn(out, F.row_number().over(local).cast("long") - 1 + F.col("_offset"))
        .drop(*slices, "_offset")
    )


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | None = None,
                  name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` (default: 1) over the earlier rows of their key, which may hold all rows.

    Rows are cut into ranges of (keys, order), which must tell rows of a key apart, and written; a window
    runs inside each range, and another over one total per range and key gives what comes before it.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.columns
    ranged = write_table(spark, "ranges", rows.withColumn("_value", F.lit(1) if value is None else value)
                         .repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_all")).select(
        *keys, "_range", F.coalesce(F.sum("_all").over(ranges), F.lit(0)).alias("_offset"))
    placed = ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return placed.join(totals, [*keys, "_range"]).select(
        *columns, (F.col("_offset") + F.col("_inside")).cast("long").alias(name))
