"""Islands, important blocks, their context, and the sequences cut from transcripts.

`index_islands` stores, on every row, the first and last position of each island the row
lies in. After that one pass, blocks, run lengths, run-length compression and fixed-size
windows are row-local expressions or plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators.ordered import Ordering, carry, nearby

CONTEXT_ROWS = 15
TARGETS = ("patient", "therapist")


def islands(df: DataFrame, order: Ordering, names: dict[str, Column]) -> DataFrame:
    """Add `<name>_start` and `<name>_end`: the run of equal non-null values around a row."""
    df = df.withColumns({f"_k_{n}": c for n, c in names.items()})
    edges = {}
    for n in names:
        edges[f"_p_{n}"] = lambda w, n=n: F.lag(f"_k_{n}").over(w)
        edges[f"_n_{n}"] = lambda w, n=n: F.lead(f"_k_{n}").over(w)
    df = nearby(df, order, edges, before=1, after=1, keep_segment=True)
    pos = F.col(order.pos)

    def edge(n: str, side: str) -> Column:
        key = F.col(f"_k_{n}")
        return F.when(key.isNotNull() & ~key.eqNullSafe(F.col(f"_{side}_{n}")), pos)

    df = carry(
        df,
        order,
        latest={f"{n}_start": edge(n, "p") for n in names},
        upcoming={f"{n}_end": edge(n, "n") for n in names},
    )
    inside = {
        f"{n}_{side}": F.when(F.col(f"_k_{n}").isNotNull(), F.col(f"{n}_{side}"))
        for n in names
        for side in ("start", "end")
    }
    helpers = [f"_{prefix}_{n}" for n in names for prefix in ("k", "p", "n")]
    return df.withColumns(inside).drop(*helpers)


def is_important(target: str) -> Column:
    return F.coalesce(F.col(f"{target}_important").cast("int"), F.lit(0)) == 1


def index_islands(da: DataFrame, order: Ordering) -> DataFrame:
    """Dialogue-act rows with the bounds of every island kind the analyses cut by."""
    patient, therapist = is_important("patient"), is_important("therapist")
    return islands(
        da,
        order,
        {
            "patient": F.when(patient, 1),
            "therapist": F.when(therapist, 1),
            "either": F.when(patient | therapist, 1),
            "neither": F.when(~(patient | therapist), 1),
            "patient_rest": F.when(~patient, 1),
            "therapist_rest": F.when(~therapist, 1),
            "group": F.coalesce(F.col("da_group"), F.lit("")),
            "label": F.coalesce(F.col("proc_da"), F.lit("")),
        },
    )


def unclaimed(da: DataFrame, order: Ordering, context: int) -> DataFrame:
    """Rows outside every important block and outside `context` rows around one, with the
    island they form as `free_start` and `free_end`."""
    flag = F.when(is_important("patient") | is_important("therapist"), 1).otherwise(0)
    marked = nearby(
        da.withColumn("_flag", flag),
        order,
        {"_claimed": lambda w: F.max("_flag").over(w.rowsBetween(-context, context))},
        before=context,
        after=context,
    )
    free = islands(marked, order, {"free": F.when(F.col("_claimed") == 0, 1)})
    return free.filter(F.col("free_start").isNotNull()).drop("_flag", "_claimed")


def sequence_rows(hub: DataFrame, kind: str) -> DataFrame:
    """Rows of every sequence of one kind, with `seq` (first position) and `seq_end`.

    Kinds are the islands of `index_islands`, `free` after `unclaimed`, or `transcript`.
    """
    if kind == "transcript":
        return hub.withColumns({"seq": F.lit(0).cast("long"), "seq_end": F.lit(None).cast("long")})
    return hub.filter(F.col(f"{kind}_start").isNotNull()).withColumns(
        {"seq": F.col(f"{kind}_start"), "seq_end": F.col(f"{kind}_end")}
    )


def run_bounds(granularity: str) -> tuple[Column, Column]:
    name = "group" if granularity == "groups" else "label"
    return F.col(f"{name}_start"), F.col(f"{name}_end")


def row_label(granularity: str, bucketed: bool = False) -> Column:
    """The label of a row, with its run's short/medium/long suffix when bucketed."""
    base = L.pick_label(granularity)
    if not bucketed:
        return base
    start, end = run_bounds(granularity)
    return L.bucket_label(base, end - start + 1, granularity)


def compress_runs(rows: DataFrame, granularity: str) -> DataFrame:
    """Run-length compression inside each sequence: keep the first row of every run.

    `run_length` is the length of the run as clipped by its sequence.
    """
    start, end = run_bounds(granularity)
    first = F.greatest(start, F.col("seq"))
    last = F.least(end, F.coalesce(F.col("seq_end"), end))
    return rows.filter(F.col("pos") == first).withColumn("run_length", last - first + 1)


def compressed_classes(hub: DataFrame, kinds: Sequence[str], granularity: str,
                       bucketed: bool = False) -> DataFrame:
    """Compressed rows of several sequence kinds from one scan: source_file, pos, cls, seq,
    label, run_length. Labels are abbreviated for display."""
    start, end = run_bounds(granularity)
    pos = F.col("pos")

    def entry(kind: str) -> Column:
        none = F.lit(None).cast("long")
        seq = F.lit(0).cast("long") if kind == "transcript" else F.col(f"{kind}_start")
        seq_end = none if kind == "transcript" else F.col(f"{kind}_end")
        length = F.least(end, F.coalesce(seq_end, end)) - pos + 1
        return F.when(
            seq.isNotNull() & (pos == F.greatest(start, seq)),
            F.struct(F.lit(kind).alias("cls"), seq.alias("seq"), length.alias("run_length")))

    return hub.select(
        "source_file", "pos",
        L.abbreviate(row_label(granularity, bucketed), granularity).alias("label"),
        F.inline(F.array_compact(F.array(*[entry(kind) for kind in kinds]))))


def blocks(hub: DataFrame, target: str) -> DataFrame:
    """One row per important block: first and last position and number of rows."""
    return (
        sequence_rows(hub, target)
        .groupBy("source_file", F.col("seq").alias("block_start"))
        .agg(F.max("seq_end").alias("block_end"), F.count("*").alias("n_rows"))
    )


def block_codes(hub: DataFrame, target: str, skip_null: bool = False) -> DataFrame:
    """One row per (block, code), codes numbered in order of first appearance.

    With `skip_null` empty cells add nothing and a block without any code gets `NA`;
    otherwise each empty cell contributes `NA`.
    """
    cell = F.col(f"{target}_code")
    rows = sequence_rows(hub, target).select(
        "source_file",
        F.col("seq").alias("block_start"),
        "pos",
        F.posexplode_outer(
            F.when(cell.isNotNull() | F.lit(not skip_null), L.parse_codes(cell))
        ).alias("_index", "code"),
    )
    # one number instead of (position, index in cell): a cell holds far fewer than 2^20 codes
    seen = rows.groupBy("source_file", "block_start", "code").agg(
        F.min(F.col("pos") * (1 << 20) + F.col("_index")).alias("_seen")
    )
    per_block = seen.groupBy("source_file", "block_start").agg(
        F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("_seen", "code"))))
        .alias("_codes")
    )
    listed = F.when(
        F.size("_codes") == 0, F.array(F.lit("NA"))
    ).otherwise(F.transform("_codes", lambda c: c["code"]))
    return per_block.select(
        "source_file", "block_start", F.posexplode(listed).alias("code_index", "code")
    )


def block_table(hub: DataFrame, target: str, skip_null: bool = False) -> DataFrame:
    """Blocks with their codes as an array in order of first appearance."""
    codes = (
        block_codes(hub, target, skip_null)
        .groupBy("source_file", "block_start")
        .agg(F.sort_array(F.collect_list(F.struct("code_index", "code"))).alias("_codes"))
        .select("source_file", "block_start",
                F.transform("_codes", lambda c: c["code"]).alias("codes"))
    )
    return blocks(hub, target).join(codes, ["source_file", "block_start"])


def context_rows(hub: DataFrame, order: Ordering, target: str,
                 context: int = CONTEXT_ROWS) -> DataFrame:
    """One row per (block, row) in the block (`core`) or up to `context` rows before (`pre`)
    or after (`post`) it. Contexts stop at transcript ends and may reach into other blocks.

    `region_start` is the first position of the region the row lies in.
    """
    pos, start, end = F.col("pos"), F.col(f"{target}_start"), F.col(f"{target}_end")

    def entry(region: str, block: Column, first: Column) -> Column:
        return F.struct(F.lit(region).alias("region"), block.alias("block_start"),
                        first.cast("long").alias("region_start"))

    marked = hub.withColumns({
        "_opens": F.when(start == pos, entry("pre", pos, F.greatest(pos - context, F.lit(0)))),
        "_closes": F.when(end == pos, entry("post", start, pos + 1)),
    })
    columns = {}
    if context > 0:
        columns = {
            "_pre": lambda w: F.collect_list("_opens").over(w.rowsBetween(1, context)),
            "_post": lambda w: F.collect_list("_closes").over(w.rowsBetween(-context, -1)),
        }
        marked = nearby(marked, order, columns, before=context, after=context)
    core = F.array_compact(F.array(F.when(start.isNotNull(), entry("core", start, start))))
    return (
        marked.withColumn("_in", F.explode(F.concat(core, *columns)))
        .select("*", "_in.*")
        .drop("_in", "_opens", "_closes", *columns)
    )


def context_sequences(hub: DataFrame, order: Ordering, target: str,
                      context: int = CONTEXT_ROWS) -> DataFrame:
    """Rows of each block together with its context as one sequence.

    Contexts overlap, so a sequence is identified by `block_start`; `seq` is its first row.
    """
    first = F.greatest(F.col("block_start") - context, F.lit(0)).cast("long")
    return context_rows(hub, order, target, context).withColumns(
        {"seq": first, "seq_end": F.lit(None).cast("long")})


def clamped_chunks(hub: DataFrame, order: Ordering, context: int = CONTEXT_ROWS) -> DataFrame:
    """Blocks important to either side, with context that stops before the next block."""
    pos = F.col("pos")
    edges = nearby(
        hub,
        order,
        {
            "_gap_start": lambda w: F.lag("neither_start").over(w),
            "_gap_end": lambda w: F.lead("neither_end").over(w),
        },
        before=1,
        after=1,
    ).filter(F.col("either_start").isNotNull())
    gap_start, gap_end = F.col("_gap_start"), F.col("_gap_end")
    opening = F.when(
        F.col("either_start") == pos,
        F.when(gap_start.isNull(), pos).otherwise(F.greatest(gap_start, pos - context)),
    )
    closing = F.when(
        F.col("either_end") == pos,
        F.when(gap_end.isNull(), pos).otherwise(F.least(gap_end, pos + context)),
    )
    return edges.groupBy("source_file", F.col("either_start").alias("block_start")).agg(
        F.max("either_end").alias("block_end"),
        F.max(opening).alias("context_start"),
        F.max(closing).alias("context_end"),
    )


def rest_windows(hub: DataFrame, target: str, size: int | None = None) -> DataFrame:
    """Rows not important to `target`, as sequences: whole runs, or chunks of exactly `size`
    rows with the incomplete last chunk of a run left out."""
    rows = sequence_rows(hub, f"{target}_rest")
    if size is None:
        return rows
    first = F.col("seq") + F.floor((F.col("pos") - F.col("seq")) / size) * size
    return (
        rows.withColumn("_first", first.cast("long"))
        .filter(F.col("_first") + size - 1 <= F.col("seq_end"))
        .withColumns({"seq": F.col("_first"), "seq_end": F.col("_first") + size - 1})
        .drop("_first")
    )


def with_slices(rows: DataFrame) -> DataFrame:
    """Every row twice: in slice `all` and in the slice of its speaker."""
    spoken = F.concat(L.normalise_speaker(F.col("speaker")), F.lit("_spkr"))
    return rows.withColumn("slice", F.explode(F.array(F.lit("all"), spoken)))


def mean_run_lengths(rows: DataFrame, granularity: str, *by: str) -> DataFrame:
    """Mean length of the runs of each label inside the given sequences."""
    return (
        compress_runs(rows, granularity)
        .groupBy(*by, L.pick_label(granularity).alias("label"))
        .agg(F.count("*").alias("n_runs"), F.avg("run_length").alias("mean_run_length"))
    )


def run_bucket_counts(rows: DataFrame, granularity: str, *by: str) -> DataFrame:
    """Runs per label and short/medium/long bucket, after compression."""
    base = L.pick_label(granularity)
    start, end = run_bounds(granularity)
    return (
        compress_runs(rows, granularity)
        .groupBy(*by, base.alias("label"),
                 L.bucket_suffix(base, end - start + 1, granularity).alias("bucket"))
        .agg(F.count("*").alias("n_runs"))
    )
