"""Feature, split and prompt tables for importance classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators.blocks import is_important
from turnloom.operators.ordered import SEGMENT_ROWS, Ordering, nearby, overall, running_total
from turnloom.session import write_table

# Token ids, transcript edge markers and prompt wording.
PAD, UNKNOWN = 0, 1
START_LINE = "[START OF TRANSCRIPT]"
END_LINE = "[END OF TRANSCRIPT]"
PRECEDING = "[Preceding context]"
TARGET_LINE = "[TARGET DA — classify this one]"
FOLLOWING = "[Following context]"
EXAMPLES_INTRO = "Below are examples of dialogue act sequences where the TARGET DA is important:\n"
TASK = (
    "Now classify the TARGET DA in the following sequence as either 'important' or 'not important'.\n"
    "Only classify the TARGET DA and text marked with >>>. "
    "Answer with exactly one of: 'important' or 'not important'.\n"
)


def normalise_time(df: DataFrame, order: Ordering, seconds: str) -> DataFrame:
    """Min-max time per transcript as `ts_norm`: constant or missing times give 0.5, a
    transcript without any time gives null."""
    bounded = overall(df, order, {"_low": ("min", F.col(seconds)), "_high": ("max", F.col(seconds))})
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high == low, 0.5).otherwise((F.col(seconds) - low) / (high - low))
    return bounded.withColumn(
        "ts_norm", F.when(low.isNotNull(), F.coalesce(scaled, F.lit(0.5)))).drop("_low", "_high")


def token(granularity: str, with_speaker: bool = True) -> Column:
    """`speaker::label`, or the label alone where the speaker is a channel of its own."""
    label = L.pick_label(granularity)
    return F.concat_ws("::", L.normalise_speaker(F.col("speaker")), label) if with_speaker else label


def vocabulary(rows: DataFrame, tokens: Column) -> DataFrame:
    """token, idx in order of first appearance over sorted transcripts; 0 and 1 are reserved.

    One row per distinct token is numbered, range by range.
    """
    seen = rows.groupBy(tokens.alias("token")).agg(F.min(F.struct("source_file", "pos")).alias("_first"))
    return running_total(seen, [], ["_first"], name="idx").select(
        "token", (F.col("idx") + UNKNOWN + 1).alias("idx"))


def encode(rows: DataFrame, tokens: Column, vocab: DataFrame, target: str) -> DataFrame:
    """Token ids (unknown tokens get 1), speaker channel, time (0 where absent) and label."""
    spoken_by_other = L.normalise_speaker(F.col("speaker")) != "therapist"
    return (
        rows.withColumn("token", tokens)
        .join(vocab, "token", "left")
        .select(
            "source_file", "pos",
            F.coalesce("idx", F.lit(UNKNOWN).cast("long")).alias("token_id"),
            spoken_by_other.cast("double").alias("speaker_channel"),
            F.coalesce("ts_norm", F.lit(0.0)).alias("ts"),
            F.when(is_important(target), 1).otherwise(0).alias("label"),
        )
    )


def expand_labels(rows: DataFrame, order: Ordering, label: str, before: int, after: int) -> DataFrame:
    """Training labels widened to `before` rows ahead of each positive and `after` behind."""
    return nearby(
        rows, order,
        {"expanded": lambda w: F.max(label).over(w.rowsBetween(-after, before))},
        before=after, after=before,
    )


def hash_order(seed: int, *parts: str) -> Column:
    """A reproducible random order: the digest of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def loss_mask(rows: DataFrame, order: Ordering, label: str, rate: float, seed: int = 42,
              range_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Keep every positive and, per transcript, max(1, floor(negatives * rate)) negatives.

    Negatives rank by hash. A transcript with many is ranked in hash ranges with prefix
    sums, so no task orders all of them.
    """
    if rate >= 1.0:
        return rows.withColumn("in_loss", F.lit(True))
    negatives = overall(
        rows.filter(F.col(label) == 0).select(
            "source_file", "pos", hash_order(seed, "source_file", "pos").alias("_h")),
        order, {"_n": ("sum", F.lit(1).cast("long"))})
    fraction = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ranged = negatives.withColumn("_range", F.floor(fraction * F.ceil(F.col("_n") / range_rows)))
    counts = ranged.groupBy("source_file", "_range").agg(F.count("*").alias("_k"))
    earlier = (
        Window.partitionBy("source_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "source_file", "_range", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("source_file", "_range").orderBy("_h")
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * rate))
    kept = (
        ranged.join(offsets, ["source_file", "_range"])
        .withColumn("_rank", F.row_number().over(local) + F.col("_before"))
        .filter(F.col("_rank") <= quota)
        .select("source_file", "pos", F.lit(True).alias("_kept"))
    )
    return rows.join(kept, ["source_file", "pos"], "left").withColumn(
        "in_loss", (F.col(label) == 1) | F.coalesce(F.col("_kept"), F.lit(False))).drop("_kept")


def fold_table(rows: DataFrame, label: str, scale: float = 1.0) -> DataFrame:
    """Leave-one-transcript-out folds: sizes of the training side and its positive weight.

    Training counts are the total minus the fold's own, so no fold copies the data.
    """
    own = rows.groupBy(F.col("source_file").alias("fold")).agg(
        F.count("*").alias("n_test"), F.sum(label).alias("n_test_pos"))
    total = own.agg(F.sum("n_test").alias("_n"), F.sum("n_test_pos").alias("_p"))
    everything = own.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    n_train, n_pos = F.col("_n") - F.col("n_test"), F.col("_p") - F.col("n_test_pos")
    return everything.select(
        "fold", "n_test", "n_test_pos", n_train.alias("n_train"), n_pos.alias("n_train_pos"),
        ((n_train - n_pos) / F.greatest(n_pos, F.lit(1)) * scale).alias("pos_weight"))


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy("source_file").agg(
        F.count("*").alias("n_das"), F.sum(label).alias("n_important")
    ).withColumn("pct_important", F.round(100.0 * F.col("n_important") / F.greatest(F.col("n_das"), F.lit(1)), 1))


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """Every combination of the given parameter lists, one column per parameter."""
    out = spark.range(1).drop("id").withColumn("_one", F.lit(1))
    for name, choices in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(c) for c in choices])))
    return out.drop("_one")


def receptive_field(layers: int, kernel: int) -> int:
    return layers * (kernel - 1) + 1


START_TOKEN, END_TOKEN = "<start>", "<end>"


def context_scores(rows: DataFrame, order: Ordering, tokens: Column, label: str, reach: int,
                   smoothing: Sequence[float] = (1.0,)) -> DataFrame:
    """Log-odds of importance of every row under models that have not seen its transcript.

    A row's evidence is, for each offset up to `reach`, how much likelier its neighbour's token is there
    among important rows than among others, from smoothed counts over all other transcripts: the totals
    less the transcript's own, so leaving each transcript out costs one pass and nothing is fitted. Rows
    beyond the ends are tokens too. `scores` has one entry per smoothing and per reach from 0 on.

    A token's counts at all offsets come from the labels around its own row, and its evidence at all
    offsets travels with its row, so rows are never repeated per offset. Counts and evidence have a row
    per transcript and token; a row meets its evidence on that key.
    """
    spark, offsets = rows.sparkSession, range(-reach, reach + 1)
    base = rows.select("source_file", order.pos, tokens.alias("token"), F.col(label).cast("int").alias("label"))
    around = {f"_b{k}": (lambda w, k=k: F.lag("label", k).over(w)) for k in range(1, reach + 1)}
    around |= {f"_f{k}": (lambda w, k=k: F.lead("label", k).over(w)) for k in range(1, reach + 1)}
    wide = write_table(spark, "context_rows", nearby(base, order, around, before=reach, after=reach))
    # the row whose token stands at offset o is o behind; a row without one there has an end as token
    centre = {o: F.col("label") if o == 0 else F.col(f"_b{o}") if o > 0 else F.col(f"_f{-o}") for o in offsets}
    beyond = {o: F.lit(False) if o == 0 else F.col(f"_f{o}").isNull() if o > 0 else F.col(f"_b{-o}").isNull()
              for o in offsets}
    n, y = [f"n{i}" for i in range(len(offsets))], [f"y{i}" for i in range(len(offsets))]
    inside = wide.groupBy("source_file", "token").agg(*[
        c for i, o in enumerate(offsets) for c in (F.count(centre[o]).alias(n[i]), F.coalesce(F.sum(centre[o]), F.lit(0)).alias(y[i]))])
    edges = [
        wide.groupBy("source_file").agg(*[
            c for i, o in enumerate(offsets) for c in (
                F.count_if(beyond[o] & F.lit(here(o))).alias(n[i]),
                F.count_if(beyond[o] & F.lit(here(o)) & (F.col("label") == 1)).alias(y[i]))]).withColumn("token", F.lit(name))
        for name, here in ((START_TOKEN, lambda o: o < 0), (END_TOKEN, lambda o: o > 0))
    ]
    own = write_table(spark, "context_counts", inside.unionByName(edges[0]).unionByName(edges[1]))
    everywhere = own.groupBy("token").agg(*[F.sum(c).alias(f"all_{c}") for c in (*n, *y)])
    files = wide.groupBy("source_file").agg(F.count("*").alias("_n"), F.sum("label").alias("_y"))
    sizes = files.agg(F.sum("_n").alias("_alln"), F.sum("_y").alias("_ally")).withColumn("_k", F.lit(1)).join(
        everywhere.filter(~F.col("token").isin(START_TOKEN, END_TOKEN)).agg((F.count("*") + 1).alias("_v")).withColumn("_k", F.lit(1)), "_k")
    trained = files.withColumn("_k", F.lit(1)).join(F.broadcast(sizes), "_k").drop("_k")  # one row is sent

    def evidence(i: int, alpha: float) -> Column:
        important = F.col(f"all_{y[i]}") - F.col(y[i])
        other = F.col(f"all_{n[i]}") - F.col(n[i]) - important
        n1 = F.col("_ally") - F.col("_y")
        n0 = F.col("_alln") - F.col("_n") - n1
        return F.log((important + alpha) / (n1 + alpha * F.col("_v"))) - F.log((other + alpha) / (n0 + alpha * F.col("_v")))

    weights = own.join(everywhere, "token").join(trained, "source_file").select(
        "source_file", "token", F.array(*[F.array(*[evidence(i, a) for i in range(len(offsets))]) for a in smoothing]).alias("w"))
    weights = write_table(spark, "context_weights", weights)
    ends = weights.filter(F.col("token").isin(START_TOKEN, END_TOKEN)).groupBy("source_file").agg(
        F.max(F.when(F.col("token") == START_TOKEN, F.col("w"))).alias("_start"),
        F.max(F.when(F.col("token") == END_TOKEN, F.col("w"))).alias("_end"))
    known = weights.filter(~F.col("token").isin(START_TOKEN, END_TOKEN)).join(ends, "source_file")
    placed = wide.select("source_file", order.pos, "label", "token").join(known, ["source_file", "token"])
    seen = {f"_p{k}": (lambda w, k=k: F.coalesce(F.lag("w", k).over(w), F.col("_start"))) for k in range(1, reach + 1)}
    seen |= {f"_s{k}": (lambda w, k=k: F.coalesce(F.lead("w", k).over(w), F.col("_end"))) for k in range(1, reach + 1)}
    scored, entries = nearby(placed, order, seen, before=reach, after=reach), []
    for a, alpha in enumerate(smoothing):
        total = F.col("w")[a][reach]
        for k in range(reach + 1):
            if k:
                total = total + F.col(f"_p{k}")[a][reach - k] + F.col(f"_s{k}")[a][reach + k]
            entries.append(F.struct(F.lit(float(alpha)).alias("smoothing"), F.lit(k).alias("reach"), total.alias("score")))
    return scored.select("source_file", order.pos, "label", F.array(*entries).alias("scores"))


def probability(score: Column, scale: Column | float = 1.0) -> Column:
    """Probability where positives weigh negatives / positives * scale."""
    return 1.0 / (1.0 + F.exp(-(score + F.log(F.lit(scale) if isinstance(scale, float) else scale))))


def split_by_patient(rows: DataFrame, n_train: int = 5, seed: int = 42) -> DataFrame:
    """`part` of each patient: `n_train` patients drawn by hash for training, others test.

    A patient id has two digits, so there are at most 100 rows.
    """
    patients = rows.select(L.patient_in_name(F.col("source_file")).alias("patient_id")).filter(
        F.col("patient_id").isNotNull()).distinct()
    train = patients.orderBy(hash_order(seed, "patient_id"), "patient_id").limit(n_train).select(
        "patient_id", F.lit("train").alias("part"))
    test = patients.join(train, "patient_id", "left_anti").select("patient_id", F.lit("test").alias("part"))
    return train.unionByName(test)


def act_line(granularity: str) -> Column:
    return F.concat(
        F.initcap(L.normalise_speaker(F.col("speaker"))), F.lit(": ["), L.pick_label(granularity),
        F.lit('] "'), F.trim(F.coalesce(F.col("spoken_text"), F.lit(""))), F.lit('"'))


def context_window(rows: DataFrame, order: Ordering, granularity: str, reach: int) -> DataFrame:
    """`context`: the lines around each row, padded past the transcript's ends, with the row
    itself marked as the target."""
    lines = rows.withColumn("_line", act_line(granularity))
    before = {f"_b{k}": (lambda w, k=k: F.lag("_line", k, START_LINE).over(w)) for k in range(reach, 0, -1)}
    after = {f"_a{k}": (lambda w, k=k: F.lead("_line", k, END_LINE).over(w)) for k in range(1, reach + 1)}
    wide = nearby(lines, order, {**before, **after}, before=reach, after=reach)
    return wide.withColumn("context", F.concat_ws(
        "\n", F.lit(PRECEDING), *before, F.lit(TARGET_LINE), F.concat(F.lit(">>> "), F.col("_line")),
        F.lit(FOLLOWING), *after,
    )).drop("_line", *before, *after)


def positive_examples(train: DataFrame, n_examples: int, seed: int = 42) -> DataFrame:
    """Contexts of positive training rows in a reproducible random order; a top-k."""
    order = hash_order(seed, "source_file", "pos")
    return train.filter(F.col("label") == 1).orderBy(order, "source_file", "pos").limit(n_examples)


def prompts(rows: DataFrame, examples: Sequence[str]) -> DataFrame:
    """Few-shot prompt of each row around its `context`. Examples are a handful of texts."""
    shown = []
    if examples:
        shown.append(EXAMPLES_INTRO)
        for i, text in enumerate(examples, 1):
            shown += [f"Example {i}:", text, "Classification: important\n"]
    return rows.withColumn("prompt", F.concat_ws(
        "\n", *[F.lit(s) for s in shown], F.lit(TASK), F.col("context"), F.lit("\nClassification:")))
