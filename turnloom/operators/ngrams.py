"""n-gram counts and the bag-of-words tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.ordered import SEGMENT_ROWS, Ordering, ahead, nearby, running_total
from turnloom.session import write_table

SEPARATOR = " -> "


def ngrams(rows: DataFrame, order: Ordering, sizes: Sequence[int], *keep: str) -> DataFrame:
    """One row per n-gram occurrence of `label` along each `seq`.

    `order.keys` must separate sequences that overlap in position; rows of one sequence are
    consecutive rows of that ordering. `keep` names columns of the first row to carry along.
    """
    sizes = sorted(set(sizes))
    reach = sizes[-1] - 1
    rows = rows.select(*dict.fromkeys([*order.keys, order.pos, "seq", "label", *keep]))
    parts: list[Column] = [F.col("label")]
    if reach:
        columns = {}
        for i in range(1, reach + 1):
            columns[f"_l{i}"] = lambda w, i=i: F.when(
                F.lead("seq", i).over(w) == F.col("seq"), F.lead("label", i).over(w)
            )
        rows = ahead(rows, order, reach, ["seq", "label"], columns)
        parts += [F.col(f"_l{i}") for i in range(1, reach + 1)]
    grams = F.array(
        *[
            F.when(
                parts[n - 1].isNotNull(),
                F.struct(F.lit(n).alias("n"), F.concat_ws(SEPARATOR, *parts[:n]).alias("ngram")),
            )
            for n in sizes
        ]
    )
    return rows.select(
        *dict.fromkeys([*order.keys, "seq", *keep]), F.explode(F.array_compact(grams)).alias("_g")
    ).select("*", "_g.n", "_g.ngram").drop("_g")


def count_ngrams(occurrences: DataFrame, *by: str) -> DataFrame:
    return occurrences.groupBy(*by, "n", "ngram").agg(F.count("*").alias("cnt"))


def concatenated(rows: DataFrame, order: Ordering, *group: str) -> DataFrame:
    """All compressed sequences of a group as one, in order of (source_file, position), with
    repeats across the joints dropped.

    A position along a group is the size of all earlier (transcript, segment) pieces plus the
    place inside the piece; a group is then cut into segments like a transcript. Sizes are summed
    range by range, so a group may have any number of transcripts.
    """
    along = Ordering(tuple(group), "pos", order.segment_rows or SEGMENT_ROWS)
    piece = [*group, "source_file", "_piece"]
    pieces = rows.withColumn("_piece", along.segment())
    offsets = running_total(pieces.groupBy(*piece).agg(F.count("*").alias("_n")), group, ["source_file", "_piece"],
                            F.col("_n"), "_offset").drop("_n")
    inside = F.row_number().over(Window.partitionBy(*piece).orderBy("pos"))
    placed = pieces.join(offsets, piece).select(
        *group, "label", (F.col("_offset") + inside - 1).alias("pos"))
    compared = nearby(placed, along, {"_previous": lambda w: F.lag("label").over(w)}, before=1)
    return compared.filter(~F.col("label").eqNullSafe(F.col("_previous"))).drop("_previous").withColumn(
        "seq", F.lit(0).cast("long"))


def spread_over_codes(counts: DataFrame, codes: DataFrame) -> DataFrame:
    """Counts per block, credited to every code of the block."""
    return counts.join(
        codes.select("source_file", F.col("block_start").alias("seq"), "code"),
        ["source_file", "seq"],
    )


def with_frequency(counts: DataFrame, *family: str) -> DataFrame:
    """Add `total` and `freq`, the share of a count within its family."""
    totals = counts.groupBy(*family).agg(F.sum("cnt").alias("total"))
    return counts.join(totals, list(family)).withColumn("freq", F.col("cnt") / F.col("total"))


def top_patterns(counts: DataFrame, top: int, *family: str) -> DataFrame:
    """The `top` most frequent n-grams per family by pooled count, ties by n-gram."""
    pooled = counts.groupBy(*family, "ngram").agg(F.sum("cnt").alias("pooled"))
    w = Window.partitionBy(*family).orderBy(F.col("pooled").desc(), "ngram")
    return pooled.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def pattern_shares(counts: DataFrame, top: DataFrame, family: Sequence[str],
                   group: Sequence[str]) -> DataFrame:
    """Share of each top pattern among the top patterns of a group."""
    kept = counts.join(F.broadcast(top.select(*family, "ngram", "rank")), [*family, "ngram"])
    sums = kept.groupBy(*group).agg(F.sum("cnt").alias("_sum"))
    return kept.join(sums, list(group)).withColumn("share", F.col("cnt") / F.col("_sum")).drop("_sum")


def zero_filled(counts: DataFrame, family: Sequence[str]) -> DataFrame:
    """Frequency matrix in long form: union vocabulary by groups, zeros included.

    A sink shape. Its size is the matrix itself, so the two sides meet on the family key.
    """
    freq = with_frequency(counts, *family, "group")
    vocabulary = counts.groupBy(*family, "ngram").agg(F.sum("cnt").alias("raw_count_total"))
    groups = counts.select(*family, "group").distinct()
    return (
        vocabulary.join(groups, list(family))
        .join(freq.select(*family, "group", "ngram", "cnt", "freq"),
              [*family, "group", "ngram"], "left")
        .fillna({"cnt": 0, "freq": 0.0})
    )


def sequence_summary(counts: DataFrame, n_groups: DataFrame, family: Sequence[str]) -> DataFrame:
    """Mean, population deviation, min, max of per-group frequency with zeros included,
    from sums over the groups that have the n-gram."""
    freq = with_frequency(counts, *family, "group")
    mean = F.col("_sum") / F.col("n_groups")
    return (
        freq.groupBy(*family, "ngram")
        .agg(
            F.sum("cnt").alias("raw_count_total"),
            F.sum("freq").alias("_sum"),
            F.sum(F.col("freq") * F.col("freq")).alias("_squares"),
            F.max("freq").alias("max_freq"),
            F.min("freq").alias("_min"),
            F.count("*").alias("n_present"),
        )
        .join(F.broadcast(n_groups), list(family))
        .select(
            *family,
            "ngram",
            "raw_count_total",
            mean.alias("mean_freq"),
            F.sqrt(F.greatest(F.col("_squares") / F.col("n_groups") - mean * mean, F.lit(0.0)))
            .alias("std_freq"),
            F.when(F.col("n_present") < F.col("n_groups"), 0.0)
            .otherwise(F.col("_min")).alias("min_freq"),
            "max_freq",
            "n_present",
        )
    )


def tf_idf(counts: DataFrame, family: Sequence[str], salts: int = 32) -> DataFrame:
    """freq * ln(groups / (1 + groups having the n-gram)), for the groups that have it.

    A frequent n-gram has a row in nearly every group, so its rows meet its document count
    on a salted key.
    """
    freq = with_frequency(counts, *family, "group").withColumn(
        "_salt", F.pmod(F.hash("group"), F.lit(salts)))
    n_groups = freq.groupBy(*family).agg(F.countDistinct("group").alias("n_groups"))
    present = (
        freq.groupBy(*family, "ngram").agg(F.count("*").alias("n_present"))
        .withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    )
    return (
        freq.join(present, [*family, "ngram", "_salt"])
        .join(F.broadcast(n_groups), list(family))
        .withColumn("tfidf", F.col("freq") * F.log(F.col("n_groups") / (F.col("n_present") + 1)))
        .drop("_salt")
    )


def first_absent(scored: DataFrame, groups: DataFrame, family: Sequence[str], top: int) -> DataFrame:
    """The first `top` n-grams by name of a family's vocabulary that a group of `groups` lacks.

    With names numbered from 1, a name a group has at number i as its (j + 1)-th has i - 1 - j absent names
    before it; the q-th absent name is number q + j for the first j with q or more absent before. So two
    numberings and one minimum per group and count find them, and vocabulary and groups are never paired.
    """
    family = list(family)
    vocabulary = write_table(scored.sparkSession, "vocabulary", running_total(
        scored.select(*family, "ngram").distinct(), family, ["ngram"], name="_number").withColumn("_number", F.col("_number") + 1))
    end = vocabulary.groupBy(*family).agg((F.max("_number") + 1).alias("_number"))
    own = scored.select(*family, "group", "ngram").join(groups, [*family, "group"]).join(vocabulary, [*family, "ngram"]).select(
        *family, "group", "_number").unionByName(groups.join(end, family))
    placed = running_total(own, [*family, "group"], ["_number"], name="_held")
    q = F.explode(F.sequence(F.lit(1), "_absent")).alias("_q")
    first = (
        placed.withColumn("_absent", F.least(F.col("_number") - 1 - F.col("_held"), F.lit(top)).cast("int"))
        .filter("_absent > 0").groupBy(*family, "group", "_absent").agg(F.min("_held").alias("_held"))
        .select(*family, "group", q, "_held").groupBy(*family, "group", "_q").agg(F.min("_held").alias("_held"))
    )
    return first.withColumn("_number", (F.col("_q") + F.col("_held")).cast("long")).join(
        vocabulary, [*family, "_number"]).select(*family, "group", "ngram")


def dominant(scored: DataFrame, family: Sequence[str], top: int) -> DataFrame:
    """Top n-grams per group by TF-IDF, ties by n-gram.

    An n-gram a group lacks scores 0 and outranks one that nearly every group has (negative
    score). Only groups with fewer than `top` positive scores can need such zeros, and of these
    only the first `top` by name.
    """
    columns = [*family, "group", "ngram", "tfidf", "freq"]
    scored = write_table(scored.sparkSession, "scored", scored.select(*columns))
    needy = (
        scored.groupBy(*family, "group")
        .agg(F.count_if(F.col("tfidf") > 0).alias("_positive"))
        .filter(F.col("_positive") < top)
        .select(*family, "group")
    )
    absent = first_absent(scored, needy, family, top).withColumns({"tfidf": F.lit(0.0), "freq": F.lit(0.0)})
    w = Window.partitionBy(*family, "group").orderBy(F.col("tfidf").desc(), "ngram")
    everything = scored.unionByName(absent.select(*columns))
    return everything.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def heaviest(freq: DataFrame, family: Sequence[str], top: int) -> DataFrame:
    """n-grams with the largest frequency summed over groups."""
    sums = freq.groupBy(*family, "ngram").agg(F.sum("freq").alias("row_sum"))
    w = Window.partitionBy(*family).orderBy(F.round("row_sum", 9).desc(), "ngram")
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def differences(wide: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Pairwise differences and dispersion of the `<group>_freq` columns of a wide table.

    The first group with the largest frequency is the dominant one.
    """
    freq = {g: F.col(f"{g}_freq") for g in groups}
    columns: dict[str, Column] = {}
    for i, a in enumerate(groups):
        for b in groups[i + 1:]:
            name = f"{a.split('_')[0]}_vs_{b.split('_')[0]}"
            columns[f"diff_{name}"] = freq[a] - freq[b]
            columns[f"absdiff_{name}"] = F.abs(freq[a] - freq[b])
    largest, smallest = F.greatest(*freq.values()), F.least(*freq.values())
    mean = sum(freq.values(), F.lit(0.0)) / len(groups)
    variance = sum(((f - mean) * (f - mean) for f in freq.values()), F.lit(0.0)) / len(groups)
    dominant_group = F.coalesce(*[F.when(freq[g] == largest, g) for g in groups])
    return wide.withColumns({
        **columns,
        "freq_max": largest,
        "freq_min": smallest,
        "freq_range": largest - smallest,
        "freq_std": F.sqrt(variance),
        "dominant_group": dominant_group,
    })
