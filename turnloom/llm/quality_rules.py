"""Quality rules whose cutoffs follow the corpus: quantile sketches per language and source.

Each text is measured with built-in functions only. Measures of the texts that pass the base rule
are summarised per (lang, source) by a log-bucketed sketch: counts of `bucket(value)`, which keeps
every quantile within 1 % and merges by adding counts, so partial sketches combine on the map side
and roll up to a language and to the corpus. A measure is rejected beyond its fence: the quartile plus
`reach` times the spread, the spread being the interquartile range but never less than the measure's
own unit. A group with fewer than `least` texts uses its language's fences, a small language those of
the corpus.

Defined results: a null text is empty; null lang or source is a group of its own; an empty table has
no fences and gives no rows; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.session import write_table

SPACE = " \t\n\u000b\f\r"
GAMMA = 1.01 / 0.99
REACH = 3
LEAST = 30
# Least spread of each measure, in its own unit: per 1000 words, words or lines; hundredths of a character.
SPREADS = {"symbols": 10, "repeats": 100, "copies": 150, "width": 50}
BROADCAST_ROWS = 100_000


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`docs` with one more column `_m`: counts of the text, its measures and its group. Columns of the
    input named `_m` or `_kept` are replaced; `passing` keeps columns of any name."""
    own = [c for c in docs.columns if c.lower() not in ("_m", "_kept")]
    p = "_m"  # no column of the input begins like those made here
    while any(c.lower().startswith(p) for c in own):
        p += "_"

    def step(df: DataFrame, **made: Column | str) -> DataFrame:
        return df.select(*[f"`{c}`" for c in own], *[c for c in df.columns if c.startswith(p) and c not in own],
                         *[(F.expr(e) if isinstance(e, str) else e).alias(p + c) for c, e in made.items()])

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(*[f"`{c}`" for c in own], body.alias(f"{p}_text"))
    df = step(df, _words=F.when(F.btrim(f"{p}_text", F.lit(SPACE)) == "", F.array().cast("array<string>"))
              .otherwise(F.split(F.btrim(f"{p}_text", F.lit(SPACE)), r"[\x20\x09-\x0D]+")),
              _lines=F.filter(F.split(f"{p}_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    df = step(df, _n=f"size({p}_words)",
              _three=f"""CASE WHEN size({p}_words) < 3 THEN array() ELSE
                  transform(sequence(0, size({p}_words) - 3),
                            i -> xxhash64({p}_words[i], {p}_words[i + 1], {p}_words[i + 2])) END""")
    df = step(df, _order=f"""CASE WHEN size(array_distinct({p}_three)) = size({p}_three) THEN null ELSE
                  array_sort(transform({p}_three, (h, i) -> struct(h AS h, i AS i))) END""")
    # starts of windows found twice or more, in the order of the text
    df = step(df, _starts=f"""CASE WHEN {p}_order IS NULL THEN null ELSE
                  array_sort(transform(filter({p}_order, (x, j) ->
                      (j > 0 AND x.h = {p}_order[greatest(j - 1, 0)].h) OR
                      (j < size({p}_order) - 1 AND x.h = {p}_order[least(j + 1, size({p}_order) - 1)].h)),
                  x -> x.i)) END""")
    df = step(df, _counts=f"""struct(
        CAST({p}_n AS bigint) AS n_words,
        CAST(length(array_join({p}_words, '')) AS bigint) AS word_chars,
        CAST(regexp_count({p}_text, '[#*$%&|<>]') AS bigint) AS n_symbols,
        CAST(size({p}_lines) AS bigint) AS n_lines,
        CAST(size({p}_lines) - size(array_distinct({p}_lines)) AS bigint) AS n_dup_lines,
        CASE WHEN {p}_starts IS NULL THEN 0L ELSE aggregate({p}_starts,
            struct(0L AS upto, 0L AS n),
            (s, i) -> struct(i + 3L AS upto, s.n + (i + 3L - greatest(CAST(i AS bigint), s.upto)) AS n),
            s -> s.n) END AS n_repeat_words)""")
    counts = f"{p}_counts"
    df = df.select(*[f"`{c}`" for c in own], counts)
    n, lines = f"greatest({counts}.n_words, 1)", f"greatest({counts}.n_lines, 1)"
    # a column that no filter may be moved past, so that a filter on the measures does not repeat them
    fixed = F.monotonically_increasing_id().alias("row")
    return df.select(*[f"`{c}`" for c in own], F.struct(
        fixed, f"{counts}.*",
        F.expr(f"{counts}.n_symbols * 1000 DIV {n}").alias("symbols"),
        F.expr(f"{counts}.n_repeat_words * 1000 DIV {n}").alias("repeats"),
        F.expr(f"{counts}.n_dup_lines * 1000 DIV {lines}").alias("copies"),
        F.expr(f"{counts}.word_chars * 100 DIV {n}").alias("width"),
        F.expr(f"{counts}.n_words < 50 OR 100 * {counts}.n_repeat_words > 50 * {counts}.n_words")
        .alias("base_failed"),
        _group(docs, lang).alias("lang"), _group(docs, source).alias("source"),
    ).alias("_m"))


def _group(docs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in docs.columns else F.lit("")


def bucket(value: Column) -> Column:
    """Bucket 0 holds zero; bucket b holds values up to GAMMA ** (b - 1)."""
    return F.when(value <= 0, 0).otherwise(F.ceil(F.log(value) / math.log(GAMMA)) + 1).cast("int")


def sketch(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable summary of all texts that pass the base rule."""
    named = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket(F.col(f"_m.{m}")).alias("bucket")) for m in SPREADS]))
    return (measures.where("NOT _m.base_failed").select("_m.lang", "_m.source", named.alias("s"))
            .groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count("*").alias("n")))


def fences(sketches: DataFrame, reach: float = REACH, least: int = LEAST) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high): what each group accepts."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
                       for k, (lang, source) in enumerate([(F.col("lang"), F.col("source")),
                                                           (F.col("lang"), F.lit("")), (F.lit(""), F.lit(""))])])
    merged = (sketches.select(F.explode(levels).alias("at"), "measure", "bucket", "n")
              .groupBy("at", "measure", "bucket").agg(F.sum("n").alias("n")))
    buckets = F.array_sort(F.collect_list(F.struct("bucket", "n")))  # some hundred buckets at most
    each = merged.groupBy("at", "measure").agg(F.sum("n").alias("total"), buckets.alias("buckets"))

    def quantile(q: float) -> str:
        """Middle, in ratio, of the first bucket up to which a share `q` of the values lies."""
        return f"""aggregate(buckets, struct(0L AS upto, -1 AS found), (s, b) -> struct(
            s.upto + b.n AS upto,
            CASE WHEN s.found < 0 AND s.upto + b.n >= {q} * total THEN b.bucket ELSE s.found END AS found),
            s -> CASE WHEN s.found = 0 THEN 0D
                 ELSE 2 * power({GAMMA!r}D, s.found - 1) / ({GAMMA!r}D + 1) END)"""

    spread = F.greatest(F.col("q75") - F.col("q25"), F.create_map(
        *[x for m, s in SPREADS.items() for x in (F.lit(m), F.lit(float(s)))])[F.col("measure")])
    bounds = (each.select("at", "measure", "total", F.expr(quantile(0.25)).alias("q25"),
                          F.expr(quantile(0.75)).alias("q75"))
              .select("at", "total", "measure", (F.col("q25") - reach * spread).alias("low"),
                      (F.col("q75") + reach * spread).alias("high")))
    wide = bounds.groupBy("at", "total").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
        for m in SPREADS for side in ("low", "high")])
    wanted = sketches.select("lang", "source").distinct().select("lang", "source", F.explode(levels).alias("at"))
    limits = [f"{m}_{side}" for m in SPREADS for side in ("low", "high")]
    usable = wide.where((F.col("total") >= least) | (F.col("at.level") == 2))
    return (wanted.join(usable, "at").groupBy("lang", "source")
            .agg(F.min_by(F.struct(*limits), F.col("at.level")).alias("f"))
            .select("lang", "source", "f.*"))


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """`measures` with `_kept`: passes the base rule and lies within all fences of its group.

    `limits` is one row per group; it is sent to all tasks only when counted small.
    """
    f = "_f"
    while f in (c.lower() for c in measures.columns):
        f += "_"
    inside = [F.col(f"_m.{m}").between(F.col(f"{f}.{m}_low"), F.col(f"{f}.{m}_high")) for m in SPREADS]
    ok = inside[0]
    for more in inside[1:]:
        ok = ok & more
    table = limits.select(F.struct(*limits.columns).alias(f))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    on = (F.col("_m.lang") == F.col(f"{f}.lang")) & (F.col("_m.source") == F.col(f"{f}.source"))
    return measures.join(table, on, "left").withColumn(
        "_kept", ~F.col("_m.base_failed") & F.coalesce(ok, F.lit(True))).drop(f)


def passing(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang",
            source: str = "source") -> DataFrame:
    """The rows of `docs` that pass; the input's columns travel as one struct, so none can clash."""
    used = [F.col(f"`{c}`").alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source")) if c in docs.columns]
    measures = measured(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("given"), *used))
    limits = write_table(spark, "fences", fences(sketch(measures)))  # measured again, so that texts need not be shuffled
    return judged(measures, limits).where("_kept").select("given.*")
