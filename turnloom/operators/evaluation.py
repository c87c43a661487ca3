"""Classification metrics from confusion counts, and response parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(probability: Column, at: Column | float) -> Column:
    return F.when(probability >= at, 1).otherwise(0)


def confusion(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def scores() -> dict[str, Column]:
    """Metrics as expressions over tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    f1_pos = ratio(2.0 * tp, 2 * tp + fp + fn)
    f1_neg = ratio(2.0 * tn, 2 * tn + fp + fn)
    # a class that neither occurs nor is predicted does not enter the macro mean
    seen_pos, seen_neg = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    return {
        "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "precision": ratio(tp, tp + fp),
        "f1_important": f1_pos,
        "f1_macro": ratio(f1_pos + f1_neg, seen_pos + seen_neg),
        "f1_weighted": ratio(f1_pos * (tp + fn) + f1_neg * (tn + fp), tp + tn + fp + fn),
    }


def evaluate(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    return confusion(rows, truth, predicted, *by).withColumns(scores())


def rounded(value: Column, digits: int) -> Column:
    """Scores of small counts are often decimals ending in 5; 1e-9 rounds those up in every engine."""
    return F.round(value + 1e-9, digits)


def _fold_scores(counts: DataFrame, *by: str) -> DataFrame:
    value = scores()
    n, positive = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), F.col("tp") + F.col("fn")
    return counts.select(
        *by, F.col("source_file").alias("transcript"), n.alias("n_das"), positive.alias("n_important"),
        rounded(100.0 * positive / n, 1).alias("pct_important"),
        (F.col("tp") + F.col("fp")).alias("n_pred_important"),
        rounded(value["f1_important"], 4).alias("f1_important"),
        rounded(value["f1_macro"], 4).alias("f1_macro"),
        rounded(value["precision"], 4).alias("precision_imp"),
        rounded(value["sensitivity"], 4).alias("recall_imp"),
    )


def fold_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """One row per fold (transcript) from `label` and `pred`; four-digit scores."""
    return _fold_scores(confusion(predictions, "label", "pred", *by, "source_file"), *by)


def pooled_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """Pooled F1 scores with mean and population deviation of the fold scores, all from one count per
    parameter point and fold."""
    cells = ("tp", "tn", "fp", "fn")
    value = scores()
    counts = confusion(predictions, "label", "pred", *by, "source_file").withColumns(
        {"_f": rounded(value["f1_important"], 4), "_m": rounded(value["f1_macro"], 4)})
    pooled = counts.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in cells], F.avg("_f").alias("mean_fold_f1_imp"),
        F.stddev_pop("_f").alias("std_fold_f1_imp"), F.avg("_m").alias("mean_fold_f1_balanced"))
    return pooled.select(
        *by, value["f1_important"].alias("pooled_f1_imp"), value["f1_macro"].alias("pooled_f1_balanced"),
        value["f1_weighted"].alias("pooled_f1_weighted"), "mean_fold_f1_imp", "std_fold_f1_imp", "mean_fold_f1_balanced")


def rank_grid(results: DataFrame, top: int = 5) -> DataFrame:
    """The best parameter rows: highest mean fold F1, then the steadiest."""
    return results.orderBy(
        F.round("mean_fold_f1_imp", 9).desc(), F.round("std_fold_f1_imp", 9).asc(),
        *[c for c in results.columns if c.startswith("p_")],
    ).limit(top)


def parse_response(response: Column) -> tuple[Column, Column]:
    """Prediction 0/1 from a model's answer, and whether the answer was understood."""
    text = F.lower(F.trim(response))
    negative, positive = F.contains(text, F.lit("not important")), F.contains(text, F.lit("important"))
    return F.when(negative, 0).when(positive, 1).otherwise(0), negative | positive


def ask(rows: DataFrame, load_model: Callable[[], Callable[[Sequence[str]], Iterable[str]]],
        keep: Sequence[str], batch_size: int = 16) -> DataFrame:
    """`response` of a user-supplied model to each `prompt`; loaded once per task."""
    kept = rows.select(*keep, "prompt")
    schema = kept.drop("prompt").schema.simpleString()[len("struct<"):-1] + ",response:string"

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in batches:
            texts = pdf.pop("prompt").tolist()
            responses: list[str] = []
            for first in range(0, len(texts), batch_size):
                responses.extend(model(texts[first:first + batch_size]))
            yield pdf.assign(response=responses)

    return kept.mapInPandas(answer, schema)
