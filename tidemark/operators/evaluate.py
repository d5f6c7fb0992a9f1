"""Scores of predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import BATCH_SIZE, SPLIT_SEED
from tidemark.operators.ranksum import roc_auc
from tidemark.operators.sampling import draw_position

MEASURES = ["precision", "recall", "f1", "accuracy"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def class_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and accuracy for class 0 and for class 1.

    All counts come from one aggregate; with ``by`` there is one set per group.
    A measure whose denominator is 0 is 0.
    """
    counts = df.groupBy(*by).agg(
        *(
            F.count_if((F.col(label) == want) & (F.col(prediction) == got)).alias(f"_n{want}{got}")
            for want in (0, 1)
            for got in (0, 1)
        )
    )
    n = {(want, got): F.col(f"_n{want}{got}") for want in (0, 1) for got in (0, 1)}
    total = n[0, 0] + n[0, 1] + n[1, 0] + n[1, 1]
    rows = []
    for k in (0, 1):
        precision = _ratio(n[k, k], n[k, k] + n[1 - k, k])
        recall = _ratio(n[k, k], n[k, k] + n[k, 1 - k])
        rows.append(
            F.struct(
                F.lit(k).alias("class"),
                precision.alias("precision"),
                recall.alias("recall"),
                _ratio(2 * precision * recall, precision + recall).alias("f1"),
                _ratio(n[0, 0] + n[1, 1], total).alias("accuracy"),
            )
        )
    return counts.select(*by, F.inline(F.array(*rows)))


def batch_metrics(
    df: DataFrame,
    key: str,
    batch_size: int = BATCH_SIZE,
    label: str = "label",
    prediction: str = "prediction",
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Mean over batches of each batch's :func:`class_metrics`.

    Batches are consecutive rows of a seeded shuffle; the last may be smaller
    and counts as much as the others.
    """
    placed = draw_position(df.select(key, label, prediction), key, seed)
    batched = placed.withColumn("_batch", F.floor((F.col("position") - 1) / batch_size))
    each = class_metrics(batched, label, prediction, ["_batch"])
    return each.groupBy("class").agg(*(F.avg(name).alias(name) for name in MEASURES))


def accuracy_pct(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of right predictions in percent, and cut to a whole number."""
    right = df.agg(F.count_if(F.col(label) == F.col(prediction)).alias("_right"), F.count("*").alias("total"))
    pct = F.try_divide(100 * F.col("_right"), F.col("total"))
    return right.select("total", F.col("_right").alias("correct"), pct.alias("accuracy")).withColumn(
        "accuracy_whole", F.floor("accuracy")
    )


def report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score"
) -> DataFrame:
    """Accuracy, F1 of class 1 and ROC AUC in one row."""
    ones = class_metrics(df, label, prediction).where(F.col("class") == 1).select("f1").scalar()
    auc = roc_auc(df, label, score).select("roc_auc").scalar()
    return accuracy_pct(df, label, prediction).select(
        F.col("accuracy_whole").alias("accuracy"), ones.alias("f1"), auc.alias("roc_auc")
    )
