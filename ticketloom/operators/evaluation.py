"""Classifier metrics as aggregates over prediction tables.

A prediction table has one row per (model, split, ticket): `label` and `prediction` in 0/1 and
`score`, the probability of class 1.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.operators.ranking import running_total
from ticketloom.sources.tables import staged

RUN = ("model", "split")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion(predictions: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    label, guess = F.col("label") == 1, F.col("prediction") == 1
    return predictions.groupBy(*by).agg(
        F.count_if(label & guess).alias("tp"),
        F.count_if(~label & guess).alias("fp"),
        F.count_if(label & ~guess).alias("fn"),
        F.count_if(~label & ~guess).alias("tn"),
    )


def auc(predictions: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Area under the ROC curve as a rank sum, ties counted half.

    Equal scores are merged first and the ranks come from running totals over score ranges, so
    no task sorts a whole run.
    """
    positive = F.col("label") == 1
    tied = staged(predictions.groupBy(*by, "score").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    ), "tied-scores")
    ranked = running_total(tied, "score", "neg", by=by, out="_neg_upto")
    wins = F.col("pos") * (F.col("_neg_upto") - F.col("neg") / 2)
    return (
        ranked.groupBy(*by)
        .agg(F.sum(wins).alias("_wins"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        .select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                            F.col("_wins") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))
    )


def binary_metrics(predictions: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Accuracy, F1 of the positive class and ROC-AUC per run."""
    counts = confusion(predictions, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.join(auc(predictions, by), list(by)).select(
        *by,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "roc_auc",
    )


def classification_report(predictions: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def one_class(name: str, hit: Column, false_hit: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + false_hit).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + false_hit + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    pair = confusion(predictions, by).select(
        *by, one_class("NORMAL", tn, fn, fp).alias("n"), one_class("URGENT", tp, fp, fn).alias("u")
    )
    whole = F.col("n.support") + F.col("u.support")

    def average(name: str, combine) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[combine(F.col(f"n.{m}"), F.col(f"u.{m}")).alias(m)
              for m in ("precision", "recall", "f1")],
            whole.alias("support"),
        )

    macro = average("macro avg", lambda n, u: (n + u) / 2)
    weighted = average(
        "weighted avg",
        lambda n, u: ratio(n * F.col("n.support") + u * F.col("u.support"), whole),
    )
    rows = F.explode(F.array(F.col("n"), F.col("u"), macro, weighted))
    return pair.select(*by, rows.alias("_r")).select(*by, "_r.*")


def compare_models(metrics: DataFrame, positions: Sequence[str]) -> DataFrame:
    """One row per model: validation and test metrics, their change, and the selected mark.

    Selection is by validation F1; the earlier candidate wins a tie.
    """
    def of(split: str, metric: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(metric)))

    names = ("accuracy", "f1", "roc_auc")
    wide = metrics.groupBy("model").agg(
        *[of("validation", m).alias(f"val_{m}") for m in names],
        *[of("test", m).alias(f"test_{m}") for m in names],
    )
    place = F.array_position(F.array(*[F.lit(p) for p in positions]), F.col("model"))
    # one row per candidate model, so a window over all of them is small
    best = F.max_by("model", F.struct("val_f1", -place)).over(Window.partitionBy(F.lit(1)))
    return wide.withColumns(
        {f"{m}_change": F.col(f"test_{m}") - F.col(f"val_{m}") for m in names}
    ).withColumn("is_best", F.col("model") == best)


def long_metrics(metrics: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Rows (model, split, metric, value)."""
    return metrics.unpivot(list(by), ["accuracy", "f1", "roc_auc"], "metric", "value")
