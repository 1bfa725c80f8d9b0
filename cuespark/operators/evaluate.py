"""Metrics over a prediction table: one row per evaluated post, columns `label`, `prediction`.

Everything is computed from counts per (label, prediction), so tables of any size shrink to a
few rows inside the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, by: list[str] | None = None, label="label", prediction="prediction"):
    """Share of correct predictions, per `by` if given."""
    same = F.col(label) == F.col(prediction)
    return df.groupBy(*(by or [])).agg(
        F.avg(same.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("test_samples")
    )


def pair_counts(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """(label, prediction, n) for every pair of classes, zeros included."""
    folded = pair_counts(df, label, prediction).agg(
        F.collect_list(F.struct("label", "prediction", "n")).alias("cells"),
        F.array_distinct(F.concat(F.collect_set("label"), F.collect_set("prediction"))).alias("c"),
    )  # one row; its arrays have as many elements as the matrix has cells
    zeros = F.flatten(
        F.transform(
            "c",
            lambda a: F.transform(
                F.col("c"),
                lambda b: F.struct(
                    a.alias("label"), b.alias("prediction"), F.lit(0).cast("bigint").alias("n")
                ),
            ),
        )
    )
    cells = folded.select(F.inline(F.concat("cells", zeros)))
    return cells.groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    counts = pair_counts(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    hit.alias("hits"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )

    def ratio(a, b):  # 0 where undefined
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return sums.select(
        "class",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(F.col("hits") * 2.0, F.col("predicted") + F.col("support")).alias("f1_score"),
        "support",
        "hits",
    )


def classification_report(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy, macro and weighted averages.

    The accuracy row carries its value in all three metric columns.
    """
    classes = _per_class(df, label, prediction)
    metrics = ("precision", "recall", "f1_score")
    total = F.sum("support")

    def line(name: str, value) -> Column:
        return F.struct(
            F.lit(name).alias("class"), *[value(m).alias(m) for m in metrics], total.alias("support")
        )

    each = F.struct(F.col("class").cast("string").alias("class"), *metrics, "support")
    # One row per class: folded into one row, the lines need no second pass.
    folded = classes.agg(
        F.collect_list(each).alias("each"),
        F.array(
            line("accuracy", lambda m: F.try_divide(F.sum("hits"), total)),
            line("macro avg", F.avg),
            line("weighted avg", lambda m: F.try_divide(F.sum(F.col(m) * F.col("support")), total)),
        ).alias("averages"),
    )
    return folded.select(F.inline(F.concat("each", "averages")))


def class_distribution(df: DataFrame, label: str = "gender", split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def cv_summary(df: DataFrame, by: list[str] | None = None, fold: str = "fold") -> DataFrame:
    """Mean and population std of the fold accuracies of given predictions."""
    folds = accuracy(df, [*(by or []), fold])
    return folds.groupBy(*(by or [])).agg(
        F.avg("accuracy").alias("cv_accuracy_mean"),
        F.stddev_pop("accuracy").alias("cv_accuracy_std"),
        F.sum("test_samples").alias("training_samples"),
    )


def best_model(results: DataFrame, by: str = "method") -> DataFrame:
    """Per method the most accurate model; a failed one counts as 0, the first wins a tie.

    `results` has one row per (method, model) with `ord` (training order) and `accuracy`.
    """
    score = F.struct(F.coalesce("accuracy", F.lit(0.0)), -F.col("ord"))
    scored = F.when(F.col("accuracy").isNotNull(), F.struct("model", "accuracy"))
    return results.groupBy(by).agg(
        F.max_by("model", score).alias("best_model"),
        F.max_by("accuracy", score).alias("best_accuracy"),
        F.map_from_entries(F.collect_list(scored)).alias("model_results"),
    )


def method_ranking(best: DataFrame) -> DataFrame:
    """Methods by best accuracy, ties by name; one row per method is sorted."""
    return best.orderBy(F.desc_nulls_last("best_accuracy"), "method")
