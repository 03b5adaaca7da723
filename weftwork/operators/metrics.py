"""Metrics of predicted sets, losses and moving statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.vectors import let

EPSILON = 1.1920929e-07  # fixed value: the epsilon of 32-bit floats


def set_outcomes(truth: Column, found: Column) -> list[Column]:
    """Per row: tp, fp, fn, exact in any order, exact in order, size of the truth."""
    t, p = F.array_distinct(truth), F.array_distinct(found)
    return [
        F.size(F.array_intersect(t, p)).alias("tp"),
        F.size(F.array_except(p, t)).alias("fp"),
        F.size(F.array_except(t, p)).alias("fn"),
        (F.array_sort(t) == F.array_sort(p)).cast("int").alias("exact_any"),
        (truth == found).cast("int").alias("exact_ordered"),
        F.size(t).alias("n_truth"),
    ]


def set_metrics(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracies, micro precision, recall and F1, averages; sums alone are shuffled."""
    sums = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "exact_any", "exact_ordered")]
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    precision, recall = tp / (tp + fp + EPSILON), tp / (tp + fn + EPSILON)
    return sums.select(
        *by,
        "n",
        "tp",
        "fp",
        "fn",
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / (precision + recall + EPSILON)).alias("f1"),
        (F.col("exact_any") / F.col("n")).alias("accuracy_any"),
        (F.col("exact_ordered") / F.col("n")).alias("accuracy_ordered"),
        (tp / F.col("n")).alias("avg_tp"),
    )


def distribution(outcomes: DataFrame, column: str) -> DataFrame:
    """value, n and percent of the rows."""
    counts = outcomes.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("value", "n", F.round(100 * F.col("n") / counts.agg(F.sum("n")).scalar(), 4).alias("percent"))


def predicted_items(ids: Column, specials: int = 3) -> Column:
    """Ids behind the special ones, counted from 0."""
    return F.transform(F.filter(ids, lambda x: x >= specials), lambda x: x - specials)


def nll(log_probabilities: Column, targets: Column, skip: int = 1) -> Column:
    """Mean negative log likelihood of the targets behind the first ``skip``; padding counts as any target."""
    own = F.slice(targets, F.lit(skip + 1), F.greatest(F.size(targets) - skip, F.lit(0)))
    picked = F.zip_with(log_probabilities, own, lambda row, t: F.get(row, t))
    return -F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / F.size(picked)


def weighted_loss(rows: DataFrame, loss: str, weight: str, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("loss"))


def moving_average(key: str, order: str, value: str, width: int = 50) -> Column:
    """Mean of the last ``width`` values of a key."""
    return F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - width, 0))


def moving_average_without_outliers(key: str, order: str, value: str, width: int = 50, outliers: int = 3) -> Column:
    """Mean of the last ``width`` values without those farthest from their median; fewer are left out while it fills up."""
    own = F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - width, 0))

    def without(values):
        n = F.size(values)
        s = F.array_sort(values)
        middle = let((F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2, lambda m: F.array_sort(F.transform(values, lambda x: F.struct(F.abs(x - m).alias("d"), x.alias("x")))))
        kept = F.slice(middle, F.lit(1), n - F.floor(n * outliers / width).cast("int"))
        return let(kept, lambda k: F.aggregate(k, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(k))

    return let(own, without)


def running_mean(key: str, order: str, value: str) -> Column:
    return F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def ema(items: Column, keep: float = 0.8) -> Column:
    """The exponential moving average after the last of ``items``; it starts at the first."""
    first = F.get(items, F.lit(0))
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda s, x: s * keep + x * (1 - keep))
