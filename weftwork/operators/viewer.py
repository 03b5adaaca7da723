"""Typed filters, quantifiers and feature statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE: dict[str, Callable] = {
    "Equals": lambda c, v: c == v,
    "GreaterEqual": lambda c, v: c >= v,
    "GreaterThan": lambda c, v: c > v,
    "LowerEqual": lambda c, v: c <= v,
    "LowerThan": lambda c, v: c < v,
    "In": lambda c, v: c.isin(list(v)),
    "NotIn": lambda c, v: ~c.isin(list(v)),
}
#: Operators that a kind of feature allows.
ALLOWED = {
    "Boolean": {"Equals"},
    "Categorical": {"Equals", "In", "NotIn"},
    "Textual": {"Equals", "In", "NotIn"},
    "Numerical": set(COMPARE),
}


def predicate(kind: str, column: Column, op: str, value) -> Column:
    if op not in ALLOWED[kind]:
        raise ValueError(f"{op} does not apply to {kind} features")
    return COMPARE[op](column, value)


def all_of(filters: list[tuple[str, str, str, object]]) -> Column:
    """The conjunction of (kind, column, operator, value)."""
    out = F.lit(True)
    for kind, column, op, value in filters:
        out = out & predicate(kind, F.col(column), op, value)
    return out


def quantified(items: Column, quantifier: str, test: Callable[[Column], Column]) -> Column:
    return {"Exists": F.exists, "ForAll": F.forall}[quantifier](items, test)


def confusion(truth: Column, found: Column) -> Column:
    """TP, FP, TN or FN of a binary outcome."""
    return F.when(truth, F.when(found, "TP").otherwise("FN")).otherwise(F.when(found, "FP").otherwise("TN"))


def boolean_stats(rows: DataFrame, **features: Column) -> DataFrame:
    """feature, n_true, n_false."""
    wide = rows.agg(*[F.struct(F.count_if(c).alias("t"), F.count_if(~c).alias("f")).alias(n) for n, c in features.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}.t").alias("n_true"), F.col(f"{n}.f").alias("n_false")) for n in features])).alias("s")).select("s.*")


def categorical_stats(rows: DataFrame, *features: str) -> DataFrame:
    """feature, value, n of several features in one pass."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("value")) for n in features])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.feature", "c.value").agg(F.count(F.lit(1)).alias("n"))


def numeric_stats(rows: DataFrame, column: str, by: list[str] = (), points: tuple = (0.25, 0.75, 0.9)) -> DataFrame:
    """Count, mean, extremes, median, deviation and percentiles (exact, interpolated)."""
    return rows.groupBy(*by).agg(
        F.count(column).alias("n"),
        F.avg(column).alias("avg"),
        F.max(column).alias("max"),
        F.min(column).alias("min"),
        F.median(column).alias("median"),
        F.stddev_samp(column).alias("stddev"),
        *[F.percentile(F.col(column), F.lit(p)).alias(f"p{round(100 * p)}") for p in points],
    )


def filtered_counts(rows: DataFrame, test: Column) -> DataFrame:
    """total and filtered, in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(test).alias("filtered"))
