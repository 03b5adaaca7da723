"""Limits on examples: predicates, the split into kept and rejected, the report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    """``value`` must lie between ``least`` and ``most``; None: no bound; a null value breaks nothing."""

    name: str
    value: Column
    least: float | None = None
    most: float | None = None

    def broken(self) -> Column:
        v = self.value.cast("double")
        low = F.lit(False) if self.least is None else F.coalesce(v < self.least, F.lit(False))
        high = F.lit(False) if self.most is None else F.coalesce(v > self.most, F.lit(False))
        return low | high

    def record(self) -> Column:
        bound = lambda x: F.lit(x).cast("double")
        return F.struct(F.lit(self.name).alias("name"), self.value.cast("double").alias("value"), bound(self.least).alias("least"), bound(self.most).alias("most"))


def violations(limits: list[Limit]) -> Column:
    """All limits that a row breaks, in order: array of name, value, least, most."""
    return F.array_compact(F.array(*[F.when(x.broken(), x.record()) for x in limits]))


def with_violations(rows: DataFrame, limits: list[Limit]) -> DataFrame:
    return rows.withColumn("violations", violations(limits))


def kept(rows: DataFrame, limits: list[Limit]) -> DataFrame:
    """The rows that break no limit; a filter, so it reaches the scan where it can."""
    return rows.where(~reduce(lambda a, b: a | b, [x.broken() for x in limits]))


def rejected(rows: DataFrame, limits: list[Limit]) -> DataFrame:
    return with_violations(rows, limits).where(F.size("violations") > 0)


def staged(rows: DataFrame, stages: list[list[Limit]]) -> DataFrame:
    """With the violations of the first stage that a row fails; later stages are not looked at then."""
    found = F.expr("cast(array() as array<struct<name: string, value: double, least: double, most: double>>)")
    for limits in reversed(stages):
        own = violations(limits)
        found = F.when(F.size(own) > 0, own).otherwise(found)
    return rows.withColumn("violations", found)


def report(rows: DataFrame) -> DataFrame:
    """Of rows with violations: per limit and side the count, its share of all, mean and deviation of finite values."""
    v = rows.select(F.explode("violations").alias("v")).select("v.*")
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    side = F.concat("name", F.when(F.coalesce(F.col("value") > F.col("most"), F.lit(False)), "+").otherwise("-"))
    counts = v.groupBy(side.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(finite).alias("mean"),
        F.coalesce(F.stddev_samp(finite), F.lit(0.0)).alias("std"),
        F.count_if(F.abs("value") == float("inf")).alias("n_inf"),
        F.count_if(F.isnan("value")).alias("n_nan"),
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("reason", "n", F.round(100 * F.col("n") / total, 2).alias("percent"), "mean", "std", "n_inf", "n_nan")


def mean_variance(value: Column) -> list[Column]:
    """Aggregates: count, mean, unbiased variance (0 for one point) of finite values, and infinities."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return [
        F.count(finite).alias("n"),
        F.avg(finite).alias("mean"),
        F.when(F.count(finite) > 0, F.coalesce(F.var_samp(finite), F.lit(0.0))).alias("variance"),
        F.count_if(F.abs(value) == float("inf")).alias("n_inf"),
    ]
