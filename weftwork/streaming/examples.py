"""The row-local parts over streams: examples are kept or rejected as they arrive, rejections counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators import limits


def split(stream: DataFrame, bounds: list[limits.Limit]) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and rejected rows with their violations; no state."""
    return limits.kept(stream, bounds), limits.rejected(stream, bounds)


def rejections(stream: DataFrame, bounds: list[limits.Limit], time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, reason and n; rows later than ``late`` are left out, and state goes once its window is past that."""
    rows = limits.rejected(stream.withWatermark(time, late), bounds).select(time, F.explode("violations").alias("v"))
    return rows.groupBy(F.window(time, window), F.col("v.name").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
