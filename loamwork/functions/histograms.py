"""Histograms with fixed upper bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cumulative_buckets(df: DataFrame, value: Column, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """by, le (text; +Inf last), n (rows of value <= le), total (sum of values): one pass, then a row for each bound."""
    by = by or []
    counts = [F.count(F.when(value <= b, 1)).alias(f"c{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*counts, F.count(value).alias("c_all"), F.sum(value.cast("double")).alias("total"))
    cells = F.array(*(F.struct(F.lit(_text(b)).alias("le"), F.col(f"c{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("c_all").alias("n")))
    return wide.select(*by, "total", F.explode(cells).alias("x")).select(*by, "x.le", "x.n", "total")


def _text(b: float) -> str:
    return f"{b:g}"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
