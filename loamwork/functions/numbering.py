"""Gapless row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, order: list[str], name: str, groups: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Add `name`: 0, 1, 2, ... over all rows (or within `groups`), in the order (hash bucket of `order`, `order`).

    Rows are dealt to buckets by a hash of `order` (a bucket for every 500,000 rows, 1024 at least); a bucket's rows are
    numbered by a window, and the sizes of the buckets before it are added. No task holds more than a bucket. `df` is
    read three times, so stage it if it is costly.
    Rows that agree in all of `order` share a bucket and are interchangeable. The numbers depend on the data alone.
    """
    groups, buckets = groups or [], buckets or max(1024, df.count() // 500_000)
    b = "_lw_bucket"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("_lw_n"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, b, F.coalesce(F.sum("_lw_n").over(before), F.lit(0)).alias("_lw_start"))
    inside = Window.partitionBy(*groups, b).orderBy(*order)
    at: Column = F.row_number().over(inside).cast("long") - 1
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in groups] + [F.col(f"l.{b}") == F.col(f"r.{b}")]
    if not groups:  # at most `buckets` rows
        starts = F.broadcast(starts)
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    kept = [F.col(f"l.{c}") for c in df.columns]
    return rows.withColumn("_lw_at", at).alias("l").join(starts.alias("r"), on).select(*kept, (F.col("_lw_at") + F.col("_lw_start")).alias(name))
