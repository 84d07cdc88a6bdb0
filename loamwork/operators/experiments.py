"""Experiments: assignment, exposure, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_of(user: Column, experiment: str, variants: list[str]) -> Column:
    """The variant of a known user: the first eight hex digits of md5(user:experiment), mod the number of variants."""
    n = F.conv(F.substring(F.md5(F.concat(user.cast("string"), F.lit(f":{experiment}"))), 1, 8), 16, 10).cast("long") % len(variants)
    return F.element_at(F.array(*map(F.lit, variants)), (n + 1).cast("int"))


def assign_variants(users: DataFrame, experiment: str, variants: list[str]) -> DataFrame:
    return users.select("user_id").distinct().withColumn("variant", variant_of(F.col("user_id"), experiment, variants))


def draw(key: Column, seed: str) -> Column:
    """A number from 0 to under 1 by hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def assign_weighted(rows: DataFrame, key: str, weights: dict[str, float], seed: str = "w") -> DataFrame:
    """The first variant whose cumulative weight reaches the row's draw."""
    x, total, at = draw(F.col(key), seed), sum(weights.values()), 0.0
    cases = None
    for name, w in weights.items():
        at += w / total
        cases = F.when(x <= at, name) if cases is None else cases.when(x <= at, name)
    return rows.select(key, cases.otherwise(list(weights)[-1]).alias("variant"))


def exposure_events(events: DataFrame, experiment: str, variants: list[str]) -> DataFrame:
    """event_id, experiment, variant, user_id (anonymous where it is null)."""
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous"))
    return events.select("event_id", F.lit(experiment).alias("experiment"), variant_of(user, experiment, variants).alias("variant"), user.alias("user_id"))


def last_days(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """The rows of the `days` days up to as_of (text of a time)."""
    end, at = F.lit(as_of).cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")
    return rows.where((at > end - F.make_dt_interval(F.lit(days))) & (at <= end))


def experiment_results(events: DataFrame, experiment: str, variants: list[str], z: float = 1.96) -> DataFrame:
    """variant, n, conversion, satisfaction, engagement, z against the first variant, significant, best."""
    v = variant_of(F.col("user_id"), experiment, variants)
    rate = lambda c: F.avg(F.col(c).cast("double"))
    per = events.withColumn("variant", v).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), rate("converted").alias("conversion"), F.avg("rating").alias("satisfaction"), rate("engaged").alias("engagement"))
    control = per.where(F.col("variant") == variants[0]).select(F.col("n").alias("n0"), F.col("conversion").alias("c0"))
    top = per.agg(F.max("conversion").alias("top"))
    pooled = (F.col("c0") * F.col("n0") + F.col("conversion") * F.col("n")) / (F.col("n0") + F.col("n"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n0") + 1 / F.col("n")))
    score = F.when(error > 0, (F.col("conversion") - F.col("c0")) / error).otherwise(0.0)
    out = per.crossJoin(F.broadcast(control)).crossJoin(F.broadcast(top)).withColumn("z", score)  # one row each
    return out.select("variant", "n", "conversion", "satisfaction", "engagement", "z", (F.abs("z") > z).alias("significant"), (F.col("conversion") == F.col("top")).alias("best"))
