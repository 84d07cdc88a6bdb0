"""Metric tables: counters, histograms, windows, rates, alerts."""

from __future__ import annotations

import functools
from collections import namedtuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.histograms import cumulative_buckets
from loamwork.functions.storage import stage


#: Most ranges, and the rows for which there is another one.
RANGES, RANGE_ROWS = 1024, 50_000


def in_ranges(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with _range: slices of about equal size in the order of some columns, ascending, so that a key's history is many
    groups. A written table, since the cuts are quantiles of a sample (as Spark deals rows by range) and must be the same for all
    who read it. Rows of one first column are parted by the others; only rows that agree in all of them stay together."""
    n = ranges or min(RANGES, max(1, -(-rows.count() // RANGE_ROWS)))
    if n == 1:
        return rows.withColumn("_range", F.lit(0))
    return stage(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def decayed_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, keep: float) -> DataFrame:
    """keys, n, total (the sum of keep^(rows after it) * value), first (the first value): the fold of a decaying average.

    The sum of a range decays by the rows of the ranges after it, so ranges are summed apart and then put together.
    """
    b = in_ranges(rows, order)
    back = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*(F.desc(c) for c in order))) - 1
    part = b.withColumn("_x", F.pow(F.lit(keep), back) * F.col(value)).groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_x").alias("_s"), F.min_by(value, F.struct(*order)).alias("_first"))
    later = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most RANGES rows
    whole = part.withColumn("_s", F.pow(F.lit(keep), later) * F.col("_s"))
    return whole.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_s").alias("total"), F.min_by("_first", "_range").alias("first"))


def system_stats(requests: DataFrame) -> DataFrame:
    """One row: questions, errors, cache hits, mean seconds (0 if none)."""
    return requests.agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("error"), 1)).alias("errors"), F.count(F.when(F.col("from_cache"), 1)).alias("cache_hits"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds"))


def latency_histogram(requests: DataFrame, bounds: tuple[float, ...] = (0.1, 0.5, 1, 2, 5, 10), by: list[str] | None = None) -> DataFrame:
    return cumulative_buckets(requests, F.col("seconds"), list(bounds), by)


def error_counts(requests: DataFrame) -> DataFrame:
    return requests.where("error").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def labelled_counters(requests: DataFrame) -> DataFrame:
    """endpoint, from_cache, n, last (the newest value; ties by event_id)."""
    return requests.groupBy("endpoint", "from_cache").agg(F.count(F.lit(1)).alias("n"), F.max_by("seconds", F.struct("ts", "event_id")).alias("last"))


def windowed_rates(requests: DataFrame, minutes: int = 5) -> DataFrame:
    """start (epoch seconds), n, per_second, mean_seconds, hit_ratio for each tumbling window with requests."""
    w = requests.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_seconds"), F.avg(F.col("from_cache").cast("double")).alias("hit_ratio"))
    start = F.unix_timestamp(F.col("w.start").cast("timestamp"))
    return w.select(start.alias("start"), "n", (F.col("n") / (60.0 * minutes)).alias("per_second"), "mean_seconds", "hit_ratio")


def numbered_by_key(series: DataFrame, key: str, order: list[str]) -> DataFrame:
    """series with _rn (1, 2, ... within the key, in order; by ranges of the order) and _total (rows of the key)."""
    b = in_ranges(series, order)
    sizes = b.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)  # at most RANGES rows a key
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(w).alias("_total"))
    at = b.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    joined = at.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return joined.select(*series.columns, (F.col("_at") + F.col("_before")).alias("_rn"), "_total")


def moving_average(series: DataFrame, key: str, order: list[str], value: str, width: int = 5, slice_rows: int = 100_000) -> DataFrame:
    """key, order, value, average of the last `width` values: null before as many, or if there are not more than that.

    A key's rows are averaged by slices of slice_rows; the last rows of a slice are lent to the one after it.
    """
    rows = numbered_by_key(series.select(key, *order, value), key, order)
    own = F.floor((F.col("_rn") - 1) / slice_rows)
    lent = (F.col("_rn") - 1) % slice_rows >= slice_rows - (width - 1)
    sent = rows.withColumn("_slice", F.explode(F.when(lent, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_own", F.col("_slice") == own)
    near = Window.partitionBy(key, "_slice").orderBy("_rn").rowsBetween(1 - width, 0)
    full = (F.count(F.lit(1)).over(near) == width) & (F.col("_total") > width)
    out = sent.withColumn("average", F.when(full, F.avg(value).over(near))).where("_own")
    return out.select(key, *order, value, "average")


def task_ewma(tasks: DataFrame, keep: float = 0.9) -> DataFrame:
    """type, processed, failed, avg_time: first value, then keep * old + (1 - keep) * new in order (ts, event_id). Times > 0.

    Closed form: the first value weighs keep^(n-1), the i-th (1 - keep) * keep^(n-i).
    """
    rows = tasks.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    sums = decayed_sums(rows, ["type"], ["at", "event_id"], "processing_time", keep)
    counts = tasks.groupBy("type").agg(F.count(F.when(F.col("success"), 1)).alias("processed"), F.count(F.when(~F.col("success"), 1)).alias("failed"))
    value = (1 - keep) * F.col("total") + keep * F.pow(F.lit(keep), F.col("n") - 1) * F.col("first")
    return counts.join(sums, "type").select("type", "processed", "failed", value.alias("avg_time"))


def running_mean(series: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, order, running_mean of all values up to the row. A key's rows are summed by ranges of the order, then within a range."""
    b = in_ranges(series, order)
    sums = b.groupBy(key, "_range").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a key
    starts = sums.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    w = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = b.withColumns({"_s": F.sum(value).over(w), "_n": F.count(value).over(w)})
    both = near.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return both.select(key, *order, ((F.coalesce("_s", F.lit(0)) + F.col("_s0")) / F.nullif(F.col("_n") + F.col("_n0"), F.lit(0))).alias("running_mean"))


def hourly_profile(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean_seconds"))


def value_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (0 to bins - 1) and n, of equal width from the least to the greatest value; empty bins have no row."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: A rule of alerts: kind (errors: more than limit a second; silent: no requests; gauge: the newest value over limit), the
#: minutes that an evaluation looks back over, and those for which it must hold before it fires.
AlertRule = namedtuple("AlertRule", "name kind limit window hold")


def metric_bins(requests: DataFrame, step: int, by: list[str]) -> DataFrame:
    """by, bin (`step` minutes each, counted from the epoch), n, errors, last (the newest value of seconds; ties by event_id)."""
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (step * 60))
    return requests.where("ts IS NOT NULL").groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("error"), 1)).alias("errors"), F.max_by("seconds", F.struct("ts", "event_id")).alias("last"))


def alert_intervals(bins: DataFrame, rule: AlertRule, step: int, by: list[str]) -> DataFrame:
    """rule, by, pending, firing, resolved (epoch seconds) of every run of evaluations in which the rule holds.

    bins: of metric_bins. Each key is evaluated at the end of every bin from its first to its last, over the bins of the last
    `window` minutes; bins without requests count as empty. A run is pending from its first evaluation, fires at the
    first one `hold` minutes later (null if the run is shorter) and is resolved at the first that fails (null if none does).
    """
    back = rule.window // step
    ends = bins.groupBy(*by).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    grid = ends.select(*by, F.explode(F.sequence("_a", "_b")).alias("bin"), "_b")
    same = lambda x, y: functools.reduce(lambda p, q: p & q, [x[c].eqNullSafe(y[c]) for c in by], x["bin"] == y["bin"])
    full = grid.join(bins, same(grid, bins), "left").select(*(grid[c] for c in [*by, "bin", "_b"]), "n", "errors", "last")
    seen = Window.partitionBy(*by).orderBy("bin").rowsBetween(1 - back, 0)  # a key's bins: its time span over `step`
    value = {
        "errors": F.coalesce(F.sum("errors").over(seen), F.lit(0)) / (rule.window * 60) > rule.limit,
        "silent": F.coalesce(F.sum("n").over(seen), F.lit(0)) == 0,
        "gauge": F.coalesce(F.last("last", True).over(seen) > rule.limit, F.lit(False)),
    }[rule.kind]
    held = full.withColumn("holds", value).where("holds")
    run = held.withColumn("_run", F.col("bin") - F.row_number().over(Window.partitionBy(*by).orderBy("bin")))
    runs = run.groupBy(*by, "_run", "_b").agg(F.min("bin").alias("_first"), F.max("bin").alias("_last"))
    time = lambda c: (c + 1) * step * 60
    fires = F.col("_first") + -(-rule.hold // step)
    return runs.select(
        F.lit(rule.name).alias("rule"), *by, time(F.col("_first")).alias("pending"),
        F.when(fires <= F.col("_last"), time(fires)).alias("firing"), F.when(F.col("_last") < F.col("_b"), time(F.col("_last") + 1)).alias("resolved"),
    )


def topic_engagement(events: DataFrame, topic: str, n: int = 5) -> DataFrame:
    """The n topics with most events: n, engagement (per user), ctr, relative (to the first), tier."""
    per = events.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.count_distinct("user_id")).alias("engagement"), F.avg((F.col("event_type") == "click").cast("double")).alias("ctr"))
    top = per.orderBy(F.desc("n"), "topic").limit(n).withColumn("relative", F.col("n") / F.max("n").over(Window.partitionBy()))  # n rows
    return top.withColumn("tier", F.when(F.col("relative") >= 0.9, "high").when(F.col("relative") >= 0.6, "medium").otherwise("low"))


def source_breakdown(docs: DataFrame) -> DataFrame:
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # a row for each source
