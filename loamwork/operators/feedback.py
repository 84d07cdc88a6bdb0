"""Feedback: validation, statistics, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.histograms import cumulative_buckets


def validate_feedback(feedback: DataFrame, most_comment: int = 1000) -> DataFrame:
    """id and reason: null if valid, else bad_rating (not 1 to 5) or long_comment."""
    bad = ~F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    long_ = F.coalesce(F.length("comment") > most_comment, F.lit(False))
    return feedback.select("id", F.when(bad, "bad_rating").when(long_, "long_comment").alias("reason"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def feedback_statistics(feedback: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row: totals, averages and counts of all feedback, and total and average of the last `days`."""
    recent = F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    count = lambda c: F.count(F.when(c, 1))
    stars = [count(F.col("rating") == i).alias(f"rating_{i}") for i in range(1, 6)]
    h = F.col("helpful")
    return feedback.agg(F.count(F.lit(1)).alias("total"), F.avg("rating").alias("average_rating"), *stars, count(h).alias("helpful"), count(~h).alias("not_helpful"), count(h.isNull()).alias("unknown"), count(recent).alias("recent_total"), F.avg(F.when(recent, F.col("rating"))).alias("recent_average"))


def rating_distribution(feedback: DataFrame) -> DataFrame:
    """rating 1 to 5, n (0 where none), percent."""
    five = feedback.sparkSession.range(1, 6).withColumnRenamed("id", "rating")
    counts = feedback.groupBy(F.col("rating").cast("long").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    joined = five.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # five rows
    return joined.select("rating", "n", (_share(F.col("n"), total) * 100).alias("percent"))


def helpful_distribution(feedback: DataFrame) -> DataFrame:
    """One row: helpful, not_helpful, unknown, and helpful's share of those who said."""
    h = F.col("helpful")
    c = feedback.agg(F.count(F.when(h, 1)).alias("helpful"), F.count(F.when(~h, 1)).alias("not_helpful"), F.count(F.when(h.isNull(), 1)).alias("unknown"))
    return c.select("*", _share(F.col("helpful"), F.col("helpful") + F.col("not_helpful")).alias("helpful_rate"))


def comment_length_histogram(feedback: DataFrame) -> DataFrame:
    return cumulative_buckets(feedback.where("comment IS NOT NULL"), F.length("comment"), [10, 50, 100, 200, 500, 1000])


def conversation_feedback(feedback: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """Each conversation's page of feedback, newest first (ties by id, falling): position, total, has_more."""
    w = Window.partitionBy("conversation_id")
    rows = feedback.withColumn("position", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("id"))).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    page = rows.where((F.col("position") > offset) & (F.col("position") <= offset + limit))
    return page.select("conversation_id", "position", "id", "rating", "total", (F.col("total") > offset + limit).alias("has_more"))


def feedback_lookup(feedback: DataFrame, metadata: str, path: str, value: str) -> DataFrame:
    """Rows whose JSON metadata column holds `value` at `path`."""
    return feedback.where(F.get_json_object(F.col(metadata), path) == value)


def reward(helpful: Column, rating: Column) -> Column:
    """-1 or 1 by helpful where it is given, else by rating; 0 if unknown."""
    by = F.when(rating == 1, -0.8).when(rating == 2, -0.4).when(rating == 3, 0.0).when(rating == 4, 0.6).when(rating == 5, 1.0)
    return F.when(helpful, 1.0).when(~helpful, -1.0).otherwise(F.coalesce(by, F.lit(0.0)))


def feedback_rewards(feedback: DataFrame) -> DataFrame:
    """n and mean reward by rating and helpful."""
    r = reward(F.col("helpful"), F.col("rating"))
    return feedback.withColumn("reward", r).groupBy("rating", "helpful").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))


def satisfaction_trend(feedback: DataFrame, unit: str = "day") -> DataFrame:
    """unit (day or hour), slot (text), n, average, rate of ratings of 4 or more, and trend: the sign of the second half's
    rate less the first's."""
    slot = F.date_format("created_at", {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH"}[unit])
    daily = feedback.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("average"), F.count(F.when(F.col("rating") >= 4, 1)).alias("good"))
    at, n = F.row_number().over(Window.orderBy("slot")), F.count(F.lit(1)).over(Window.partitionBy())  # a row for each slot
    half = daily.withColumn("second", at > F.floor(n / 2))
    rate = lambda c: F.sum(F.when(c, F.col("good"))).over(Window.partitionBy()) / F.sum(F.when(c, F.col("n"))).over(Window.partitionBy())
    trend = F.coalesce(F.signum(rate(F.col("second")) - rate(~F.col("second"))), F.lit(0.0)).cast("int")
    return half.select(F.lit(unit).alias("unit"), "slot", "n", "average", (F.col("good") / F.col("n")).alias("rate"), trend.alias("trend"))
