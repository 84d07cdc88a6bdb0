"""Confidence policy: states, actions, values learnt from logged rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.experiments import draw
from loamwork.operators.metrics import decayed_sums

# The names of states and actions, and what each action makes of a base confidence.
ACTIONS = ("high", "medium", "low", "cautious")
FACTOR = {"high": 0.9, "medium": 0.7, "low": 0.4, "cautious": 0.2}
STATES = ("factual_known", "factual_unknown", "conversational_known", "conversational_unknown", "ambiguous")


def state_of(question: Column, known: Column) -> Column:
    """factual (with `?`) or conversational, with or without knowledge; ambiguous where a part is null."""
    kind = F.when(F.contains(question, F.lit("?")), "factual").otherwise("conversational")
    return F.when(question.isNull() | known.isNull(), "ambiguous").otherwise(F.concat(kind, F.when(known, "_known").otherwise("_unknown")))


def start_value(action: Column) -> Column:
    return F.when(action == "medium", 0.5).otherwise(0.3)


def q_table(log: DataFrame, rate: float = 0.1) -> DataFrame:
    """state, action, n, q after q += rate * (reward - q) over the log (state, action, reward, seq) in order of seq.

    In closed form: (1 - rate)^n * q0 + sum of rate * (1 - rate)^(n - i) * reward_i, summed by ranges of seq.
    """
    sums = decayed_sums(log, ["state", "action"], ["seq"], "reward", 1 - rate)
    return sums.select("state", "action", "n", (F.pow(F.lit(1 - rate), F.col("n")) * start_value(F.col("action")) + rate * F.col("total")).alias("q"))


def choose_actions(rows: DataFrame, q: DataFrame, explore: float = 0.3, seed: str = "e") -> DataFrame:
    """event_id, state, explored, action: by draws a random action, else the best of the state (ties in order of ACTIONS)."""
    known = q.select("state", "action", "q")
    s = rows.sparkSession
    grid = s.createDataFrame([(x, a, i) for x in STATES for i, a in enumerate(ACTIONS)], "state string, action string, place int")
    full = grid.join(known, ["state", "action"], "left").withColumn("q", F.coalesce("q", start_value(F.col("action"))))
    best = full.groupBy("state").agg(F.min_by("action", F.struct(-F.col("q"), F.col("place"))).alias("best"))
    x, y = draw(F.col("event_id"), seed), draw(F.col("event_id"), seed + "2")
    any_ = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.floor(y * len(ACTIONS)) + 1).cast("int"))
    out = rows.join(F.broadcast(best), "state")  # a row for each state
    return out.select("event_id", "state", (x < explore).alias("explored"), F.when(x < explore, any_).otherwise(F.col("best")).alias("action"))


def adjusted_confidence(action: Column, score: Column, known: Column) -> Column:
    base = F.coalesce(*(F.when(action == a, v) for a, v in FACTOR.items()), F.lit(0.5))
    return F.least(F.greatest(F.when(known, base * (0.5 + 0.5 * score)).otherwise(base * 0.5), F.lit(0.0)), F.lit(1.0))


def answer_band(confidence: Column, known: Column) -> Column:
    return F.when(~known, "greeting").when(confidence > 0.7, "sure").when(confidence > 0.4, "likely").otherwise("unsure")


def policy_report(log: DataFrame, rate: float = 0.1) -> DataFrame:
    """state, action, n, mean_reward, success_rate, share (of the state's actions), q."""
    per = log.groupBy("state", "action").agg(F.avg("reward").alias("mean_reward"), F.avg((F.col("reward") > 0).cast("double")).alias("success_rate"))
    both = per.join(q_table(log, rate), ["state", "action"])
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))
