"""Learning-cycle planning over graph, memory and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join


def candidate_topics(weak: DataFrame, old: DataFrame, unsure: DataFrame, n: int = 3) -> DataFrame:
    """topic, priority: weak (.8), old (.6) and low-confidence (.5) topics, the highest priority of each, the first n."""
    part = lambda df, p: df.select("topic", F.lit(p).alias("priority"))
    every = part(weak, 0.8).unionByName(part(old, 0.6)).unionByName(part(unsure, 0.5))
    return every.groupBy("topic").agg(F.max("priority").alias("priority")).orderBy(F.desc("priority"), "topic").limit(n)


def meta_analysis(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, memory: DataFrame) -> DataFrame:
    """One row: chunks, nodes, edges, confidence, advice."""
    c = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = c(chunks, "chunks").crossJoin(c(nodes, "nodes")).crossJoin(c(edges, "edges")).crossJoin(memory.agg(F.avg("confidence").alias("confidence")))  # one row each
    advice = F.array(F.when(F.col("chunks") < 100, "more_chunks"), F.when(F.col("edges") < F.col("nodes") * 0.5, "more_links"), F.when(F.col("confidence") < 0.4, "more_confidence"))
    return one.withColumn("advice", F.array_join(F.filter(advice, lambda x: x.isNotNull()), ","))


def cycle_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("type").agg(F.count(F.lit(1)).alias("executions"), F.count(F.when(F.col("success"), 1)).alias("successes"), F.count(F.when(~F.col("success"), 1)).alias("failures"), F.avg("processing_time").alias("mean_duration"), F.max("event_id").alias("last_run"))


def adaptive_priorities(tasks: DataFrame, start: float = 0.25, up: float = 1.1, down: float = 0.9) -> DataFrame:
    """type, priority: start * up^successes * down^failures, normalised; by logarithms, so long logs don't overflow."""
    s, f = F.count(F.when(F.col("success"), 1)), F.count(F.when(~F.col("success"), 1))
    x = tasks.groupBy("type").agg((F.log(F.lit(start)) + s * F.log(F.lit(up)) + f * F.log(F.lit(down))).alias("x"))
    w = Window.partitionBy()  # a row for each type
    e = x.withColumn("e", F.exp(F.col("x") - F.max("x").over(w)))
    return e.select("type", (F.col("e") / F.sum("e").over(w)).alias("priority"))


def store_topic_knowledge(facts: DataFrame, confidence: DataFrame, least: int = 50, points: int = 5, memory: float = 0.5, graph: float = 0.6) -> DataFrame:
    """kind, topic, text: a memory row, the first points of over `least` characters as documents, and a graph row, each
    behind its gate. facts: topic, place, sentence; confidence: topic, confidence."""
    j = facts.join(confidence, "topic")
    doc = j.where(F.length("sentence") > least).withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("place"))).where(F.col("r") <= points)
    three = j.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("place"))).where("r <= 3")
    whole = three.groupBy("topic", "confidence").agg(F.sort_array(F.collect_list(F.struct("place", "sentence"))).alias("s"))
    summary = F.substring(F.array_join(F.transform("s", lambda x: x["sentence"]), " "), 1, 300)
    row = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), "topic", text.alias("text"))
    return row(whole.where(F.col("confidence") >= memory), "memory", summary).unionByName(row(doc, "document", F.col("sentence"))).unionByName(row(whole.where(F.col("confidence") >= graph), "graph", summary))


def mentions(docs: DataFrame, topics: DataFrame, text: Column) -> DataFrame:
    """doc_id, topic: the topics (lower-case single words) that occur as words of a document; an equi-join on words."""
    w = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)))).alias("topic"))
    return sized_join(w, topics.select("topic").distinct(), ["topic"]).select("doc_id", "topic")


def link_topics(found: DataFrame, least: int = 1) -> DataFrame:
    """a < b, n: topics that documents mention together. found: doc_id, topic; a document mentions few of the topics."""
    b = found.select("doc_id", F.col("topic").alias("b"))
    return found.select("doc_id", F.col("topic").alias("a")).join(b, "doc_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
