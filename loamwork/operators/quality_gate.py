"""The quality gate: relevance, quality, uniqueness and spam scores of documents, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.histograms import any_of
from loamwork.functions.text import AD_MARKERS, LOW_TRUST_HOSTS, PRIORITY_HOSTS, has_any, sentences, words


def match_score(query: Column, text: Column) -> Column:
    """1 if the text holds the query, else the share of the query's distinct words that it has; case is ignored."""
    q, t = F.lower(query), F.lower(F.coalesce(text, F.lit("")))
    mine = F.array_distinct(words(q))
    share = F.size(F.array_intersect(mine, words(t))) / F.size(mine)
    return F.when(F.contains(t, q), 1.0).when(F.size(mine) == 0, 0.0).otherwise(share)


def relevance(query: Column, title: Column, snippet: Column, domain: Column, priority: tuple[str, ...] = PRIORITY_HOSTS) -> Column:
    whole = match_score(query, title) * 0.4 + match_score(query, snippet) * 0.3 + F.when(has_any(F.lower(domain), priority), 0.2).otherwise(0.0)
    return F.when(query.isNull() | (query == ""), 0.7).otherwise(whole)


def with_quality(df: DataFrame, content: str, title: str, name: str = "quality") -> DataFrame:
    """df with the weighted sum of length, sentences, variety, readability, lack of junk and title, capped at 1; empty: 0.3.

    Words and sentences are columns of their own, so each text is split once.
    """
    text, head_ = F.col(content), F.col(title)
    split = df.withColumns({"_lw_said": F.filter(sentences(text), lambda x: F.length(x) >= 20), "_lw_words": words(text), "_lw_low": F.lower(text)})
    low = F.col("_lw_low")
    junk = sum((low.rlike(p).cast("int") for p in (r"http\S+", r"www\.\S+", r"\[\d+\]", "↑", "архивная копия")), F.lit(0))
    inside = F.aggregate("_lw_said", F.lit(0), lambda a, x: a + F.size(words(x)))
    counted = split.withColumns({"_lw_k": F.size("_lw_said"), "_lw_in": inside, "_lw_n": F.size("_lw_words"), "_lw_d": F.size(F.array_distinct("_lw_words")), "_lw_junk": junk}).drop("_lw_said", "_lw_words", "_lw_low")
    n, k = F.length(text), F.col("_lw_k")
    length = F.when(n >= 3000, 1.0).when(n >= 1500, 0.9).when(n >= 800, 0.8).when(n >= 400, 0.6).when(n >= 200, 0.5).otherwise(0.3)
    many = F.when(k >= 3, F.least(k / 8, F.lit(1.0))).otherwise(k / 3)
    variety = F.when(F.col("_lw_n") > 0, F.least(F.col("_lw_d") / F.col("_lw_n") * 1.2, F.lit(1.0))).otherwise(0.0)
    mean = F.col("_lw_in") / F.greatest(k, F.lit(1))
    ease = F.when(mean.between(10, 25), 1.0).when((mean < 5) | (mean > 40), 0.5).otherwise(1 - F.abs(mean - 17) / 35)
    head = F.when(F.length(head_) > 5, 1.0).when(F.length(head_) > 0, 0.6).otherwise(0.3)
    total = length * 0.3 + many * 0.2 + variety * 0.15 + ease * 0.15 + F.greatest(F.lit(0.0), 1 - F.col("_lw_junk") * 0.1) * 0.2 + head * 0.1
    return counted.withColumn(name, F.when(text.isNull() | (text == ""), 0.3).otherwise(F.least(total, F.lit(1.0)))).select(*df.columns, name)


def uniqueness(documents: DataFrame, compat: bool = False) -> DataFrame:
    """documents (url, content, seq) with uniqueness: 1.0 at a URL's first sight, else 0.3; times 0.7 under 500 characters,
    times 0.9 for a repeat (for all with compat)."""
    again = F.row_number().over(Window.partitionBy("url").orderBy("seq")) > 1
    score = F.when(again, 0.3).otherwise(1.0) * F.when(F.length("content") < 500, 0.7).otherwise(1.0)
    return documents.withColumn("uniqueness", score * (F.lit(0.9) if compat else F.when(again, 0.9).otherwise(1.0)))


def spam(domain: Column, title: Column, content: Column, blacklist: tuple[str, ...] = (), low_trust: tuple[str, ...] = LOW_TRUST_HOSTS, ads: tuple[str, ...] = AD_MARKERS, blocked: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> Column:
    text = F.lower(F.concat_ws(" ", title, content))
    held = lambda p: F.contains(text, F.lit(p.lower()))
    score = F.when(has_any(domain, blacklist), 0.2).otherwise(1.0) * F.when(has_any(domain, low_trust), 0.3).otherwise(1.0)
    for p in (*ads, *blocked):
        score = score * F.when(held(p), 0.7).otherwise(1.0)
    if required:
        score = score * F.when(any_of([~held(p) for p in required]), 0.5).otherwise(1.0)
    links = F.size(F.split(content, "http")) - 1 + F.size(F.split(content, r"www\.")) - 1
    return score * F.when(links > 5, 0.8).otherwise(1.0)


LIMITS = {"relevance": 0.65, "quality": 0.7, "uniqueness": 0.6, "spam": 0.5}


def verdict(scored: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """scored with approved and reasons: the names of the scores under their limits, with two decimals."""
    low = [F.when(F.col(k) < v, F.concat(F.lit(f"{k}: "), F.format_string("%.2f", F.col(k)))) for k, v in limits.items()]
    reasons = F.filter(F.array(*low), lambda x: x.isNotNull())
    return scored.withColumn("reasons", reasons).withColumn("approved", F.size("reasons") == 0)


def committee_stats(judged: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count(F.when(F.col("approved"), 1))
    mean = F.avg((F.col("relevance") + F.col("quality") + F.col("uniqueness")) / 3)
    return judged.agg(n.alias("evaluated"), ok.alias("approved"), (n - ok).alias("rejected"), (ok / n).alias("approval_rate"), mean.alias("average_score"))


def rejection_top(judged: DataFrame, n: int = 10) -> DataFrame:
    r = judged.select(F.explode("reasons").alias("r")).groupBy(F.split("r", ":")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return r.orderBy(F.desc("n"), "reason").limit(n)


def length_quality(length: Column) -> Column:
    return F.when(length >= 800, 0.8).when(length >= 500, 0.6).when(length >= 300, 0.4).otherwise(0.2)


def chunk_quality_gate(chunks: DataFrame, discovery: bool = False, most: int = 50) -> DataFrame:
    """chunks (doc_id, idx, text) that pass: chunk_index, total_chunks (before the gate), quality_score."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    q = chunks.withColumn("total_chunks", total).withColumn("quality_score", length_quality(F.length("text"))).where(F.col("quality_score") >= (0.2 if discovery else 0.5))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")).cast("long")
    return q.withColumn("chunk_index", at).where(F.col("chunk_index") <= (2 * most if discovery else most))
