"""Search-result tables: analysis of queries, scores, merging, filters, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.text import PRIORITY_HOSTS, has_any, host, words

# What marks a kind of query, in order; words that are no keywords; what a source is worth.
KINDS = {
    "factual": ("что такое", "кто такой", "когда", "где", "сколько", "зачем"),
    "how_to": ("как сделать", "как создать", "инструкция", "руководство"),
    "news": ("новости", "сегодня", "вчера", "события"),
    "academic": ("исследование", "теория", "доказательство", "научный"),
    "tutorial": ("курс", "обучение", "урок", "практика"),
    "comparison": ("vs", "против", "сравнение", "лучше чем"),
}
QUERY_STOP = ("и", "в", "на", "с", "по", "для", "из", "от", "к", "у", "о", "не", "что", "как", "где", "когда", "почему", "зачем", "кто", "сколько")
SOURCE_WEIGHTS = {"duckduckgo": 0.4, "google": 0.3, "google_ajax": 0.2, "ddg_html": 0.25, "fallback": 0.1}
AUTHORITIES, SPAM_HOSTS = ("wikipedia", "habr", "arxiv", "stackoverflow"), ("spam", "clickbait", "adult")


def query_kind(query: Column, kinds: dict[str, tuple[str, ...]] = KINDS) -> Column:
    low = F.lower(query)
    return F.coalesce(*(F.when(has_any(low, p), k) for k, p in kinds.items()), F.lit("general"))


def keywords(query: Column, stop: tuple[str, ...] = QUERY_STOP) -> Column:
    """Distinct words of three characters or more without stop words, in order."""
    w = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(F.array_distinct(w), lambda x: (F.length(x) > 2) & ~x.isin(*stop))


def analyze_queries(queries: DataFrame, **lists) -> DataFrame:
    """kind, language, complexity, n, n_keywords (mean) over all queries."""
    k = F.size(keywords(F.col("query"), lists.get("stop", QUERY_STOP)))
    lang = F.when(F.lower("query").rlike("[а-яё]"), "ru").otherwise("en")
    hard = F.when(k > 3, "high").when(k > 1, "medium").otherwise("low")
    return queries.groupBy(query_kind(F.col("query"), lists.get("kinds", KINDS)).alias("kind"), lang.alias("language"), hard.alias("complexity")).agg(F.count(F.lit(1)).alias("n"), F.avg(k).alias("n_keywords"))


def score_results(results: DataFrame, n: int = 10, weights: dict[str, float] = SOURCE_WEIGHTS, authorities: tuple[str, ...] = AUTHORITIES, spam: tuple[str, ...] = SPAM_HOSTS, stop: tuple[str, ...] = QUERY_STOP) -> DataFrame:
    """query, place, url, score: the n best of each query."""
    h = host(F.col("url"))
    hits = F.size(F.filter(keywords(F.col("query"), stop), lambda k: F.contains(F.lower("title"), k)))
    source = F.coalesce(*(F.when(F.col("source") == k, v) for k, v in weights.items()), F.lit(0.0))
    s = F.coalesce(F.col("relevance").cast("double"), F.lit(0.5)) + F.when(has_any(h, authorities), 0.2).otherwise(0.0) + hits * 0.05 + source - F.when(has_any(h, spam), 0.5).otherwise(0.0)
    scored = results.withColumn("score", F.round(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)), 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "url")
    return scored.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("query", "place", "url", "score")


def merge_sources(results: DataFrame, priority: list[str]) -> DataFrame:
    """query, source, url: the rows of the first source, in order of priority, that returned anything; each URL once."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0))
    ranked = results.withColumn("at", F.when(at == 0, len(priority) + 1).otherwise(at))
    first = ranked.withColumn("best", F.min("at").over(Window.partitionBy("query"))).where("at = best")
    return first.select("query", "source", "url").distinct()


def filter_results(results: DataFrame, trackers: tuple[str, ...], blacklist: tuple[str, ...], foreign: tuple[str, ...] = ()) -> DataFrame:
    """Without trackers and blacklisted hosts; for Cyrillic queries without foreign hosts that name no long query word."""
    h = host(F.col("url"))
    long_ = F.filter(words(F.lower("query")), lambda w: F.length(w) >= 4)
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    odd = F.lower("query").rlike("[а-яё]") & has_any(h, foreign) & ~F.exists(long_, lambda w: F.contains(text, w))
    return results.where(~has_any(h, trackers) & ~has_any(h, blacklist) & ~odd)


def pick_urls(results: DataFrame, trash: tuple[str, ...], priority: tuple[str, ...] = PRIORITY_HOSTS, first: int = 2, total: int = 3) -> DataFrame:
    """query, place, url: up to `first` URLs of priority hosts, then others, `total` in all; without trash hosts."""
    h = host(F.col("url"))
    good = results.where(~has_any(h, trash)).withColumn("top", has_any(h, priority))
    at = F.row_number().over(Window.partitionBy("query", "top").orderBy("seq"))
    r = good.withColumn("at", at).where(~F.col("top") | (F.col("at") <= first))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("top"), "at")).cast("long")
    return r.withColumn("place", place).where(F.col("place") <= total).select("query", "place", "url")


def priority_first(results: DataFrame, n: int, priority: tuple[str, ...] = PRIORITY_HOSTS) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(has_any(host(F.col("url")), priority)), "seq")
    return results.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("query", "place", "url")


def snippet_digest(results: DataFrame, n: int = 3, cut: int = 200) -> DataFrame:
    """query, digest: numbered titles and snippets of the first n results."""
    at = F.row_number().over(Window.partitionBy("query").orderBy("seq"))
    top = results.withColumn("at", at).where(F.col("at") <= n)
    line = F.concat(F.col("at").cast("string"), F.lit(". "), "title", F.lit(": "), F.substring("snippet", 1, cut))
    x = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("x"))
    return x.select("query", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("digest"))
