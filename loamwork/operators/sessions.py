"""Conversations, session memory, and logs of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.metrics import in_ranges
from loamwork.operators.postings import containing

# How roles are written in a context.
ROLES = {"user": "Пользователь", "assistant": "Ассистент", "system": "Система"}
ORDER = ("created_at", "conv_id", "turn")


def _newest(group: str) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(c) for c in ORDER)))


def session_history(messages: DataFrame, keep: int = 50) -> DataFrame:
    """The newest `keep` messages of each session: ordinal counts all from 1, message_count is of all. Sessions are counted apart,
    so only each task's newest messages are sorted with others."""
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    newest = messages.withColumn("back", _newest("session_id").cast("long")).where(F.col("back") <= keep)
    both = newest.join(n.withColumnRenamed("session_id", "_s"), F.col("session_id").eqNullSafe(F.col("_s")))
    return both.withColumn("ordinal", F.col("message_count") - F.col("back") + 1).select("session_id", "ordinal", "message_count", "role", "conv_id", "turn")


def context_window(messages: DataFrame, size: int = 10, limit: int | None = None) -> DataFrame:
    """The newest `size` messages of each session, or `limit` if that is less."""
    n = size if limit is None else min(size, limit)
    return messages.withColumn("back", _newest("session_id").cast("long")).where(F.col("back") <= n).select("session_id", "back", "role", "text", "conv_id", "turn", "created_at")


def conversation_context(messages: DataFrame, size: int = 10, budget: int = 2000) -> DataFrame:
    """session_id, n, context: lines `Role: text` from the oldest of the window, up to the first that breaks the budget."""
    role = F.coalesce(*(F.when(F.col("role") == k, v) for k, v in ROLES.items()), F.col("role"))
    rows = context_window(messages, size).withColumn("line", F.concat(role, F.lit(": "), "text"))
    upto = F.sum(F.length("line")).over(Window.partitionBy("session_id").orderBy(F.desc("back")))
    fits = rows.withColumn("upto", upto).where(F.col("upto") <= budget)
    lines = F.sort_array(F.collect_list(F.struct(-F.col("back"), "line")))
    some = fits.groupBy("session_id").agg(lines.alias("lines"))
    return some.select("session_id", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def enriched_questions(questions: DataFrame, contexts: DataFrame, least: int = 20, most: int = 2000) -> DataFrame:
    """session_id, conv_id, turn, prompt: the question after the last `most` characters of its session's context, if that has `least`."""
    ctx = F.coalesce("context", F.lit(""))
    full = F.concat(F.lit("Контекст:\n"), F.right(ctx, F.lit(most)), F.lit("\n\nВопрос: "), F.col("question"))
    return questions.join(contexts.select("session_id", "context"), "session_id", "left").select("session_id", "conv_id", "turn", F.when(F.length(ctx) >= least, full).otherwise(F.col("question")).alias("prompt"))


def analyze_questions(questions: DataFrame) -> DataFrame:
    """kind, language, requires_knowledge, has_context, n, mean_length over all questions."""
    q = F.col("question")
    kind = F.when(F.contains(q, F.lit("?")), "factual").otherwise("conversational")
    lang = F.when(q.rlike("[а-яё]"), "ru").otherwise("en")
    words = F.size(F.filter(F.split(q, r"\s+"), lambda x: x != ""))
    return questions.groupBy(kind.alias("kind"), lang.alias("language"), (words > 3).alias("requires_knowledge"), F.contains(q, F.lit("...")).alias("has_context")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(q)).alias("mean_length"))


def latest_conversation(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, id, messages: of each session's newest conversation (ties by id), `role: text` in order of turns."""
    newest = conversations.groupBy("session_id").agg(F.max(F.struct("created_at", "id")).alias("x")).select("session_id", F.col("x.id").alias("id"))
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    lists = messages.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("m"))
    return newest.join(lists, "id").select("session_id", "id", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("messages"))


def history_page(messages: DataFrame, limit: int = 5, offset: int = 2) -> DataFrame:
    """A page of each conversation's whole history, newest first: position, total, has_more."""
    n = messages.groupBy(F.col("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("total"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("long")
    rows = messages.withColumn("position", at).where(F.col("position") <= offset + limit).where(F.col("position") > offset)
    return rows.join(n, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "position", "turn", "role", "total", (F.col("total") > offset + limit).alias("has_more"))


def session_stats(messages: DataFrame, as_of: int, active_hours: int = 24, ttl: int = 86_400) -> DataFrame:
    """session_id, n_messages, n_users (user turns), first, last (epoch seconds), active, expired at as_of."""
    s = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count(F.when(F.col("role") == "user", 1)).alias("n_users"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return s.select("*", (F.lit(as_of) - F.col("last") <= active_hours * 3600).alias("active"), (F.lit(as_of) - F.col("last") > ttl).alias("expired"))


def clear_sessions(sessions: DataFrame, messages: DataFrame, cleared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions with the count 0 where cleared, messages without those of cleared sessions)."""
    gone = cleared.select("session_id").distinct()
    marked = sessions.join(gone.withColumn("gone", F.lit(True)), "session_id", "left")
    count = F.when(F.col("gone"), F.lit(0)).otherwise(F.col("message_count")).cast("long").alias("message_count")
    return marked.select(*(count if c == "message_count" else F.col(c) for c in sessions.columns)), messages.join(gone, "session_id", "left_anti")


def merge_metadata(old: Column, new: Column) -> Column:
    """Two maps as one; keys of the new one win."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, new)


def question_key(question: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(F.lower(question), r"\s+", " ")))


def cache_replay(log: DataFrame, ttl: int = 3600) -> DataFrame:
    """event_id, hit: whether the event before it with the same question is at most ttl seconds old.

    A question's events are compared within slices of ttl seconds; a slice's first event looks at the last one of the
    slice before, for older ones are too old anyway. So a hot question is many groups.
    """
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    keyed = log.select("event_id", question_key(F.col("question")).alias("key"), t.alias("t")).withColumn("slice", F.floor(F.col("t") / ttl))
    ends = keyed.groupBy("key", "slice").agg(F.max("t").alias("end")).withColumn("slice", F.col("slice") + 1)
    before = F.lag("t").over(Window.partitionBy("key", "slice").orderBy("t", "event_id"))
    near = keyed.withColumn("before", before).join(ends, ["key", "slice"], "left")
    return near.select("event_id", F.coalesce(F.col("t") - F.coalesce("before", "end") <= ttl, F.lit(False)).alias("hit"))


def live_entries(writes: DataFrame, as_of: int, ttl: int, tags: DataFrame | None = None) -> DataFrame:
    """key, content, expired: the latest value of each key (ties by the greater content), but for those whose tag is
    invalidated. writes: key, content, created_at (and tag, where tags (tag) are given)."""
    last = writes.groupBy("key").agg(F.max(F.struct("created_at", "content", *(["tag"] if tags is not None else []))).alias("x"))
    if tags is not None:
        last = last.withColumn("tag", F.col("x.tag")).join(tags.select("tag").distinct(), "tag", "left_anti")
    return last.select("key", F.col("x.content").alias("content"), (F.lit(as_of) - F.col("x.created_at") > ttl).alias("expired"))


def memory_lookup(memory: DataFrame, queries: DataFrame, least: float = 0.3, k: int = 3) -> DataFrame:
    """query, place, key, confidence: an exact key of confidence `least` or more; else keys that contain the query, 0.9 of
    whose confidence is told. At most k for each query, by key. Exact matches are an equi-join; the other queries meet the
    keys by postings of their rarest run of three characters (see postings.containing)."""
    good = memory.where(F.col("confidence") >= least)
    q = queries.select("query").distinct()
    exact = q.join(good, F.col("query") == F.col("key")).select("query", "key", F.col("confidence").cast("double").alias("confidence"))
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    held = containing(good.select(F.col("key").alias("text")), rest.select(F.col("query").alias("needle")))
    part = held.join(good, F.col("text") == F.col("key")).select(F.col("needle").alias("query"), "key", (F.col("confidence") * 0.9).cast("double").alias("confidence"))
    w = Window.partitionBy("query").orderBy("key", F.desc("confidence"))
    return exact.unionByName(part).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).select("query", "place", "key", "confidence")


def lookup_counts(found: DataFrame, queries: DataFrame) -> DataFrame:
    """found (of memory_lookup) with accesses (answers that told the key) and hit_rate (share of distinct queries with an answer)."""
    per = found.groupBy("key").agg(F.count(F.lit(1)).alias("accesses"))
    rate = found.agg(F.count_distinct("query").alias("h")).crossJoin(queries.agg(F.count_distinct("query").alias("q"))).select((F.col("h") / F.col("q")).alias("hit_rate"))
    return found.join(per, "key").crossJoin(F.broadcast(rate)).select(*found.columns, "accesses", "hit_rate")  # one row


def memory_upsert(writes: DataFrame) -> DataFrame:
    """key, content, confidence, access_count 0: the last write of each key."""
    last = writes.groupBy("key").agg(F.max(F.struct("created_at", "content", "confidence")).alias("x"))
    return last.select("key", "x.content", "x.confidence", F.lit(0).cast("long").alias("access_count"))


def lru_trim(entries: DataFrame, most: int, order: list[str]) -> DataFrame:
    """If there are more than `most` entries, without the oldest fifth of `most` (and what exceeds it); else all.

    The rows to drop are those up to an order statistic. Counts of slices of the order say
    which slice holds it; only that slice's rows are ranked, and the slices before it go whole.
    """
    n = entries.count()
    if n <= most:
        return entries
    drop = n - most + most // 5
    b = in_ranges(entries, order)
    sizes = sorted((r["_range"], r["n"]) for r in b.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # RANGES rows at most
    seen = 0
    for at, k in sizes:
        if seen + k >= drop:
            break
        seen += k
    ranked = b.where(F.col("_range") == at).withColumn("_rn", F.row_number().over(Window.orderBy(*order))).where(F.col("_rn") > drop - seen)
    return b.where(F.col("_range") > at).select(*entries.columns).unionByName(ranked.select(*entries.columns))
