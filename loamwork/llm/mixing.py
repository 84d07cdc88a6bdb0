"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.storage import stage

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def capped_shares(sizes: list[int], weights: list[float], total: float, copies: float) -> list[float]:
    """Share `total` by weight; no share exceeds copies * size, and what exceeds it is shared again by weight."""
    shares, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if left * weights[i] / w > copies * sizes[i]]
        if not full:
            for i in open_:
                shares[i] = left * weights[i] / w
            break
        for i in full:
            shares[i] = float(copies * sizes[i])
            open_.discard(i)
        left = total - sum(shares[i] for i in range(len(sizes)) if i not in open_)
    return shares


def route(patterns: list[tuple[tuple, int]], quotas: dict, copies: int) -> list[dict]:
    """Flow from patterns to quotas. patterns: (sources, words). Returns for each pattern the words sent to each source.

    The network has an arc from each pattern to each of its sources. A pattern's first `words` words cost nothing, the
    next `words` cost 1 each, then 2, and so on (repetition costs are convex), up to `copies` times. Paths of equal
    cost are those that start in one tier, so augmenting tier by tier gives a flow of greatest size and least cost.
    """
    sent: list[dict] = [{s: 0 for s in dict.fromkeys(p)} for p, _ in patterns]
    need = {s: int(round(q)) for s, q in quotas.items()}
    holders: dict = {}
    for i, p in enumerate(sent):
        for s in p:
            holders.setdefault(s, []).append(i)
    spare = [0] * len(patterns)
    for _ in range(copies):
        for i, (_, words) in enumerate(patterns):
            spare[i] += words
            for s in sent[i]:
                x = min(spare[i], need.get(s, 0))
                if x > 0:
                    sent[i][s] += x
                    spare[i] -= x
                    need[s] -= x
        while path := _augmenting(sent, spare, need, holders):
            x = min(spare[path[0][0]], need[path[-1][1]], *(sent[j][s] for (_, s), (j, _) in zip(path, path[1:], strict=False)))
            spare[path[0][0]] -= x
            need[path[-1][1]] -= x
            for i, s in path:
                sent[i][s] += x
            for (_, s), (j, _) in zip(path, path[1:], strict=False):
                sent[j][s] -= x
    return sent


def _augmenting(sent: list[dict], spare: list[int], need: dict, holders: dict) -> list | None:
    """A shortest path of (pattern, source) arcs from a pattern with words to spare to a source in need."""
    came: dict = {}
    todo = deque(i for i in range(len(sent)) if spare[i] > 0)
    seen = set(todo)
    while todo:
        i = todo.popleft()
        for s in sent[i]:
            if s in came:
                continue
            came[s] = i
            if need.get(s, 0) > 0:
                path = [(i, s)]
                while (back := came.get(("p", path[0][0]))) is not None:
                    path.insert(0, (came[back], back))
                return path
            for j in holders[s]:
                if j not in seen and sent[j][s] > 0:
                    seen.add(j)
                    came[("p", j)] = s
                    todo.append(j)
    return None


def order_key(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id)


def pattern_key(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"})


def mix_plan(rows: DataFrame, quotas: dict, copies: int = 2, seed: int = 7, buckets: int = 2048, max_patterns: int = 100_000) -> DataFrame:
    """One row per membership pattern: (pattern, full, cut). `apply_plan` turns it into passes over each document.

    rows: doc_id, sources (array: all the sources that hold the document; null is a source of its own), size (words).
    quotas: words wanted of each source. A document's row is read `full` times, and once more if its seeded hash is at
    most `cut`; cut is chosen so that the words come nearest to the flow. Only sums by pattern reach the driver (more
    than max_patterns raise ValueError). The cut comes from sums of `buckets` hash ranges and then from the rows of the
    one range that holds it, so no task holds a pattern. rows is read twice. Rows of equal doc_id go together.
    """
    spark = rows.sparkSession
    keyed = rows.select("doc_id", "sources", "size", pattern_key(F.col("sources")).alias("pattern"), order_key(F.col("doc_id"), seed).alias("h"))
    sums = keyed.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words"))
    got = sorted(sums.limit(max_patterns + 1).collect(), key=lambda r: r.pattern)
    if len(got) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sent = route([(tuple(r.sources), r.words) for r in got], quotas, copies)
    takes = [(r.pattern, int(t // r.words) if r.words else 0, int(t % r.words) if r.words else 0) for r, t in zip(got, (sum(x.values()) for x in sent), strict=True)]
    plan = spark.createDataFrame(takes, "pattern string, full int, rest long")
    top = 64 - (buckets - 1).bit_length()
    keyed = keyed.withColumn("b", F.shiftright(F.col("h"), top))  # ordered as h is
    ranges = keyed.groupBy("pattern", "b").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    crossing = ranges.join(F.broadcast(plan), "pattern").where("rest > 0 AND start <= rest AND rest < start + n").select("pattern", "b", "start", "rest")
    w = Window.partitionBy("pattern").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = keyed.join(F.broadcast(crossing), ["pattern", "b"]).groupBy("pattern", "h", "start", "rest").agg(F.sum("size").alias("size"))
    near = near.withColumn("end", F.col("start") + F.sum("size").over(w))
    # up to the row that crosses the line, if that comes nearer; else to the one before it
    near = near.where("end <= rest OR (end - size < rest AND end - rest < rest - (end - size))")
    inner = near.groupBy("pattern").agg(F.max("h").alias("h"))
    edge = ranges.join(F.broadcast(crossing.select("pattern", F.col("b").alias("at"))), "pattern").where("b < at").groupBy("pattern").agg(F.max("b").alias("b"))
    cut = plan.join(inner, "pattern", "left").join(edge, "pattern", "left")
    last = F.shiftleft(F.col("b") + 1, top) - 1  # all of the ranges before it
    done = cut.select("pattern", "full", F.coalesce("h", last).alias("cut")).collect()
    return spark.createDataFrame([tuple(r) for r in done], "pattern string, full int, cut long")


def apply_plan(docs: DataFrame, sources: Column, plan: DataFrame, seed: int = 7, name: str = "passes") -> DataFrame:
    """docs with `name`: how many times the mix reads the row. plan has at most max_patterns rows, so it is broadcast."""
    p = plan.select(F.col("pattern").alias("_lw_pattern"), F.col("full").alias("_lw_full"), F.col("cut").alias("_lw_cut"))
    more = F.when(order_key(F.col("doc_id"), seed) <= F.col("_lw_cut"), 1).otherwise(0)
    joined = docs.withColumn("_lw_pattern", pattern_key(sources)).join(F.broadcast(p), "_lw_pattern", "left")
    return joined.select(*docs.columns, F.coalesce(F.col("_lw_full") + more, F.lit(0)).cast("int").alias(name))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, copies: int = 2, max_sources: int = 100_000) -> list[tuple]:
    """(source, size, target) for each source by code point, null last; weights repeat. sizes: source, size."""
    got = sizes.limit(max_sources + 1).collect()
    if len(got) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    got = sorted(got, key=lambda r: (r.source is None, (r.source or "").encode()))
    n = [r["size"] for r in got]
    targets = capped_shares(n, [float(weights[i % len(weights)]) for i in range(len(n))], share * sum(n), copies)
    return [(r.source, s, t) for r, s, t in zip(got, n, targets, strict=True)]


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, copies: int = 2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, plan) of a mix of documents, each in its own source.

    rows: doc_id, source, size, source_size, target, taken (words read, repeats counted). Null or empty texts have size
    0 and are taken 0 words; a null source is a source. Repeated rows of one doc_id are read equally often. No row is
    read more than `copies` times. The text is read once; what is kept of it is narrow.
    """
    spark = docs.sparkSession
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, copies)
    plan = mix_plan(rows.withColumn("sources", F.array("source")), {s: t for s, _, t in targets}, copies, seed)
    table = spark.createDataFrame(targets, "source string, source_size long, target double")
    out = apply_plan(rows, F.array("source"), plan, seed).alias("l").join(F.broadcast(table).alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
    return out.select("l.doc_id", "l.source", "l.size", "r.source_size", "r.target", (F.col("l.passes") * F.col("l.size")).alias("taken")), plan


def mix_stage(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: each row of docs as many times as the mix reads it (rows of no words: not at all)."""
    _, plan = mix_documents(docs, **how)
    some = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    read = apply_plan(some, F.array("source"), plan, how.get("seed", 7), "_lw_passes").where("_lw_passes > 0")
    return read.withColumn("_lw_k", F.explode(F.sequence(F.lit(1), F.col("_lw_passes")))).select(*docs.columns)
