"""Posting tables: substrings by their rarest gram, and words of texts in a stored index that grows by batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import stage

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, text: the distinct texts (text) that hold each distinct needle (needle), upper and lower case alike.

    A text is posted under its runs of three characters that some needle has. Of a needle's runs the one with the fewest
    postings is looked up, and the texts found are then compared as a whole; a needle with a run that no text has is done. Needles
    of one or two characters are runs themselves, and all texts hold an empty one. Nulls hold nothing and are in nothing.
    """
    asked = needles.where("needle IS NOT NULL").select("needle").distinct().withColumn("low", F.lower("needle"))
    asked = stage(asked.withColumn("size", F.least(F.length("low"), F.lit(GRAM))), "needles")
    every = F.coalesce(*(F.when(F.col("size") == s, grams(F.col("low"), s)) for s in range(1, GRAM + 1)), F.array().cast("array<string>"))
    parts = stage(asked.select("needle", "low", F.explode(every).alias("gram")), "needle-grams")
    wanted = stage(parts.select("gram").distinct(), "wanted-grams")
    sizes = [r[0] for r in wanted.select(F.length("gram")).distinct().collect()]  # GRAM rows at most
    t = texts.where("text IS NOT NULL").select("text").distinct()
    low = F.lower("text")
    posted = t.select("text", F.explode(F.concat(F.array().cast("array<string>"), *(grams(low, s) for s in sizes))).alias("gram"))
    posted = stage(sized_join(posted, wanted, ["gram"]), "postings")
    often = stage(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    counted = sized_join(parts, often, ["gram"], "left")
    rare = counted.groupBy("needle", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    rare = stage(rare.select("needle", "low", F.col("x.gram").alias("gram")), "rarest")
    found = sized_join(posted, rare, ["gram"]).where(F.contains(F.lower("text"), F.col("low"))).select("needle", "text")
    blank = asked.where("size = 0").select("needle")
    return found.unionByName(t.join(F.broadcast(blank), how="cross").select("needle", "text"))  # '' is one needle at most


def index_words(text: Column, least: int = 3) -> Column:
    """The distinct words (letters, digits, _) of a text in lower case; shorter ones than `least` are for the reader to drop."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))


class TermIndex:
    """Postings (w, doc_id) of documents, stored under a folder: a batch of documents adds its own sorted files.

    `postings` has a row for each distinct word of `least` letters or more of a document and batch. A file has the words of
    some documents in the order of a hash (h), so a reader who wants few words skips most pages; no posting is shuffled. `docs` has a row for
    each document and batch; the newest batch of a document is the one that counts.
    """

    def __init__(self, spark: SparkSession, path: str, least: int = 3):
        self.spark, self.path, self.least, self.batches = spark, path, least, 0

    def add(self, docs: DataFrame) -> None:
        """Index docs (doc_id, text), new ones and new versions. A null doc_id is left out; of several rows of an id, all words count."""
        batch = F.lit(self.batches)
        known = docs.where("doc_id IS NOT NULL")
        ids = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
        rows = known.select("doc_id", F.explode_outer(index_words(F.col("text"), self.least)).alias("w"))
        words = rows.where(F.length("w") >= self.least).select("w", "doc_id", F.xxhash64("w").alias("h"), batch.alias("batch"))
        if not ids.where("c > 1").isEmpty():
            words = words.distinct()
        words.sortWithinPartitions("h").write.mode("append").parquet(f"{self.path}/postings")
        docs.where("doc_id IS NOT NULL").select("doc_id", batch.alias("batch")).distinct().write.mode("append").parquet(f"{self.path}/docs")
        self.batches += 1

    def postings(self, words: DataFrame, most_literals: int = 500) -> DataFrame:
        """w, doc_id of the wanted words (w, distinct; a staged table): few of them are put to the files as hashes."""
        found = self.spark.read.parquet(f"{self.path}/postings")
        some = [r[0] for r in words.select(F.xxhash64("w")).limit(most_literals + 1).collect()]
        if len(some) <= most_literals:
            found = found.where(F.col("h").isin(some))
        live = sized_join(found, words, ["w"])
        if self.batches > 1:
            docs = self.spark.read.parquet(f"{self.path}/docs").groupBy("doc_id").agg(F.max("batch").alias("newest"), F.count(F.lit(1)).alias("c"))
            old = stage(docs.where("c > 1").select("doc_id", "newest"), "replaced")  # documents of several batches
            live = sized_join(live, old, ["doc_id"], "left").where("newest IS NULL OR batch = newest")
        return live.select("w", "doc_id")

    def frequencies(self, words: DataFrame) -> DataFrame:
        """w, df: how many documents hold each wanted word."""
        return self.postings(words).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def search(self, queries: DataFrame, k: int, stop: tuple[str, ...] = (), block: int = 512, slice_docs: int = 8192) -> DataFrame:
        """query_id, place, doc_id, score: the share of a query's distinct words (no stop words) that a document holds; the k best, ties by doc_id.

        Postings of the wanted words are dealt to slices of documents and queries to blocks. A slice meets a block in a task of its
        own, as a product of matrices, and sends on its best k of each query: pairs of query and document are no rows.
        """
        t = queries.select("query_id", F.explode(index_words(F.col("query"), self.least)).alias("w")).where((F.length("w") >= self.least) & ~F.col("w").isin(*stop)).distinct()
        t = stage(t.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "terms")  # words of one query
        blocks = max(1, -(-t.select("query_id").distinct().count() // block))
        parts = max(1, -(-self.spark.read.parquet(f"{self.path}/docs").count() // slice_docs))
        t = t.withColumns({"_block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "h": F.xxhash64("w")})
        wanted = stage(t.select("w", "h", "_block").distinct(), "wanted")
        live = self.postings(stage(wanted.select("w").distinct(), "wanted-words"))
        held = sized_join(live, wanted, ["w"])
        if wanted.groupBy("h").agg(F.count_distinct("w").alias("c")).where("c > 1").isEmpty():
            code = "h"  # the hash stands for the word
        else:
            code = "w"
        held = held.select("doc_id", F.col(code).alias("w"), "_block", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("_slice"))
        asked = t.select("query_id", F.col(code).alias("w"), "n", "_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_slice"))

        def meet(rows: pa.Table, terms: pa.Table) -> pa.Table:
            if not len(rows) or not len(terms):
                return pa.table({"query_id": terms["query_id"].slice(0, 0), "doc_id": rows["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
            words, queries = terms["w"].combine_chunks().dictionary_encode(), terms["query_id"].combine_chunks().dictionary_encode()
            column = pc.index_in(rows["w"], value_set=words.dictionary).to_numpy()
            ids = pc.unique(rows["doc_id"])
            ids = ids.take(pc.sort_indices(ids))
            place = pc.index_in(rows["doc_id"], value_set=ids).to_numpy()
            which = queries.indices.to_numpy()
            weights = np.zeros((len(words.dictionary), len(queries.dictionary)), "f4")
            weights[words.indices.to_numpy(), which] = 1
            size = np.zeros(len(queries.dictionary))
            size[which] = terms["n"].to_numpy()
            order = np.argsort(place, kind="stable")
            place, column = place[order], column[order]
            found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
            for at in range(0, len(ids), 1024):
                lo, hi = np.searchsorted(place, [at, at + 1024])
                has = np.zeros((min(1024, len(ids) - at), len(weights)), "f4")
                has[place[lo:hi] - at, column[lo:hi]] = 1
                share = (has @ weights).astype(float) / size
                for q in range(share.shape[1]):
                    s = share[:, q]
                    some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    some = some[s[some] > 0]
                    best = some[np.argsort(-np.round(s[some], 9), kind="stable")[:k]]
                    found.append((np.full(len(best), q), at + best, s[best]))
            q, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.table({"query_id": queries.dictionary.take(pa.array(q)), "doc_id": ids.take(pa.array(d)), "score": s})

        kind = lambda df, c: df.schema[c].dataType.simpleString()
        key = ["_block", "_slice"]
        rated = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, f"query_id {kind(t, 'query_id')}, doc_id {kind(live, 'doc_id')}, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
        return rated.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).select("query_id", "place", "doc_id", "score")
