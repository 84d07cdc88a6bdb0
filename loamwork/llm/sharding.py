"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only)."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.numbering import number_rows
from loamwork.functions.storage import stage


def domain(n: int, tries: int = 50_000) -> tuple[int, int]:
    """(a, b) with a * b >= n, both near the root of n, and a * b - n as small as the tried a allow."""
    r = max(1, isqrt(n))
    a = min(range(max(1, r // 2, r - tries), r + 1), key=lambda a: (-n % a, -a))
    return a, -(-n // a)


def feistel(at: Column, n: int, seed: int = 11, rounds: int = 8) -> Column:
    """The place of row `at` (0 to n - 1) in a permutation of 0 to n - 1 that (n, seed, rounds) alone decide.

    The network works on pairs (l, r) of Z_a x Z_b. Values beyond n walk on along their cycle. A cycle meets each of
    the a * b - n values beyond n once at most, so that many steps always suffice: no row is left outside.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a, b = domain(n)

    def one(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), k, s["r"]), F.lit(a).cast("long")), F.lit(a).cast("long"))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), k, s["l"]), F.lit(b).cast("long")), F.lit(b).cast("long"))
        even = k % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    def step(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, F.lit(b).cast("long")).alias("l"), (v % F.lit(b).cast("long")).alias("r"))
        return F.aggregate(F.array(*(F.lit(i) for i in range(rounds))), start, one, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    place, over = step(at.cast("long")), a * b - n
    if over:
        place = F.aggregate(F.sequence(F.lit(1), F.lit(over)), place, lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return place


def shard_rows(rows: DataFrame, shards: int, order: list[str], seed: int = 11, buckets: int | None = None) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard); shards differ by one row at most.

    A row's global number comes from the hash order of `order`; its permuted number p gives shard p mod shards and slot
    p div shards, so both are computable and the same at every run and cluster size. Rows that agree in all of `order`
    are interchangeable. rows is read three times (count, bucket sizes, numbers): pass a staged, narrow table.
    """
    n = rows.count()
    numbered = number_rows(rows, order, "_lw_row", buckets=buckets)
    p = numbered.withColumn("_lw_place", feistel(F.col("_lw_row"), n, seed))
    many = F.lit(shards).cast("long")
    return p.select(*rows.columns, F.pmod("_lw_place", many).cast("int").alias("shard"), F.call_function("div", F.col("_lw_place"), many).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16), text_crc32 (unsigned; null text: as empty), law, shard, slot, grown_shard.

    The law is `rows`: row counts differ by one at most; grown_shard is null. Texts are read once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shards")
    out = shard_rows(rows, shards, ["doc_id", "text_crc32", "size"], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
