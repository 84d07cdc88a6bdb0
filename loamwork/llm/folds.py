"""Held-out rows and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, label: str, most: int, seed: int = 5) -> DataFrame:
    """At most about `most` rows (doc_id, label column, ...) of each label, chosen by a hash of doc_id.

    Only doc_id and the label are read to count; a label's rows are kept where their hash is under most / count.
    Expected and, for more than a few thousand rows, actual counts lie within some per cent of the bound.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, most / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < share)
