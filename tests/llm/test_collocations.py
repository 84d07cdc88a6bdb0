"""Collocations against a plain count, and the query against DuckDB."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm import collocations as C
from loamwork.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                left.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(left)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "漢字", "a-b", "The", "\x85x", "b\x1cc"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["new york city hall", "once upon a time", "of the"]
    rows = []
    for _ in range(n):
        w = rng.choices(vocabulary + fixed, weights + [0.3, 0.2, 0.4], k=rng.randrange(0, 60))
        glue = [rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\r\n", " \x0b"]) for _ in w]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(a + b for a, b in zip(w, glue, strict=True))))
    return rows


@pytest.mark.parametrize(("chunk", "cells"), [(200, 50), (1_000_000, 1_000_000)])
def test_counts(spark, chunk, cells):
    rng = random.Random(chunk)
    rows = texts(rng, 400) + [("en", None), ("en", ""), ("fr", " \t\n"), ("xx", "one two")] + [("de", "same row again and again.")] * 40
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, g int").repartition(3)
    got = C.collocations(df, least=8, chunk_ids=chunk, bucket_cells=cells).collect()
    assert sorted(map(tuple, got)) == plain(rows, 8)
    assert C.collocations(df.where("false")).collect() == []


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 3)
    rows = texts(random.Random(5), 300) + [("en", "long text " * 30_000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = C.collocations(df, least=6, chunk_ids=400, bucket_cells=100).collect()
    assert sorted(map(tuple, got)) == plain(rows, 6)


def test_tiles():
    rng = np.random.default_rng(1)
    for top in (900, 5000, 3_000_000):
        a = np.minimum(rng.zipf(1.2, 400_000), top).astype(np.int64) - 1
        b = np.minimum(rng.zipf(1.3, 400_000), top).astype(np.int64) - 1
        keys, counts = C.count_cells(a, b)
        want = Counter(zip(a.tolist(), b.tolist(), strict=True))
        assert (np.diff(keys.astype(object)) > 0).all() and counts.sum() == len(a)
        got = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        pairs = list(want)
        names = C.cell_keys(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        assert [got[x] for x in names.tolist()] == [want[p] for p in pairs] and len(got) == len(want)
        for n in (1, 7):
            assert (C.buckets_of(keys, 64 * n) // 64 == C.buckets_of(keys, n)).all()


def test_query_equals_sql(spark):
    got = Q.QUERIES["op12_collocations"](spark, SMALL)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = c.sql(Q.ORACLE_SQL["op12_collocations"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_buckets_of_more_than_fan_chunks(spark, monkeypatch):
    """A language of barely more than FAN chunks: its first round holds as few cells as every other one."""
    monkeypatch.setattr(C, "FAN", 16)
    levels, keep = [], C.stage

    def stage(df, label, *a):
        out = keep(df, label, *a)
        if label == "cells":
            levels.append(out)
        return out

    monkeypatch.setattr(C, "stage", stage)
    rng = random.Random(3)
    rows = [(lang, " ".join(f"w{rng.randrange(200)}" for _ in range(100))) for lang, n in (("en", 20), ("de", 10)) for _ in range(n)] * 3
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    counts, _ = C.phrase_counts(df, 3, 2, chunk_ids=300, bucket_cells=300)
    pairs = Counter((lang, f"{a} {b}") for lang, text in rows for a, b in zip(text.split(), text.split()[1:], strict=False))
    assert {(r.lang, r.phrase): r.f for r in counts.where("k = 2").collect()} == {p: n for p, n in pairs.items() if n >= 3}
    assert len(levels) == 3
    for cells in levels[:-1]:
        held = cells.groupBy("lang", "bucket", F.floor(F.col("g") / 16)).agg(F.sum(F.length("keys") / 8).alias("n"))
        assert held.agg(F.max("n")).first()[0] <= 900
