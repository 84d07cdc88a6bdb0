"""Substring postings and the stored term index against plain searches."""

import random
import re
from collections import Counter

import pytest

from loamwork.functions.storage import new_path
from loamwork.operators import sessions as M
from loamwork.operators import vectors as V
from loamwork.operators.postings import TermIndex, containing


def texts(rng, n):
    return ["".join(rng.choice("abcÄ .x") for _ in range(rng.randrange(0, 14))) for _ in range(n)] + ["", "same", "same", "Part 12", "aparté", None]


def test_containing(spark):
    rng = random.Random(1)
    rows = texts(rng, 300)
    needles = ["", "a", "ab", "ABC", "cÄ", "part", "Part 12", "zzz", "abcx", ". ", "not in any text", None, "a"] + [t[2:7] for t in rows[:20] if t]
    t, q = spark.createDataFrame([(r,) for r in rows], "text string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    want = sorted((x, r) for x in set(needles) - {None} for r in set(rows) - {None} if x.lower() in r.lower())
    assert sorted(map(tuple, containing(t, q).collect())) == want
    assert containing(t.where("false"), q).collect() == [] and containing(t, q.where("false")).collect() == []


def test_memory_lookup_has_no_nested_loop(spark):
    rng = random.Random(2)
    m = spark.createDataFrame([(t, rng.choice([0.1, 0.3, 0.9])) for t in texts(rng, 200)], "key string, confidence double")
    q = spark.createDataFrame([("same",), ("ab",), ("Äx",), ("a",), ("none such",), ("",)], "query string")
    found = M.memory_lookup(m, q)
    good = [(r.key, r.confidence) for r in m.collect() if r.confidence >= 0.3 and r.key is not None]
    want = []
    for (x,) in q.collect():
        hits = [(k, c) for k, c in good if k == x] or [(k, c * 0.9) for k, c in good if x.lower() in k.lower()]
        want += [(x, i, k, c) for i, (k, c) in enumerate(sorted(hits, key=lambda h: (h[0], -h[1]))[:3], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found.where("query <> ''")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert len(re.findall("BroadcastNestedLoopJoin", plan)) <= 1  # the empty query, one row at most


def plain(docs, queries, k, stop):
    words = lambda t: {w for w in re.split(r"[^\w]+", (t or "").lower()) if len(w) >= 3}
    out = []
    for qid, text in queries:
        q = words(text) - set(stop)
        rated = sorted((-round(len(q & w) / len(q), 9), d) for d, w in docs.items() if q & w) if q else []
        out += [(qid, i, d, -s) for i, (s, d) in enumerate(rated[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("literals", [0, 500])
def test_index_grows_by_batches(spark, literals, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "of", "the", "x1y2", "naïve", "ДОМ", "zeta"]
    make = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9)))
    index, docs = TermIndex(spark, new_path(spark, "index")), {}
    monkeypatch.setattr(TermIndex.postings, "__defaults__", (literals,))
    queries = [(1, "alpha beta, GAMMA"), (2, "the of"), (3, "дом x1y2"), (4, ""), (5, "zeta zeta the")]
    q = spark.createDataFrame(queries, "query_id long, query string")
    for batch in ([(i, make()) for i in range(40)] + [(99, None)], [(i, make()) for i in range(30, 60)], [(5, ""), (6, "alpha beta gamma")]):
        index.add(spark.createDataFrame([*batch, (None, "alpha")], "doc_id long, text string"))
        docs |= {d: {w for w in re.split(r"[^\w]+", (t or "").lower()) if len(w) >= 3} for d, t in batch}
        got = sorted((r.query_id, r.place, r.doc_id, round(r.score, 9)) for r in index.search(q, 4, ("the",)).collect())
        assert got == plain(docs, queries, 4, ("the",))
    words = spark.createDataFrame([("alpha",), ("none",)], "w string")
    assert {r.w: r.df for r in index.frequencies(words).collect()} == {"alpha": sum("alpha" in w for w in docs.values())}


def test_one_index_for_three_queries(spark, small, monkeypatch):
    from loamwork.plans import catalogue

    added = []
    monkeypatch.setattr(TermIndex, "add", lambda self, docs, add=TermIndex.add: (added.append(1), add(self, docs)))
    for name in ("keyword_search", "hybrid_search", "related_terms"):
        assert catalogue.QUERIES[name](spark, f"{small}/").count() > 0  # another path than other tests'
    assert len(added) == 1


def test_many_queries_meet_slices(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(rows[:90], "query_id long, qv array<double>")
    one, many = (Counter(map(tuple, V.topk(q, v, 3, "cosine", -1.0, block=b, slice_rows=40).collect())) for b in (10**6, 7))
    assert one == many


def test_search_by_blocks_and_slices(spark):
    """Many blocks and slices find what one finds, and no pair of query and document is shuffled before its slice's best are known."""
    import random

    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(60)]
    docs = {i: set(rng.sample(vocab, rng.randint(0, 20))) for i in range(150)}
    asked = {i: set(rng.sample(vocab, rng.randint(1, 9))) for i in range(30)} | {40: {"unknown"}}
    index = TermIndex(spark, new_path(spark, "index"))
    index.add(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"))
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in asked.items()], "query_id long, query string")
    want = []
    for i, w in asked.items():
        best = sorted((-round(len(w & d) / len(w), 9), k) for k, d in docs.items() if w & d)[:4]
        want += [(i, place, k, -s) for place, (s, k) in enumerate(best, 1)]
    for block, slice_docs in ((512, 8192), (7, 20)):
        found = index.search(q, 4, block=block, slice_docs=slice_docs)
        assert sorted((r.query_id, r.place, r.doc_id, round(r.score, 9)) for r in found.collect()) == sorted(want)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
