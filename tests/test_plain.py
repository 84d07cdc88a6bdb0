"""Operators without checking SQL, and those that split hot groups, against plain versions."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import cleaning as T
from loamwork.operators import facts as A
from loamwork.operators import ingest as I
from loamwork.operators import metrics as P
from loamwork.operators import policy as L
from loamwork.operators import sessions as M
from loamwork.operators import vectors as V
from loamwork.operators.components import component_sizes
from loamwork.plans import catalogue
from loamwork.sources.tables import upsert_chunks


def test_nfkc(spark):
    texts = ["ﬁne ① ｆｕｌｌ", "á é", "", None, "Å ㎏ ½", "plain"]
    got = {r.doc_id: r.text for r in T.normalize_nfkc(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "text").collect()}
    assert got == {i: unicodedata.normalize("NFKC", t or "") for i, t in enumerate(texts)}


def test_embed_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.embedding for r in V.embed_corpus(docs, "doc_id", "text", V.hashed_words(16)).collect()}
    for r in docs.select("doc_id", "text").collect():
        n = Counter(zlib.crc32(w.encode()) % 16 for w in (r.text or "").split())
        length = math.sqrt(sum(k * k for k in n.values())) or 1
        assert np.allclose(got[r.doc_id], [n[i] / length for i in range(16)])


@pytest.mark.parametrize("block", [None, "label"])
@pytest.mark.parametrize("strict", [False, True])
def test_cosine_links(spark, block, strict):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8))
    x[40:50] = x[0]
    x[7] = 0
    rows = [(i * 3, [float(v) for v in x[i]], i % 4 if i % 11 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.id_a, r.id_b) for r in V.cosine_links(df, 0.5, block, strict, tile=17).collect()}
    want = set()
    for i in range(120):
        for j in range(i + 1, 120):
            if i == 7 or j == 7 or (block and (rows[i][2] is None or rows[i][2] != rows[j][2])):
                continue
            c = x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])
            if c > 0.5 if strict else c >= 0.5:
                want.add((i * 3, j * 3))
    assert got == want and len(want) > 45
    assert V.cosine_links(df.where("false"), 0.5, block).count() == 0


def plain_mmr(rows, penalty=-0.2):
    left, near, out = sorted(rows, key=lambda r: (-r[1], r[0])), {}, []
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows}
    while left:
        best = max(range(len(left)), key=lambda k: (left[k][1] + penalty * near.get(left[k][0], 0.0), -k))
        i = left.pop(best)[0]
        out.append(i)
        for j, _, _ in left:
            near[j] = max(near.get(j, 0.0), float(unit[i] @ unit[j]))
    return out


def test_mmr_reorders_all_rows(spark):
    rng = random.Random(3)
    rows = [(q, i, round(rng.random(), 3), [rng.gauss(0, 1) for _ in range(4)]) for q in (1, 2) for i in range(70)]
    got = A.mmr_rerank(spark.createDataFrame(rows, "query_id long, vec_id long, score double, v array<double>")).orderBy("query_id", "place").collect()
    for q in (1, 2):
        assert [r.vec_id for r in got if r.query_id == q] == plain_mmr([r[1:] for r in rows if r[0] == q])


def test_component_sizes(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4)], "node long, component long")
    got = {(r.node, r.size, r.place, r.n_components) for r in component_sizes(c, 2).collect()}
    assert got == {(1, 2, 2, 3), (2, 2, 2, 3), (3, 1, None, 3), (4, 3, 1, 3), (5, 3, 1, 3), (6, 3, 1, 3)}


@pytest.fixture(scope="module")
def log():
    rng = random.Random(2)
    return [(k, t, rng.choice(["a", "b"]), float(rng.randint(-5, 5))) for k, t in enumerate(sorted(rng.randint(0, 20_000) for _ in range(3000)))]


def test_folds(spark, log):
    df = spark.createDataFrame(log, "seq long, t long, action string, reward double").withColumn("state", F.lit("ambiguous"))
    q, means = {"a": 0.3, "b": 0.3}, {}
    for k, _, a, r in log:
        q[a] += 0.1 * (r - q[a])
    got = {r.action: r.q for r in L.q_table(df).collect()}
    assert all(abs(got[a] - q[a]) < 1e-9 for a in q)
    seen = defaultdict(list)
    for k, _, a, r in log:
        seen[a].append(r)
        means[k] = sum(seen[a]) / len(seen[a])
    got = {r.seq: r.running_mean for r in P.running_mean(df, "action", ["seq"], "reward").collect()}
    assert got.keys() == means.keys() and all(abs(got[k] - means[k]) < 1e-9 for k in means)
    for size in (7, 50, 10**6):
        got = {r.seq: r.average for r in P.moving_average(df, "action", ["seq"], "reward", 5, size).collect()}
        for a in seen:
            ids = [k for k, _, x, _ in log if x == a]
            assert all(got[k] is None if i < 4 else abs(got[k] - sum(seen[a][i - 4 : i + 1]) / 5) < 1e-9 for i, k in enumerate(ids))
    tasks = df.select(F.col("seq").alias("event_id"), F.col("action").alias("type"), F.lit(True).alias("success"), (F.col("reward") + 6).alias("processing_time"), F.timestamp_seconds("t").alias("ts"))
    ewma = {}
    for _, _, a, r in log:
        ewma[a] = r + 6 if a not in ewma else 0.9 * ewma[a] + 0.1 * (r + 6)
    got = {r.type: (r.processed, r.failed, r.avg_time) for r in P.task_ewma(tasks).collect()}
    assert all(got[a][:2] == (len(seen[a]), 0) and abs(got[a][2] - ewma[a]) < 1e-9 for a in ewma)


def test_cache_replay(spark, log):
    df = spark.createDataFrame([(k, f"q {a}{t % 40}", t * 10) for k, t, a, _ in log], "event_id long, question string, t long").withColumn("ts", F.timestamp_seconds("t"))
    last, want = {}, {}
    for k, t, a, _ in log:
        key = (a, t % 40)
        want[k] = key in last and t * 10 - last[key] <= 3600
        last[key] = t * 10
    assert {r.event_id: r.hit for r in M.cache_replay(df).collect()} == want and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("most", [10, 500, 2999, 3000])
def test_lru_trim(spark, log, most):
    df = spark.createDataFrame([(k, t) for k, t, _, _ in log], "id long, t long")
    drop = 0 if len(log) <= most else len(log) - most + most // 5
    assert sorted(r.id for r in M.lru_trim(df, most, ["t", "id"]).collect()) == list(range(drop, len(log)))


def test_upsert_merges(spark):
    m = "id long, text string, metadata map<string,string>"
    old = spark.createDataFrame([(1, "one", {"a": "1", "b": "1"}), (2, "two", None), (3, "three", {})], m)
    new = spark.createDataFrame([(1, None, {"b": "2"}, 5), (2, "zwei", {"c": "3"}, 1), (4, "four", None, 1)], m + ", seq int")
    got = {r.id: (r.text, r.metadata) for r in upsert_chunks(old, new, old.where("id = 3").select("id")).collect()}
    assert got == {1: ("one", {"a": "1", "b": "2"}), 2: ("zwei", {"c": "3"}), 4: ("four", {})}


def test_stream_dedup(spark, small):
    got = catalogue.QUERIES["stream_dedup"](spark, small).collect()
    times = {r.event_id: r.ts for r in spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts").collect()}
    kept, rows = defaultdict(list), defaultdict(list)
    for r in spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", "event_type").collect():
        rows[r.user_id, r.event_type].append(times[r.event_id])
    for r in got:
        kept[r.user_id, r.event_type].append(times[r.event_id])
    assert kept.keys() == rows.keys()  # the first row of each key stays
    for k, t in kept.items():
        t.sort()
        assert all((b - a).total_seconds() > 3600 for a, b in zip(t, t[1:], strict=False))


def test_fact_pipeline(spark):
    said = ["Rivers carry water from the mountains to the sea every single day", "Stones of the old bridge were cut by hand in the valley long ago", "Birds return to the northern lakes when the first warm wind blows"]
    text = " ".join(f"{s}. " * 1 for s in said) + " ".join(f"Chapter number {i} tells about the town and its {w} people in many words." for i, w in enumerate(["quiet", "busy", "young", "proud", "old", "kind"]))
    again = text.replace("Rivers carry water from", "Rivers carry the water from")
    rows = [(1, "t", "http://a.org/1", text), (2, "t", "http://b.org/2", again), (3, "u", "http://c.org/3", "short")]
    chunks = spark.createDataFrame(rows, "doc_id long, topic string, source_url string, text string").withColumn("length", F.length("text"))
    got = A.fact_pipeline(chunks, ["water"], similar=0.85).orderBy("place").collect()
    assert got and {r.topic for r in got} == {"t"} and [r.place for r in got] == list(range(1, len(got) + 1))
    assert got[0].sentence.startswith("Rivers") and sum(r.sentence.startswith("Rivers") for r in got) == 1  # its near copy goes
    assert all(a.score >= b.score for a, b in zip(got, got[1:], strict=False)) and all(0 < r.confidence <= 1 for r in got)


def test_qa_patterns(spark):
    texts = ["Question: what is it?\nAnswer: a thing\nQuestion: a\nAnswer: b\nВопрос: что это такое\nОтвет: вещь", "Q. who came?\nA. nobody\nQ. why so?\nA. it rained", "Where is it?: over there\nno pair here\nWhen was that? long ago", "nothing", "", None]
    got = [(r.doc_id, r.idx, r.question, r.answer) for r in I.extract_qa_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")).orderBy("doc_id", "idx").collect()]
    assert got == [(0, 0, "what is it?", "a thing"), (0, 2, "что это такое", "вещь"), (1, 0, "who came?", "nobody"), (1, 1, "why so?", "it rained"), (2, 0, "Where is it?", "over there"), (2, 1, "When was that?", "long ago")]


def test_topk_in_blocks(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    q = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), V.doubles("embedding").alias("qv"))
    one, many = (sorted(map(tuple, V.topk(q, e, 3, "cosine", -1.0, block=n).collect())) for n in (10**6, 4))
    assert one == many and one
