"""Hand-written cases of the rules, and operators that SQL can't check."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loamwork.functions.joins import sized_join
from loamwork.functions.numbering import number_rows
from loamwork.functions.text import host
from loamwork.operators import cleaning as T
from loamwork.operators import facts as A
from loamwork.operators import feedback as K
from loamwork.operators import graph as G
from loamwork.operators import ingest as I
from loamwork.operators import policy as L
from loamwork.operators import questions as N
from loamwork.operators import sessions as M
from loamwork.operators import vectors as V
from loamwork.operators.components import connected_components
from loamwork.sources import tables as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_entry(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 173
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)] + [(7, None)]
    up = {x: x for e in edges for x in e if None not in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_numbering(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("h"))
    assert sorted(r.n for r in number_rows(df, ["id"], "n", buckets=16).collect()) == list(range(1000))
    by = {}
    for r in number_rows(df, ["id"], "n", ["g", "h"], 8).collect():
        by.setdefault((r.g, r.h), []).append(r.n)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 1000


def test_sized_join(spark):
    big, little = spark.range(100), spark.range(10)
    assert sized_join(big, little, ["id"]).count() == sized_join(big, little, ["id"], most=3).count() == 10


def test_ratings(spark):
    f = spark.createDataFrame([(1, 0, None), (2, 6, None), (3, None, None), (4, 5, "x" * 1000), (5, 5, "x" * 1001)], "id int, rating int, comment string")
    assert {r.id: r.reason for r in K.validate_feedback(f).collect()} == {1: "bad_rating", 2: "bad_rating", 3: "bad_rating", 4: None, 5: "long_comment"}


def test_hosts_and_scripts(spark):
    assert one(spark, host(F.col("u")), u="HTTP://User@Ex.COM:80/a?b") == "user@ex.com:80"
    assert one(spark, T.script_language(F.col("t")), t="ЁЖ") == "ru" and one(spark, T.script_language(F.col("t")), t="abc") == "en"


def test_cache_ttl(spark):
    log = spark.createDataFrame([(1, "A  b", "2024-01-01 00:00:00"), (2, " a b", "2024-01-01 01:00:00"), (3, "a b", "2024-01-01 02:00:01")], "event_id int, question string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.event_id: r.hit for r in M.cache_replay(log).collect()} == {1: False, 2: True, 3: False}


def test_context_budget(spark):
    text = "x" * (2000 - len("Пользователь: "))
    m = spark.createDataFrame([("s", 1, 1, 0, "user", text), ("s", 2, 1, 1, "user", "y")], "session_id string, created_at int, conv_id int, turn int, role string, text string")
    got = M.conversation_context(m).first()
    assert got.n == 1 and len(got.context) == 2000


def test_chunk_limits(spark):
    d = spark.createDataFrame([(1, "a" * 1050), (2, "a" * 1049 + "\n" + "b" * 451), (3, "a" * 1049 + "\n" + "b" * 452), (4, "")], "doc_id int, content string")
    got = {}
    for r in I.chunk_packed(d).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_idx, r.n_paragraphs, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 1, 1050)], 2: [(0, 2, 1500)], 3: [(0, 1, 1049), (1, 1, 452)]}
    p = spark.createDataFrame([(1, "0123456789\n01234567890")], "doc_id int, content string")
    assert [r.text for r in I.chunk_paragraphs(p).collect()] == ["01234567890"]


def test_formats(spark):
    cases = {"": "empty", "[1]": "json_array", "[1": "text", '{"a": 1}': "json_object", '{"a": 1}\n\n{"b": 2}': "jsonl", "a,b\n1,2": "csv", "Вопрос: кто?\nОтвет: я": "qa_text", "просто": "text"}
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "doc_id int, content string")
    assert {r.doc_id: r.format for r in I.detect_formats(d).collect()} == dict(enumerate(cases.values()))


def test_main_block():
    page = "<body><nav>no</nav><div class='ad'>no</div><div role='main'>yes <b>this</b><script>no</script></div><footer>no</footer></body>"
    assert T.main_block(page) == ("role=main", "yes this")
    assert T.main_block("<p>only <br> a body</p>") == ("body", "only a body") and T.main_block("") == ("body", "")


def test_references_and_blanks_of_a_page():
    body = lambda x: T.main_block(f"<article>{x}</article>")[1]
    assert body("<h1>a&amp;&amp;&amp</h1><p>b &am c & d &quo</p>") == "a&&&amp b &am c & d &quo"
    assert body("&lt;i&gt; &amp;lt; &quot;x&#39; &copy;&eacute; &nosuch; &notit;") == "<i> &lt; \"x' ©é &nosuch; &notit;"
    assert body("\u00a0a&nbsp;&nbsp;b\u00a0 c\u2028d\u3000") == "a b\u00a0 c\u2028d"


def test_pages_in_slices(spark):
    pages = [(i, None if i == 4 else f"<article>page {i}</article>") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, html string").coalesce(1)
    got = sorted(map(tuple, T.extract_main_content(df, rows=3).collect()))
    assert got == [(i, *T.main_block(x or "")) for i, x in pages]
    assert T.extract_main_content(df.where("false")).collect() == []


def test_fact_rules(spark):
    why = lambda t: one(spark, A.drop_reason(F.col("t")), t=t)
    body = "это обычное предложение достаточной длины, чтобы пройти"
    assert why("x" * 39) == "length" and why("x" * 601) == "length" and why(body) is None
    assert why(body + "!!!") == "shouting" and why(body + " http://a.b") == "url" and why(body + " реклама") == "ad" and why(body + " источник: x") == "junk"


def test_empty_graphs(spark):
    n = spark.createDataFrame([("topic_a", "topic", None, None, None)], "id string, type string, name string, content string, updated_at long")
    e = spark.createDataFrame([], "src string, dst string, relation string, weight double")
    assert G.graph_summary(n, e).first().density == 0.0
    assert G.clustering_coefficient(n, e).first().coefficient == 0.0
    loop = spark.createDataFrame([("topic_a", "topic_a", "self", 0.7)], e.schema)
    a, b = G.optimize_graph(n, loop)
    assert a.count() == 1 and b.count() == 0
    assert G.weak_by_weight(n, loop.withColumn("relation", F.lit("contains"))).count() == 0  # exactly at the limit


def test_q_values(spark):
    log = spark.createDataFrame([("s", "medium", 1.0, 1), ("s", "medium", -1.0, 2)], "state string, action string, reward double, seq int")
    q = 0.5
    for r in (1.0, -1.0):
        q += 0.1 * (r - q)
    assert abs(L.q_table(log).first().q - q) < 1e-12


def test_topics(spark):
    assert one(spark, N.clean_topic(F.col("t")), t=" Что такое граф?? ") == "граф"
    assert one(spark, N.topic_of(F.col("t"), ("the",)), t="is the graph the tree big?") == "graph tree"
    assert one(spark, N.topic_of(F.col("t"), ("the",)), t="a an") is None


def test_bad_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id int, embedding array<float>")
    got = {r.vec_id: (list(r.embedding), r.norm) for r in V.normalize_vectors(v).collect()}
    assert got[1] == ([0.0, 0.0], 0.0) and np.allclose(got[2][0], [0.6, 0.8])


def test_greedy_dedup(spark):
    rng = random.Random(2)
    links = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    kept = []
    for i in range(60):
        if not any((j, i) in links for j in kept):
            kept.append(i)
    rows, df = spark.range(60), spark.createDataFrame(sorted(links), "a long, b long")
    assert sorted(r.id for r in V.semantic_dedup(rows, df).collect() if r.kept) == kept


def test_mmr(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.95, [1.0, 0.0]), (1, 3, 0.9, [0.0, 1.0])], "query_id int, vec_id int, score double, v array<double>")
    assert [r.vec_id for r in A.mmr_rerank(rows).orderBy("place").collect()] == [1, 3, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿текст".encode())
    (tmp_path / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "c.pdf").write_bytes(b"no")
    (tmp_path / "d.txt").write_bytes(b"x" * 100)
    rows = S.read_corpus_files(spark, str(tmp_path), most_bytes=50).collect()
    assert sorted(r.content for r in rows if r.content is not None) == ["bad � byte", "текст"]
    assert [(r.path[-5:], r.size_bytes, r.problem) for r in rows if r.content is None] == [("d.txt", 100, "too large")]
    with pytest.raises(ValueError):
        S.knowledge_export(spark.range(1), str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("rest", [0, 40, 1000])
def test_components_with_a_rest(spark, rest, kind):
    rng = np.random.default_rng(rest)
    order = rng.permutation(120) + 1  # a path through 120 nodes, and smaller ones
    pairs = [(int(a), int(b)) for a, b in zip(order, order[1:], strict=False)] + [(200 + int(a), 200 + int(b)) for a, b in rng.integers(0, 60, (40, 2))]
    low = {x: x for p in pairs for x in p}
    text = (lambda x: str(x)) if kind == "string" else (lambda x: x)
    for _ in pairs:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b], key=text)
    edges = spark.createDataFrame([(text(a), text(b)) for a, b in pairs], f"a {kind}, b {kind}")
    got = {r.node: r.component for r in connected_components(edges, rest).collect()}
    assert got == {text(x): text(y) for x, y in low.items()}


def test_components_of_few_edges_take_few_jobs(spark):
    order = np.random.default_rng(5).permutation(3000)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    try:
        assert {r.component for r in connected_components(edges).collect()} == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 16
