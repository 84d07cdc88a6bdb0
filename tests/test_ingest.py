"""Files of all formats to chunks, in batch and as a stream, and answers to many queries at once."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.functions.storage import new_path
from loamwork.operators import facts as A
from loamwork.operators import ingest as I
from loamwork.operators.vectors import hashed_words
from loamwork.sources import tables as S
from loamwork.streaming import jobs as X

FILES = {
    "array.json": '[{"name": "first item"}, "second", [1], 4]',
    "object.json": '{"id": 1, "text": "one object in a file of its own, long enough"}',
    "lines.json": '{"a": 1}\n\nnot json but a long line\n{"b": 2}\nshort',
    "comma.csv": "name,lang\nsrc1, en\n\nx,y",
    "semicolon.csv": "name;lang\nsrc2; de",
    "tab.csv": "name\tlang\nsrc3\ten",
    "bom.csv": "﻿name,lang\nsrc4,fr",
    "qa.txt": "Question: what is it?\nAnswer: a thing of note\n\nQuestion: so?\nAnswer: yes, certainly",
    "plain.txt": "A first paragraph of a plain text.\n\nA second paragraph of it.",
    "empty.txt": "",
    "tiny.txt": "short one",
    "cyrillic.md": "Вопрос: что это такое\nОтвет: это просто вещь",
    "large.txt": "x" * 3000,
}
WANT = {
    "array.json": [("json_object", '{"name":"first item"}'), ("json_primitive", "second"), ("json_primitive", "4")],
    "object.json": [("paragraph", FILES["object.json"])],
    "lines.json": [("jsonl", '{"a": 1}'), ("text_line", "not json but a long line"), ("jsonl", '{"b": 2}')],
    "comma.csv": [("csv_row", "Строка 1: name, lang"), ("csv_row", "Строка 2: src1, en"), ("csv_row", "Строка 4: x, y")],
    "semicolon.csv": [("csv_row", "Строка 1: name, lang"), ("csv_row", "Строка 2: src2, de")],
    "tab.csv": [("csv_row", "Строка 1: name, lang"), ("csv_row", "Строка 2: src3, en")],
    "bom.csv": [("csv_row", "Строка 1: name, lang"), ("csv_row", "Строка 2: src4, fr")],
    "qa.txt": [("qa_pair", "Вопрос: what is it?\n\nОтвет: a thing of note")],
    "plain.txt": [("paragraph", "A first paragraph of a plain text."), ("paragraph", "A second paragraph of it.")],
    "cyrillic.md": [("qa_pair", "Вопрос: что это такое\n\nОтвет: это просто вещь")],
    "large.txt": [("too large", None)],
}


def written(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc.rsplit("/", 1)[1], []).append((r.kind, r.text))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_files_of_all_formats_as_a_stream(spark, tmp_path):
    folder, target = tmp_path / "files", new_path(spark, "files")
    written(folder, FILES)
    check = new_path(spark, "check")

    def run():
        stream = S.stream_corpus_files(spark, str(folder), most_bytes=2000, per_batch=4)
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", check).foreachBatch(X.ingest_batch(target, X.file_chunks, buckets=3)).start().awaitTermination()
        return by_file(X.stored(spark, target).collect())

    assert run() == {k: sorted(v, key=str) for k, v in WANT.items()}
    written(folder, {"later.txt": "Another file that came later on.", "more.csv": "a;b\nc;d"})
    got = run()
    assert got["later.txt"] == [("paragraph", "Another file that came later on")] and len(got["more.csv"]) == 2 and got["qa.txt"] == WANT["qa.txt"]


def test_new_versions_leave_no_old_chunks(spark):
    target = new_path(spark, "versions")
    make = lambda b: b.select(F.col("d").alias("doc"), F.concat_ws("_", "d", "i").alias("id"), "text", "seq")
    step, schema = X.ingest_batch(target, make, buckets=4), "d long, i int, text string, seq long"
    rows = [(d, i, f"old {d} {i}", 1) for d in range(10) for i in range(5)]
    step(spark.createDataFrame(rows, schema), 0)
    step(spark.createDataFrame([(3, 0, "new", 2), (3, 0, "newer", 3), (99, 0, "first", 1)], schema), 1)
    step(spark.createDataFrame([(4, 0, "stale", 0)], schema), 2)
    got = {(r.doc, r.text) for r in X.stored(spark, target).collect()}
    assert got == {(d, t) for d, _, t, _ in rows if d != 3} | {(3, "newer"), (99, "first")}


def test_a_batch_rewrites_nothing(spark):
    target = new_path(spark, "log")
    step = X.ingest_batch(target, lambda b: b, buckets=4)
    schema = "doc long, id string, text string, seq long"
    step(spark.createDataFrame([(d, f"{d}", "x", 0) for d in range(100)], schema), 0)
    for epoch in (1, 2, 2):  # the last batch runs again
        step(spark.createDataFrame([(epoch, "a", "new", epoch), (epoch, "b", "new", epoch)], schema), epoch)
    assert spark.read.parquet(target).count() == 104
    got = {(r.doc, r.id, r.text) for r in X.stored(spark, target).collect()}
    assert got == {(d, f"{d}", "x") for d in range(100) if d not in (1, 2)} | {(d, i, "new") for d in (1, 2) for i in "ab"}


def test_routes_of_pairs(spark):
    texts = ["Question: abcd\nAnswer: efgh", "Question: what is it?\nAnswer: a thing\n\nand more", "Where is it?: over there", None]
    got = [(r.doc_id, r.route, r.question, r.answer, r.content) for r in I.qa_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")).orderBy("doc_id").collect()]
    assert got == [(1, "qa", "what is it?", "a thing", "Вопрос: what is it?\n\nОтвет: a thing"), (2, "universal", "Where is it?", "over there", "Вопрос: Where is it?\n\nОтвет: over there")]
    long = spark.createDataFrame([(1, "Question: " + "q" * 300 + "?\nAnswer: " + "a" * 900)], "doc_id long, content string")
    meta = I.qa_chunks(long).first().metadata
    assert (len(meta["question"]), len(meta["answer"]), meta["type"]) == (200, 500, "qa_pair")


SAID = ["Rivers carry water from the mountains to the sea every single day", "Stones of the old bridge were cut by hand in the valley long ago", "Birds return to the northern lakes when the first warm wind blows"]


@pytest.fixture(scope="module")
def answers(spark):
    filler = " ".join(f"Chapter number {i} tells about the town and its {w} people in many words." for i, w in enumerate(["quiet", "busy", "young", "proud", "old", "kind"]))
    docs = [(d, "http://ru.wikipedia.org/1" if d == 1 else f"http://a{d}.org/x", ". ".join(SAID[i] for i in order) + ". " + filler) for d, order in enumerate([(0, 1, 2), (2, 1), (1, 0), (2, 0)])]
    chunks = [(d, i, url, f"Part {i}. {text}" if i else text) for d, url, text in docs for i in range(60 if d == 3 else 1)]
    q = spark.createDataFrame([(1, "water of rivers"), (2, "почему stones"), (3, "birds and lakes"), (4, "nothing at all"), (5, None)], "query_id long, query string")
    pairs = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (2, 0), (2, 1), (3, 3), (3, 1), (4, 77), (9, 0)], "query_id long, doc_id long")
    return q, pairs, spark.createDataFrame(chunks, "doc_id long, idx int, source_url string, text string")


def rows(df):
    return sorted((r.query_id, r.place, r.sentence, r.score, r.profile, round(r.confidence, 9)) for r in df.collect())


def test_answers_to_many_queries(spark, answers):
    q, pairs, chunks = answers
    got = rows(A.answer_queries(q, pairs, chunks))
    assert {r[0] for r in got} == {1, 2, 3}
    said = {(r[0], r[2].split()[0]) for r in got}
    assert {(1, "Rivers"), (3, "Birds")} <= said and (3, "Rivers") not in said and min(got)[2].startswith("Rivers")
    assert {r[0]: r[4] for r in got} == {1: "default", 2: "how_why", 3: "default"}
    for i in (1, 2, 3):  # a batch gives each query what it gets alone
        assert [r for r in got if r[0] == i] == rows(A.answer_queries(q.where(F.col("query_id") == i), pairs, chunks))
        assert [r[1] for r in got if r[0] == i] == list(range(1, sum(r[0] == i for r in got) + 1))
        assert len({r[2][:100].lower() for r in got if r[0] == i}) == sum(r[0] == i for r in got)
    assert A.answer_queries(q, pairs.where("false"), chunks).collect() == []


def test_answers_by_a_plain_version(spark, answers):
    """One query over one document: the scores, worked out by hand from the default profile."""
    q, pairs, chunks = answers
    got = rows(A.answer_queries(q.where("query_id = 1"), pairs.where("doc_id = 0"), chunks))
    text = chunks.where("doc_id = 0").first().text
    said = text.split(". ")
    encode = hashed_words(64)
    wanted = np.array(encode(["water of rivers"])[0])
    w = A.PROFILES["default"]
    for _, _, sentence, score, _, _ in got:
        pos = next(i for i, x in enumerate(said) if x.rstrip(".") == sentence.rstrip("."))
        names = sum(x[:1] != x[:1].lower() for x in sentence.split()[1:])
        credit = 0.6
        raw = w["relevance"] * max(0.0, float(np.dot(encode([sentence])[0], wanted))) + w["domain_credit"] * credit + w["position"] * (1 - pos / len(said)) + w["ner"] * min(names / 20, 1) + w["length"] / (1 + np.exp(-(len(sentence) - w["length_optimal"]) * w["steepness"]))
        assert raw - 0.2 - 1e-5 <= score <= raw + 1e-5  # reranking takes off a fifth of a cosine at most


def test_fifty_chunks_of_a_document(spark, answers):
    _, _, chunks = answers
    gated = I.chunk_quality_gate(chunks).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in gated}[3] == 50


def test_files_are_written_by_many_tasks(spark, small):
    from loamwork.plans.queries_corpus import one_file_each

    names = [r.path.rsplit("/", 1)[1] for r in S.read_corpus_files(spark, one_file_each(spark, small)).select("path").collect()]
    tasks = [n.split("-")[1] for n in names]
    assert len(names) == 178 and len(set(tasks)) >= 4 and max(map(tasks.count, set(tasks))) < 100


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    rows = spark.range(3000).select("id", F.concat(F.lit("né "), F.col("id") % 2990, F.lit("\nx")).alias("text"))
    folder = f"file://{tmp_path}/files"
    S.text_files(rows.unionByName(rows.where("id < 3")), "id", "text", folder)  # an id may stand twice
    found = S.read_corpus_files(spark, folder)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    want = Counter(r.text + "\n" for r in rows.collect()) + Counter(r.text + "\n" for r in rows.where("id < 3").collect())
    assert Counter(r.content for r in found.collect()) == want


def test_file_chunks_are_one_narrow_job(spark):
    """A batch's files are read once and no row is shuffled, whatever their formats."""
    files = spark.createDataFrame([("a", "[1, [2]]", 1, None), ("b", "x,y\n1,2", 2, None), ("c", None, 3, "too large"), ("d", "Question: why is it?\nAnswer: so it is", 4, None), ("e", "just as long.", 5, None)], "path string, content string, seq long, problem string")
    out = X.file_chunks(files)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan and "Join" not in plan and "Union" not in plan
    got = sorted((r.doc, r.kind, r.text, r.seq) for r in out.collect() if r.doc != "c")
    assert [x[:2] for x in got] == [("a", "json_primitive"), ("b", "csv_row"), ("b", "csv_row"), ("d", "qa_pair"), ("e", "whole")]
    assert [(r.id, r.kind, r.text) for r in out.collect() if r.doc == "c"] == [("c", "too large", None)]
