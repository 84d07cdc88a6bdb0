"""Empty tables, nulls, repeats, very long texts and clashing names: no crash, and the results that the docstrings define."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamwork.llm import queries as Q
from loamwork.llm.arc import archive_pages
from loamwork.llm.fingerprints import fingerprint_documents
from loamwork.llm.langid import identify_documents, language_stage
from loamwork.llm.minhash import dedup_stage, near_duplicates
from loamwork.llm.mixing import mix_documents, mix_stage
from loamwork.llm.packing import pack_documents
from loamwork.llm.pii import pii_documents, redact_stage
from loamwork.llm.quality import score_documents
from loamwork.llm.sharding import shard_documents
from loamwork.llm.vectors import near_vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep long, score double, rejected boolean, pattern string, shard int, tie long, `start` int"
X = (1, 2, 0.5, True, "p", 3, 4, 5)
LONG = "word " * 40_000 + "x" * 50_000 + " mail a@b.co 10.0.0.1 "
ROWS = [
    (1, None, "en", "a", 0, *X),
    (2, "", "en", "a", 0, *X),
    (3, " \t\n ", None, None, 3, *X),
    (4, "one", "en", "b", 3, *X),
    (5, "the same text of some words here and there", "en", "b", 10, *X),
    (6, "the same text of some words here and there", "en", "b", 10, *X),
    (7, "repeated row ünïcode 漢字 🙂", "de", "c", 10, *X),
    (7, "repeated row ünïcode 漢字 🙂", "de", "c", 10, *X),
    (None, "no id at all", None, "c", 10, *X),
    (8, LONG, "en", "b", len(LONG), *X),
    (9, "12345 !!! ###", "en", None, 13, *X),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, None), (6, 0, 0), (4, None, 1), (None, 1, 1), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_mixing(docs, none):
    rows, _ = mix_documents(docs)
    got = rows.collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in got)
    assert by_id(rows)[1]["size"] == 0
    assert mix_documents(none)[0].count() == 0
    assert mix_stage(docs).columns == docs.columns and mix_stage(none).count() == 0


def test_sharding(docs, none):
    got = shard_documents(docs, 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 4, i // 4) for i in range(len(ROWS)))
    assert shard_documents(none).count() == 0


def test_language(docs, none):
    got = identify_documents(docs)
    assert got.count() == len(ROWS)
    r = by_id(got)
    assert [r[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and r[5].lang_pred in ("en", "de", "und")
    assert identify_documents(none).count() == 0
    kept = language_stage(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()}.isdisjoint({1, 2, 3, 9})
    assert language_stage(none).count() == 0


def test_fingerprints(docs, none, spark):
    got = fingerprint_documents(docs)
    r = by_id(got)
    assert got.count() == len(ROWS) and r[1].fingerprint == "" and r[5].fingerprint == r[6].fingerprint and r[5].near_next == 1.0
    assert fingerprint_documents(none).count() == 0
    one = fingerprint_documents(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_warc(spark):
    page = "<p>" + "z" * 2000 + "</p>"
    rows = [(1, "http://a/ b", page, 0), (2, None, page, 0), (3, "", None, 0), (None, "http://n", page, 0), (4, "http://r", page, 0), (4, "http://r", page, 0), (5, "http://w", "WARC/1.1\r\n\r\n" + page, 0)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, version int")
    got = archive_pages(p).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("1", "revisit", 4), ("2", "revisit", 4), ("3", "response", None), ("None", "revisit", 4), ("4", "response", None), ("4", "response", None), ("5", "response", None)])
    assert archive_pages(p.where("false")).count() == 0


def test_quality(docs, none, labels):
    got = score_documents(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert score_documents(none, labels.where("false")).count() == 0
    assert score_documents(docs, labels.where("false")).count() == len(ROWS)


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, None], 1), (8, [1.0, 0.01], 1), (9, [1.0, 0.0], 2), (10, [1.0], 1), (1, [1.0, 0.0], 1), (11, [], 1), (None, [1.0, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_vectors(v).collect()
    assert len(got) == len(rows)
    x = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert x[2] == (3, 1, False) and x[8] == (3, 1, False) and x[1] == (3, 1, True)
    assert all(x[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11))
    assert near_vectors(v.where("false")).count() == 0


def test_pii(docs, none):
    r = by_id(pii_documents(docs))
    assert (r[8].n_email, r[8].n_ip) == (1, 1) and r[1].spans == "" and pii_documents(docs).count() == len(ROWS)
    assert pii_documents(none).count() == 0
    red = redact_stage(docs)
    x = by_id(red)
    assert red.columns == docs.columns and red.count() == len(ROWS)
    assert x[8].text.endswith(" mail [EMAIL] [IP] ") and x[8].n_chars == len(x[8].text) and x[1].text is None and x[5].n_chars == 10


def test_minhash(docs, none):
    got = near_duplicates(docs, words=2)
    r = by_id(got)
    assert got.count() == len(ROWS)
    assert (r[1].n_shingles, r[1].component_id, r[1].kept) == (0, 1, True) and (r[6].component_id, r[6].kept) == (5, False) and r[4].n_shingles == 1
    assert near_duplicates(none).count() == 0
    kept = dedup_stage(docs, 2)
    assert kept.columns == docs.columns and 6 not in {x.doc_id for x in kept.collect()}


def test_packing(docs, none):
    got = pack_documents(docs, Q.byte_bpe(), 64).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len({r.doc_id for r in got}) == len({r[0] for r in ROWS})
    assert pack_documents(none, Q.byte_bpe()).count() == 0


def test_pipeline_stages(spark, docs, none):
    five = ("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs.select(*five), none.select(*five)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert tuple(stage(spark, frame, "").columns) == five, name


def test_registered():
    assert {int(k[2:].split("_")[0]) for k in Q.QUERIES} == set(range(1, 11))
    assert F is not None
