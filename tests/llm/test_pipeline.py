"""Stages of the pipeline against plain versions (near duplicates and personal data: see test_brute)."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loamwork.llm import queries as Q
from loamwork.llm.langid import train
from loamwork.llm.mixing import mix_documents

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(10**6, "История нашего города начинается давно", None, "src0", 38), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "12345", None, None, 5)]
    return d.unionByName(spark.createDataFrame(odd, d.schema))


def test_language_stage(spark, docs):
    model = train(docs)
    want = {}
    for r in docs.collect():
        lang, _, rejected, _, _ = model.predict(pa.array([r.text], pa.string()))
        if not rejected[0]:
            want[r.doc_id] = (lang[0], r.text, r.source, r.n_chars)
    got = {r.doc_id: (r.lang, r.text, r.source, r.n_chars) for r in STAGES["language_id"](spark, docs, SMALL).collect()}
    assert got == want and not {10**6, 10**6 + 1, 10**6 + 2} & set(got) and len(got) >= docs.count() - 4


def test_mixing_stage(spark, docs):
    rows = mix_documents(docs)[0].collect()
    want = {r.doc_id: r.taken // r["size"] for r in rows if r.taken}
    out = STAGES["mixing"](spark, docs, SMALL)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(want)


def test_packing_stage(spark, docs):
    plain = Tokenizer.from_file(Q.byte_bpe())
    pieces, places = defaultdict(list), defaultdict(list)
    for r in STAGES["packing"](spark, docs.unionByName(docs.where("doc_id < 20")), SMALL).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for r in docs.collect():
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
        first = (n - 1) % 2048 + 1
        want = [(k, max(0, first + 2048 * (k - 1)), first if not k else 2048) for k in range(-(-n // 2048))]
        assert sorted(pieces[r.doc_id]) == sorted(want * (2 if r.doc_id < 20 else 1))
    for s in places.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(s)] == [0, *ends[:-1]]
