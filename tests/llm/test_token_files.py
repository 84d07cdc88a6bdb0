"""Huffman-coded token files: the code is the best of its limit, blocks come back exactly, rows equal the library's ids."""

import heapq
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loamwork.llm import queries as Q
from loamwork.llm.huffman import STRIDE, Code, code_lengths, read_blocks, write_block
from loamwork.llm.token_files import WordEncoder, read_token_files, token_documents, write_token_files

SMALL = "/root/testdata/sf0.001"


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def limited_cost(counts, limit):
    """The least cost over all sorted length vectors that fill a code of `limit` bits, by trying them all."""
    w = sorted((c for c in counts if c), reverse=True)
    best = None

    def go(i, least, room, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(w):
            best = cost
            return
        for b in range(least, limit + 1):
            if room >= 2 ** (limit - b):
                go(i + 1, b, room - 2 ** (limit - b), cost + b * w[i])

    go(0, 1, 2**limit, 0)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_lengths_are_best(seed):
    rng = random.Random(seed)
    counts = np.array([rng.choice([0, 1, 1, rng.randrange(1, 9), rng.randrange(1, 10**6)]) for _ in range(rng.randrange(2, 60))])
    counts[:2] = 1, 5
    bits = code_lengths(counts, 30).astype(int)
    assert (bits > 0).tolist() == (counts > 0).tolist()
    assert (bits * counts).sum() == huffman_cost(counts.tolist())
    few = np.array([2**k for k in range(7)])
    for limit in (3, 4, 5):
        bits = code_lengths(few, limit).astype(int)
        assert bits.max() <= limit and sum(2.0**-b for b in bits) <= 1
        assert (bits * few).sum() == limited_cost(few.tolist(), limit)
    with pytest.raises(ValueError):
        code_lengths(np.ones(9), 3)


def test_code_is_canonical():
    code = Code(np.array([2, 0, 3, 1, 3]))
    assert [f"{code.codes[i]:0{code.lengths[i]}b}" for i in (3, 0, 2, 4)] == ["0", "10", "110", "111"]


@pytest.mark.parametrize("seed", range(6))
def test_blocks_come_back(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([1, 2, 40, 5000]))
    draw = np.minimum((rng.pareto(0.6, 60_000)).astype(np.int64), size - 1).astype(np.uint32)
    code = Code(code_lengths(np.bincount(draw, minlength=size), 20))
    docs, at = [], 0
    for n in [0, 1, STRIDE - 1, STRIDE, STRIDE + 1, 3 * STRIDE, 7, 20_001]:
        docs.append((None if n == 7 else n - 50, draw[at : at + n]))
        at += n
    data = b"".join(write_block(code, 3, k, 10 * k, d) + b"\n" for k, d in enumerate([docs[:3], docs[3:], [], docs[-1:]]))
    for most in (1, 1 << 20):
        got = list(read_blocks(data, code, most))
        assert [(p, b, f) for p, b, f, *_ in got] == [(3, 0, 0), (3, 1, 10), (3, 2, 20), (3, 3, 30)]
        flat = [(d, x.tolist()) for *_, names, sizes, ids in got for d, x in zip(names, np.split(ids, np.cumsum(sizes)), strict=False)]
        assert flat == [(d, x.tolist()) for d, x in [*docs, docs[-1]]]
    with pytest.raises(ValueError):
        list(read_blocks(data[:-9] + b"x" + data[-8:], code))


def test_encoder_equals_the_library(spark):
    plain, fast = Tokenizer.from_file(Q.word_bpe()), WordEncoder(Q.word_bpe(), most=500)
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    odd = ["", " \t\n\x0b\x0c\r ", "a<|endoftext|>b", "<|ENDOFTEXT|> <|startoftext|>", "It's WE'RE don't ' s", "é é ÅΣΑΣ İ ß", "x" * 5000, "a b c\x1cd\x85e", "🙂👩‍👩‍👧 漢字12 3", "a ́b", "\x00 ﻿#"]
    odd += ["¼½ x²y ªº µ ÀÉ", "ΑΣ Σ Ⱥ İstanbul", "\x85x\xa0y\x1cz", "’quoted’ — “x” €5", "don’t can't ,'s 'sabc", "naïve Ĳ ǅ ˁʰ", "e\u0301 a\u0308b", "Привет, мир 123!", "x" * 1500 + " " + "é" * 1500]
    for t in [*texts, *odd]:
        assert np.frombuffer(fast(t), fast.kind).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:80]


def want(rows):
    plain = Tokenizer.from_file(Q.word_bpe())
    out, start = [], 0
    coded = [(d, plain.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u4").tobytes()), len(r[1]))
    for d, ids in sorted(coded, key=key):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = Q.QUERIES["op13_token_files"](spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want([tuple(r) for r in docs])


def test_edges(spark):
    rows = [(5, None, 1), (5, "", 1), (4, "same words"), (4, "same words"), (4, "others"), (None, "no id"), (None, None), (-3, "long " * 200_000), (9, "#")]
    df = spark.createDataFrame([(*r[:2], 1, "x") for r in rows], "doc_id int, text string, n int, part string")
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, token_documents(df, Q.word_bpe()).collect()), key=key) == want([r[:2] for r in rows])
    assert token_documents(df.where("false"), Q.word_bpe()).collect() == []


def test_many_files_and_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    path = f"file://{tmp_path}/tokens"
    write_token_files(docs, Q.word_bpe(), path, block_ids=1000, file_blocks=3, part_ids=40_000)
    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("length").collect()
    assert len(files) > 20 and max(r[0] for r in files) < 200_000
    plain = Tokenizer.from_file(Q.word_bpe())
    got = {r.doc_id: r for r in read_token_files(spark, path, with_ids=True).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d, t in rows:
        assert got[d].ids == plain.encode(t or "", add_special_tokens=False).ids + [2]
    order = sorted(got.values(), key=lambda r: (r.part, r.within))
    assert [r.doc_id for r in order] == sorted(got)
