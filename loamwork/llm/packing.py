"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions.numbering import number_rows
from loamwork.functions.storage import stage

#: Fixed value: the pattern that splits text for byte-level pair encoding.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that is neither at the start nor at the end of its run of white space: the text can't be cut there.
INNER_SPACE = re.compile(r"\s (?:\s|\Z)")
LONG_WORD = 1000


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A text is cut before single spaces, where the pattern always cuts, and words are looked up in a bounded table.
    Long words go to the tokenizers library, whose merging isn't quadratic in the length of a word, and so do whole texts
    that hold one of the file's added tokens, which that library gives ids of their own.
    """

    def __init__(self, path: str, cache: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and t not in added}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.most = cache

    def ids(self, text: str) -> bytes:
        if len(text) > LONG_WORD and max(map(len, text.split()), default=0) > LONG_WORD or len(text) - len(text.strip()) > LONG_WORD:
            got = self.slow.encode(text, add_special_tokens=False).ids
        else:
            got = self.fast.encode_ordinary(text)
        return np.array(got, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if INNER_SPACE.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        out, known = [self.ids(first)], self.known
        for w in rest:
            ids = known.get(w)
            if ids is None:
                ids = self.ids(" " + w)
                if len(known) < self.most and len(w) < 40:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's ids followed by end_id.

    A null text is an empty one: its only id is end_id. Documents of more than `capacity` ids are cut; the first piece
    takes the remainder and the others are full. Whole texts are encoded, one Arrow batch at a time.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        encode, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py() or "") + end
                n = len(data) // 4
                ends = list(range((n - 1) % capacity + 1, n + 1, capacity))
                for k, stop in enumerate(ends):
                    begin = ends[k - 1] if k else 0
                    part = memoryview(data)[4 * begin : 4 * stop]
                    rows.append((doc_id, k, begin, stop - begin, zlib.crc32(part), np.frombuffer(part, "<u4").astype("i4") if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(names)], types, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of size classes, longest first: (length, first rank, how many, first sequence, offset).

    Pieces and gaps are sorted by size. In a round, all pieces of a length meet the smallest gap that holds them; where
    there are more pieces than gaps, ranks decide: the first go there and the others to the next larger gap, then to
    new sequences. The gaps shrink, and the next round begins. Sizes are at most `capacity`, so is the number of
    classes: a round costs the same for ten pieces as for ten billion.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: (first sequence, how many)
    sizes: list[int] = []
    out, sequences = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[k]
                if n > left:
                    add(gap, first + left, n - left)
                n = min(n, left)
            else:
                gap, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            out.append((length, rank, n, first, capacity - gap))
            add(gap - length, first, n)
            rank, left = rank + n, left - n
    return out


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, length, ...; a staged table) with sequence_id and offset: gapless from 0 in each sequence.

    Only the number of pieces of each length (at most `capacity` numbers) meets the driver. A piece's rank among those
    of its length, found by hash buckets, says which sequence and offset are its own, so copies that all have one
    length are spread over the tasks. Repeated rows are pieces of their own.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, capacity)
    table = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, rank0 long, n long, first long, offset long")
    extra = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = number_rows(pieces, extra, "_lw_rank", ["length"])
    p = table.select(F.col("length").alias("_lw_length"), "rank0", "n", F.col("first").alias("_lw_first"), F.col("offset").alias("_lw_offset"))
    on = (F.col("length") == F.col("_lw_length")) & (F.col("_lw_rank") >= F.col("rank0")) & (F.col("_lw_rank") < F.col("rank0") + F.col("n"))
    placed = ranked.join(F.broadcast(p), on)  # a few rows for each length from 1 to capacity
    return placed.select(*pieces.columns, (F.col("_lw_first") + F.col("_lw_rank") - F.col("rank0")).alias("sequence_id"), F.col("_lw_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and pack docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset. See the two functions above."""
    return pack_pieces(stage(tokenized_pieces(docs, tokenizer, capacity), "pieces"), capacity)
