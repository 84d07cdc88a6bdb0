"""Token ids of documents in files of Huffman-coded blocks, in ascending order of doc_id."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import arrow_batches, new_path, stage
from loamwork.llm.huffman import Code, code_lengths, read_blocks, write_block

#: Longest code in bits: tables of a million entries, and room for a million different ids.
LIMIT = 20

# The tokenizer's words, as its file has them and for the letters a-z and Latin ones up to U+02C1.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LETTER, DIGIT, BLANK = "a-zªµºß-öø-ÿĀ-ˁ", "0-9²³¹¼½¾", " \t\n\x0b\x0c\r\x85\xa0"
WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{DIGIT}]|[^{BLANK}{LETTER}{DIGIT}]+")
#: Characters of which WORDS does not know the kind: all but ASCII, Latin, general punctuation and the euro sign.
OTHER = re.compile("[^\x00-ˁ\u2010-\u2027\u2030-\u205e€]")
#: Longer words go to the tokenizers library, whose merging isn't quadratic in their length.
LONG_WORD = 1000


class WordEncoder(dict):
    """Token ids of whole texts under a word-level BPE file, as little-endian 16- or 32-bit numbers.

    Words of lower-cased, normalised text are looked up in a bounded table (this one); a new one is merged by tiktoken, which
    gets the file's merges as ranks and the end of a word as a byte that UTF-8 never has. Pieces between white space that hold
    characters of other scripts go to the tokenizers library, and so do whole texts with the string of an added
    token, and all texts if the file splits words in another way.
    """

    def __init__(self, path: str, most: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        model, pattern = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.core = None
        if pattern == SPLIT and steps == ["NFC", "Replace", "Lowercase"] and model["end_of_word_suffix"] == "</w>" and merged == sorted(merged):
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
            bytes_of = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>")
            ranks = {bytes_of(t): i for t, i in model["vocab"].items() if t not in added}
            self.core = tiktoken.Encoding("file", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return self.library(word)
        ids = np.array(self.core.encode_single_piece(word.encode() + b"\xff"), self.kind).tobytes()
        if len(word) < 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # one letter at a time: no final sigma

    def __call__(self, text: str) -> bytes:
        if self.core is None or self.added and self.added.search(text):
            return self.library(text)
        low = self.lowered(text)
        if low.isascii() or not OTHER.search(low):
            return b"".join(map(self.__getitem__, WORDS.findall(low)))
        out = []
        for piece in map(bytes.decode, text.encode().split()):
            low = self.lowered(piece)
            out.append(self.library(piece) if OTHER.search(low) else b"".join(map(self.__getitem__, WORDS.findall(low))))
        return b"".join(out)


@cache
def encoder(path: str) -> WordEncoder:
    """One table for all the tasks that a Python worker runs."""
    return WordEncoder(path)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n, tie, ids (as WordEncoder has them) of docs (doc_id, text): a text's ids and then end_id; null is empty.

    Each task ends with a row of n = -1 whose `ids` are its counts of all ids, 64 bits each.
    """

    def run(batches):
        encode = encoder(tokenizer)
        end, total = np.array([end_id], encode.kind).tobytes(), np.zeros(encode.tokenizer.get_vocab_size(), np.int64)

        def rows(names, n, tie, ids):
            return pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(tie, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "tie", "ids"])

        for batch in batches:
            ids = [encode(x.as_py() or "") + end for x in batch.column(1)]
            flat = [np.frombuffer(x, encode.kind).astype("<u4") for x in ids]
            if flat:
                total += np.bincount(np.concatenate(flat), minlength=len(total))
            yield rows(batch.column(0), [len(x) for x in flat], [zlib.crc32(x) for x in flat], ids)
        yield rows(pa.array([None], pa.int64()), [-1], [0], [total.astype("<i8").tobytes()])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, tie long, ids binary")


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n over all rows: the tasks' counts, summed."""

    def unpack(batches):
        for batch in batches:
            for x in batch.column(0):
                total = np.frombuffer(x.as_buffer(), "<i8")
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return ids.where("n < 0").select("ids").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, block_ids: int = 65_536, file_blocks: int = 64, part_ids: int = 8_000_000) -> None:
    """Write docs (doc_id, text) under path: `codebook` (id, bits; Parquet) and `blocks` (files of huffman.write_block).

    A null text is an empty one: its only id is end_id. Documents go in ascending order of doc_id (nulls first, rows of
    one id by a checksum of their ids): ranges of about part_ids ids are sorted, cut into blocks of whole documents of at
    least block_ids ids (the last of a range may be smaller), and written file_blocks to a file, so a task holds a block
    and a document at a time. The ids are coded by counts over all documents: one array of at most vocabulary size meets
    the driver. Spark's text writer puts the blocks down as they are, with a line feed after each.
    """
    spark = docs.sparkSession
    with arrow_batches(spark):
        ids = stage(token_ids(docs, tokenizer, end_id), "token-ids")
        found = {r["id"]: r["n"] for r in id_counts(ids).collect()}
        counts = np.zeros(max(found, default=0) + 1, np.int64)
        counts[list(found)] = list(found.values())
        lengths = code_lengths(counts, max(LIMIT, int(len(found)).bit_length()))
        rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
        spark.createDataFrame(rows, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
        total = int(counts.sum())

        def blocks(batches):
            code, part, kind = Code(lengths), TaskContext.get().partitionId(), encoder(tokenizer).kind
            held: list[tuple[int | None, np.ndarray]] = []
            n, first, number = 0, 0, 0

            def cut():
                return pa.RecordBatch.from_arrays([pa.array([write_block(code, part, number, first, held)], pa.binary())], ["block"])

            for batch in batches:
                for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    held.append((d, np.frombuffer(x.as_py(), kind)))
                    n += len(held[-1][1])
                    if n >= block_ids:
                        yield cut()
                        held, n, first, number = [], 0, first + n, number + 1
            if held:
                yield cut()

        ranges = ids.where("n >= 0").repartitionByRange(max(1, -(-total // part_ids)), F.col("doc_id").asc_nulls_first(), "tie", "n")
        ordered = ranges.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "n").select("doc_id", "ids")
        out = ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
        out.write.option("maxRecordsPerFile", file_blocks).text(f"{path}/blocks")


def codebook(spark: SparkSession, path: str) -> np.ndarray:
    """Bits of each id, by a written codebook: a row for each id of the vocabulary that occurs."""
    rows = spark.read.parquet(f"{path}/codebook").collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        out[r["id"]] = r["bits"]
    return out


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, part, within (ids of the part before the document), n_tokens, ids_crc32 (and ids) from files of write_token_files.

    Files are read whole, one at a time (their size is bounded by file_blocks); checksums of blocks are confirmed.
    """
    lengths = codebook(spark, path)
    schema = "doc_id long, part int, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        code = Code(lengths)
        for batch in batches:
            for data in batch.column(0):
                for part, _, first, names, sizes, ids in read_blocks(data.as_buffer().to_pybytes(), code):
                    ends = np.cumsum(sizes)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    columns = [pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype("i4"), pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return spark.read.format("binaryFile").load(f"{path}/blocks").select("content").mapInArrow(run, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """rows (part, within, n_tokens, ...; a staged table) with `start`: ids of all documents before, over all parts.

    Parts are summed in groups of 1000, so a window sees the parts of one group, or the groups.
    """
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.floor(F.col("part") / 1000))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("in_group", before(Window.partitionBy("g").orderBy("part")))
    groups = sums.groupBy("g").agg(F.sum("n").alias("n")).withColumn("base", before(Window.orderBy("g"))).drop("n")
    starts = stage(sums.join(groups, "g").select("part", (F.col("in_group") + F.col("base")).alias("base")), "part-starts")
    return sized_join(rows, starts, ["part"]).withColumn("start", F.col("base") + F.col("within")).drop("base")


def token_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, as read back from the files written under path (a new one).

    Null texts are empty; rows of one doc_id, or of none, follow each other and each has its own start; an empty table has no
    rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_token_files(docs, tokenizer, path, end_id)
    with arrow_batches(spark, 4):  # rows are files
        rows = stage(read_token_files(spark, path), "token-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
