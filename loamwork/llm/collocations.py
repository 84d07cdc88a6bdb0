"""Collocations: phrases of two to four words, counted in tiles of frequency-ranked ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.numbering import number_rows
from loamwork.functions.storage import BLOBS, arrow_batches, stage

U = np.uint64
#: A-Z are lowered, `.,;:!?` and line ends become the byte 255 (never in UTF-8), which splits pieces.
BYTES = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Ids are cut into tiles of 2**TILE: 1024 x 1024 cells.
TILE = 10
#: A tile this full (one cell in eight) is counted by direct addresses, and its ids are among the first HOT tiles' ones.
DENSE, HOT = 1 << (2 * TILE - 3), 8
#: As many blobs of cells are merged at once.
FAN = 256


class _Codes(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def word_chunks(docs: DataFrame, most_ids: int = 1_000_000, most_words: int = 200_000) -> DataFrame:
    """lang, chunk, n, words, counts, codes: the texts of docs (lang, text) in chunks of one language.

    codes are little-endian 32-bit numbers: 0 ends a piece, k + 1 is words[k]. n counts the words. A chunk ends after the
    document that brings it to most_ids words or most_words different ones; all of a task's end when they hold four times most_ids.
    """

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        known: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        held: dict[str, int] = {}

        def flush(langs):
            nonlocal seq
            for lang in langs:
                codes, parts = known.pop(lang)
                held.pop(lang)
                all_codes = np.concatenate(parts)
                counts = np.bincount(all_codes, minlength=len(codes))[1:]
                row = {"lang": lang, "chunk": (part << 33) + seq, "n": int(counts.sum()), "words": list(codes)[1:], "counts": counts, "codes": all_codes.tobytes()}
                seq += 1
                yield pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in known:
                    known[lang], held[lang] = (_Codes({b"\xff": 0}), []), 0
                codes, parts = known[lang]
                words = (text.as_py() or b"").translate(BYTES).replace(b"\xff", b" \xff ").split()
                words.append(b"\xff")
                parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                held[lang] += len(words)
                if sum(held.values()) >= 4 * most_ids:
                    yield from flush(list(known))
                elif held[lang] >= most_ids or len(codes) >= most_words:
                    yield from flush([lang])
        yield from flush(list(known))

    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "lang string, chunk long, n long, words array<binary>, counts array<long>, codes binary")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (lang, f, ...; a staged table) with id: 0 is a language's most frequent row, ties by hash buckets of `order`."""
    sizes = rows.groupBy("lang", "f").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("lang").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each frequency
    starts = sizes.select("lang", "f", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_start"))
    numbered = number_rows(rows, order, "_in", ["lang", "f"])
    return numbered.join(starts, ["lang", "f"]).withColumn("id", F.col("_start") + F.col("_in")).drop("_start", "_in")


def sequences(chunks: DataFrame, frequent: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, g, buckets, w, u: chunks numbered from 0 in each language, as ids of frequent words (-1: a break); an empty u says that the units are the words.

    A chunk's own words meet the ids of frequent ones; codes are then looked up in an array, so no table of words is sent
    to all tasks.
    """
    mine = chunks.select("lang", "chunk", F.posexplode("words").alias("at", "word")).withColumn("word", F.col("word").cast("string"))
    ids = sized_join(mine, frequent.select("lang", "word", "id"), ["lang", "word"])
    ids = ids.groupBy("lang", "chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    names = number_rows(stage(chunks.select("lang", "chunk"), "chunk-names"), ["chunk"], "g", ["lang"])
    ids = sized_join(ids.join(names, ["lang", "chunk"]), langs.select("lang", "buckets"), ["lang"])

    def run(batches):
        for batch in batches:
            out = []
            for codes, ids in zip(batch.column(3), batch.column(4), strict=True):
                x = np.frombuffer(codes.as_buffer(), "<i4")
                at, number = ids.values.field(0).to_numpy(), ids.values.field(1).to_numpy()
                table = np.full(int(x.max()) + 1, -1, "i4")
                table[at + 1] = number
                w = table[x]
                w = w[np.concatenate([[True], (w[1:] >= 0) | (w[:-1] >= 0)])]
                out.append(w.astype("<i4").tobytes())
            none = pa.array([b""] * len(out), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary()), none], ["lang", "g", "buckets", "w", "u"])

    both = chunks.select("lang", "chunk", "codes").join(ids, ["lang", "chunk"]).select("lang", "g", "buckets", "codes", "ids")
    return both.mapInArrow(run, "lang string, g long, buckets long, w binary, u binary")


def cell_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for a pair of ids: its tile, then its cell in the tile."""
    a, b, t, low = a.astype(U), b.astype(U), U(TILE), U((1 << TILE) - 1)
    return ((a >> t) << U(42)) | ((b >> t) << U(20)) | ((a & low) << t) | (b & low)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket, of n, of each key, by its tile and the row there; those of a multiple of n buckets are finer ones."""
    strip = ((keys >> U(20)) << U(TILE)) | ((keys >> U(TILE)) & U((1 << TILE) - 1))
    h = (strip ^ (strip >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = ((h ^ (h >> U(29))) * U(0x94D049BB133111EB)) >> U(32)
    return ((h * U(n)) >> U(32)).astype(np.int64)


def count_cells(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys ascending, counts) of pairs of ids: full tiles by bincount over all their cells, the others by sorting coordinates."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ta, tb = a >> TILE, b >> TILE
    hot = (ta < HOT) & (tb < HOT)
    tile = np.where(hot, ta * HOT + tb, HOT * HOT)
    rest = np.ones(len(a), bool)
    for t in np.flatnonzero(np.bincount(tile, minlength=HOT * HOT + 1)[:-1] >= DENSE):
        here = tile == t
        rest &= ~here
        cells = np.bincount(((a[here] & 1023) << TILE) | (b[here] & 1023), minlength=1 << 2 * TILE)
        used = np.flatnonzero(cells)
        found.append(((U(t // HOT) << U(42)) | (U(t % HOT) << U(20)) | used.astype(U), cells[used]))
    found.append(np.unique(cell_keys(a[rest], b[rest]), return_counts=True))
    keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def _ids(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<i4")


def _pairs(w: pa.Scalar, u: pa.Scalar, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, unit, word) where a frequent phrase of k words and the one a word later stand: only there may k + 1 be frequent."""
    w, u = _ids(w), _ids(u)
    u = u if len(u) else w
    n = max(0, len(w) - k)
    at = np.flatnonzero((u[:n] >= 0) & (u[1 : n + 1] >= 0))
    return at, u[at].astype(np.int64), w[at + k].astype(np.int64)


def tile_cells(seqs: DataFrame, k: int) -> DataFrame:
    """lang, g, bucket, buckets, keys, counts: the cells of each chunk, a blob for each bucket it has any in."""

    def run(batches):
        for batch in batches:
            for lang, g, n, w, u in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
                _, a, b = _pairs(w, u, k)
                keys, counts = count_cells(a, b)
                yield pa.RecordBatch.from_pylist([{"lang": lang, "g": g, "bucket": x, "buckets": n, "keys": key, "counts": c} for x, key, c in _split(keys, counts, n)], _CELLS)

    return seqs.select("lang", "g", "buckets", "w", "u").mapInArrow(run, _CELLS_SQL)


_CELLS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("bucket", pa.int64()), ("buckets", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_CELLS_SQL = "lang string, g long, bucket long, buckets long, keys binary, counts binary"


def _split(keys: np.ndarray, counts: np.ndarray, n: int):
    """(bucket, keys, counts) as bytes, of each bucket of n that has keys."""
    bucket = buckets_of(keys, n)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order].astype("<u8"), counts[order].astype("<i8")
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[i]), keys[i:j].tobytes(), counts[i:j].tobytes()


def _flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.zeros(0, kind)


def bucket_plan(langs: list[tuple[str, int, int]], chunk_words: int, bucket_cells: int) -> tuple[dict[str, int], list[int]]:
    """(each language's first buckets; how many finer ones each round but the last makes of one), of languages (lang, n, chunks).

    Round r joins FAN**r chunks, of chunk_words words at most: as many as its buckets must hold about bucket_cells cells each.
    """
    rounds = 1
    while FAN**rounds < max((c for _, _, c in langs), default=0):
        rounds += 1
    need = lambda n, r: max(1, -(-min(n, chunk_words * FAN**r) // bucket_cells))
    first, finer, made = {x: need(n, 1) for x, n, _ in langs}, [], 1
    for r in range(2, rounds + 1):
        finer.append(max((-(-need(n, r) // (first[x] * made)) for x, n, _ in langs), default=1))
        made *= finer[-1]
    return first, finer


def merged(cells: DataFrame, least: int | None, finer: int = 1) -> DataFrame:
    """Blobs of FAN neighbours g and one bucket become one, cut into `finer` buckets; with `least`, only counts of at
    least that many stay, in one bucket: the last round."""
    fan = FAN

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _flat(table["keys"], "<u8"), _flat(table["counts"], "<i8")
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        counts, keys = np.add.reduceat(counts[order], first) if len(first) else counts, keys[first]
        lang, g, bucket, n = (table[c][0].as_py() for c in ("lang", "g", "bucket", "buckets"))
        if least is None:
            rows = [(x, n * finer, a, b) for x, a, b in _split(keys, counts, n * finer)]
        else:
            keep = counts >= least
            rows = [(bucket, n, keys[keep].tobytes(), counts[keep].tobytes())]
        return pa.Table.from_pylist([{"lang": lang, "g": g // fan, "bucket": x, "buckets": m, "keys": a, "counts": b} for x, m, a, b in rows], _CELLS)

    return cells.groupBy("lang", "bucket", F.floor(F.col("g") / FAN)).applyInArrow(lambda table: run(table), _CELLS_SQL)


_IDS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])


def answered(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """lang, g, bucket, keys, ids: for each blob, those of its keys that have an id in ids (lang, g, bucket, keys, ids) of the round after."""

    def run(blobs: pa.Table, known: pa.Table) -> pa.Table:
        keys, number = _flat(known["keys"], "<u8"), _flat(known["ids"], "<i4")
        order = np.argsort(keys, kind="stable")
        keys, number = keys[order], number[order]
        out = []
        if len(keys):
            for lang, g, bucket, blob in zip(blobs["lang"].to_pylist(), blobs["g"].to_pylist(), blobs["bucket"].to_pylist(), blobs["keys"], strict=True):
                own = np.frombuffer(blob.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                if hit.any():
                    out.append({"lang": lang, "g": g, "bucket": bucket, "keys": own[hit].tobytes(), "ids": number[at[hit]].tobytes()})
        return pa.Table.from_pylist(out, _IDS)

    left = cells.select("lang", "g", "bucket", "keys").groupBy("lang", "bucket", F.floor(F.col("g") / FAN))
    return left.cogroup(ids.groupBy("lang", "bucket", F.col("g"))).applyInArrow(lambda a, b: run(a, b), "lang string, g long, bucket long, keys binary, ids binary")


def next_units(seqs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """seqs with u: the ids of frequent phrases of k + 1 words, from each chunk's answers (lang, g, keys, ids)."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys, number = _flat(known["keys"], "<u8"), _flat(known["ids"], "<i4")
        order = np.argsort(keys, kind="stable")
        keys, number = keys[order], number[order]
        out = []
        for r, w, u in zip(rows.select(["lang", "g", "buckets"]).to_pylist(), rows["w"], rows["u"], strict=True):
            at, a, b = _pairs(w, u, k)
            w = _ids(w)
            new = np.full(len(w), -1, "<i4")
            if len(keys) and len(at):
                own = cell_keys(a, b)
                found = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                new[at] = np.where(keys[found] == own, number[found], -1)
                out.append(r | {"w": w.tobytes(), "u": new.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("lang", pa.string()), ("g", pa.int64()), ("buckets", pa.int64()), ("w", pa.binary()), ("u", pa.binary())]))

    return seqs.groupBy("lang", "g").cogroup(ids.groupBy("lang", "g")).applyInArrow(run, "lang string, g long, buckets long, w binary, u binary")


def _frequent(cells: DataFrame) -> DataFrame:
    """lang, bucket, key, a, b, f: a row for each cell of the last round's blobs."""

    def run(batches):
        for batch in batches:
            for lang, bucket, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                k, low, t = np.frombuffer(keys.as_buffer(), "<u8"), U((1 << TILE) - 1), U(TILE)
                a = ((k >> U(42)) << t) | ((k >> t) & low)
                b = (((k >> U(20)) & U((1 << 22) - 1)) << t) | (k & low)
                cols = [pa.array(x.astype("i8")) for x in (k, a, b)] + [pa.array(np.frombuffer(counts.as_buffer(), "<i8"))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array([bucket] * len(k), pa.int64()), *cols], ["lang", "bucket", "key", "a", "b", "f"])

    return cells.select("lang", "bucket", "keys", "counts").mapInArrow(run, "lang string, bucket long, key long, a long, b long, f long")


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, chunk_ids: int = 1_000_000, bucket_cells: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f of every phrase of k = 1 to `longest` words that occurs `least` times; lang, n of every language).

    Words are ranked by frequency in each language. In each chunk of text, pairs of neighbouring ids fall into tiles of
    1024 x 1024 ids; full tiles are counted by direct addresses, the rest by sorted coordinates. Counts of FAN chunks
    are merged at once, bucket by bucket, in as many rounds as the chunks need: buckets grow finer as chunks are joined (bucket_plan),
    so no task ever holds more than about bucket_cells cells, and no pair, however frequent, has more than a row a chunk. Pairs
    that are frequent are ranked again, their ids go back the same way to the chunks that hold them, and a frequent
    phrase and the next word make the next round's pairs.
    """
    with arrow_batches(docs.sparkSession):
        chunks = stage(word_chunks(docs, chunk_ids), "word-chunks", BLOBS)
    langs = chunks.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"))
    langs = stage(langs, "langs")
    longest_chunk = chunks.agg(F.max("n")).first()[0] or 0
    first, finer = bucket_plan([tuple(r) for r in langs.select("lang", "n", "chunks").collect()], longest_chunk, bucket_cells)  # a row for each language
    known = docs.sparkSession.createDataFrame(list(first.items()), "lang string, buckets long")
    langs = stage(langs.join(known, "lang"), "langs")
    words = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    words = stage(words.where(F.col("f") >= least).withColumn("word", F.col("word").cast("string")), "words")
    words = stage(ranked(words, ["word"]), "ranked-words")
    seqs = sequences(chunks, words, langs)
    units = words.select("lang", "id", F.col("word").alias("phrase"), "f")
    single = units.select("lang", F.col("id").alias("b"), F.col("phrase").alias("last"))
    found = [units.withColumn("k", F.lit(1))]
    with arrow_batches(docs.sparkSession, 4):  # rows are chunks and blobs of some MB
        for k in range(1, longest):
            seqs = stage(seqs, "sequences", BLOBS)
            levels = [stage(tile_cells(seqs, k), "cells", BLOBS)]
            for f in finer:
                levels.append(stage(merged(levels[-1], None, f), "cells", BLOBS))
            levels.append(stage(merged(levels[-1], least), "cells", BLOBS))
            rows = stage(_frequent(levels[-1]), "frequent")
            if k + 1 < longest:
                rows = stage(ranked(rows, ["key"]), "ranked")
                ids = rows.groupBy("lang", "bucket").agg(F.collect_list(F.struct("key", "id")).alias("x"))
                ids = _packed(ids)
                for level, f in zip(reversed(levels[:-1]), [*reversed(finer), 1], strict=True):
                    ids = stage(answered(level, ids), "answers", BLOBS).withColumn("bucket", F.floor(F.col("bucket") / f))
                seqs = next_units(seqs, ids, k)
            else:
                rows = rows.withColumn("id", F.lit(0).cast("long"))
            heads = units.select("lang", F.col("id").alias("a"), "phrase")
            named = sized_join(sized_join(rows, heads, ["lang", "a"]), single, ["lang", "b"])
            units = stage(named.select("lang", "id", F.concat_ws(" ", "phrase", "last").alias("phrase"), "f"), "phrases")
            found.append(units.withColumn("k", F.lit(k + 1)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("lang", "phrase", "k", "f"), langs.select("lang", "n")


def _packed(ids: DataFrame) -> DataFrame:
    """lang, g (0), bucket, keys, ids of lists of (key, id)."""

    def run(batches):
        for batch in batches:
            x = batch.column(2)
            keys = [y.values.field(0).to_numpy().astype("<u8").tobytes() for y in x]
            ids = [y.values.field(1).to_numpy().astype("<i4").tobytes() for y in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(x), pa.int64()), batch.column(1), pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], _IDS.names)

    return ids.mapInArrow(run, "lang string, g long, bucket long, keys binary, ids binary")


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, most: int = 2000, longest: int = 4, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of two to `longest` words.

    docs: lang (null: und), text (null: empty). a, l and r are the counts of a phrase and of its parts before and after the cut of
    the lowest score, floor(2000000 a / (l + r)), the earliest of equals; n counts the language's words. Phrases within a
    longer one that has `covered` per cent of their count are left out. Ties go by a, then by the phrase's bytes. Repeated
    rows count as often as they stand; a table without frequent phrases has no rows; other columns are not read.
    """
    counts, langs = phrase_counts(docs, least, longest, **how)
    counts = stage(counts, "phrase-counts")
    long_phrases = counts.where("k > 1")
    cut = long_phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    cut = cut.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = "decimal(38,0)"
    score = F.expr(f"CAST((CAST(2000000 AS {wide}) * CAST(a AS decimal(20,0))) DIV (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0))) AS long)")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    inside = long_phrases.where("k > 2").select("lang", F.split("phrase", " ").alias("w"), "k", "f")
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = inside.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("over").isNull() | (big("over") * 100 < big("a") * covered))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase"))
    top = left.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)
    return sized_join(top, langs, ["lang"]).select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")


#: The same rows in DuckDB's SQL.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
spans AS (SELECT lang, a, k, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS over_a FROM spans GROUP BY ALL),
kept AS (SELECT b.* FROM best AS b LEFT JOIN inside AS s USING (lang, phrase) WHERE s.over_a IS NULL OR 100::HUGEINT * s.over_a < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
