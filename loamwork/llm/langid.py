"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.folds import bounded_sample, held_out
from loamwork.llm.shingles import slices, text_buffers

ORDER = 4
ODD = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64
#: Class of all that is no letter, and of letters that training never saw.
GAP, OTHER = 0, 1
#: Lengths of text that rejection tells apart: 1, 2, 4, ... 256 classes. Longer texts count as 256: parts of a document
#: that differ from the rest are as long as the document, so its mean does not settle further.
WINDOWS = 9


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter (categories L*)."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def lowered(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row of each) of the lower-cased texts i to j; null is empty."""
    texts = [(x.as_py() or "").lower() for x in column[i:j]]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return points, np.repeat(np.arange(j - i), [len(t) for t in texts])


def classes(points: np.ndarray, rows: np.ndarray, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, row) of n rows: each begins and ends with a gap of its own, and runs of gaps within a row are one."""
    starts, ends = np.searchsorted(rows, np.arange(n)), np.searchsorted(rows, np.arange(n), "right")
    both = np.stack([starts, ends], 1).ravel()  # start and end of row 0, of row 1, ...
    c = np.insert(table[points], both, GAP)
    r = np.insert(rows, both, np.repeat(np.arange(n), 2))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != GAP) | (c[:-1] != GAP) | (r[1:] != r[:-1])
    return c[keep], r[keep]


def grams(c: np.ndarray, r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, row) for all classes but each row's first gap: packed runs of `order` classes, the last in the lowest 16 bits.

    What lies before a row counts as gaps, whatever row is there: a row's runs depend on its text alone.
    """
    g = np.zeros(len(c), U)
    for back in range(order - 1, -1, -1):
        x = np.zeros(len(c), U)
        x[back:] = c[: len(c) - back]
        if back:
            x[back:][r[back:] != r[: len(r) - back]] = GAP
        g = (g << U(16)) | x
    later = np.zeros(len(c), bool)
    later[1:] = r[1:] == r[:-1]
    return g[later], r[later]


def count_grams(sample: DataFrame, table: np.ndarray) -> DataFrame:
    """lang, gram, n over the rows (lang, text) of a sample; counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            _, at = text_buffers(batch.column(1))
            for i, j in slices(at):
                c, r = classes(*lowered(batch.column(1), i, j), table, j - i)
                g, r = grams(c, r, ORDER)
                for lang in set(langs[i:j]):
                    got, n = np.unique(g[(langs[i:j] == lang)[r]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(got.astype("i8")), pa.array(n.astype("i8"))], ["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Sorted:
    """Rows of numbers under 64-bit keys: a sorted array of hashed keys and a parallel array of values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys * ODD  # odd, so no two keys collide
        order = np.argsort(hashed)
        self.keys, self.values = hashed[order], np.ascontiguousarray(values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each key."""
        h = keys * ODD
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))  # no keys: nothing is found
        return at, self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)


class Model:
    """Kneser-Ney models of several languages over one alphabet, and the limits of what they accept."""

    def __init__(self, counts: pd.DataFrame, table: np.ndarray):
        self.langs = sorted(counts["lang"].unique()) if len(counts) else []
        self.table = table
        self.size = int(table.max()) + 1
        self.limit = np.full((len(self.langs), WINDOWS), np.inf)  # bits a class that a text of 2**k classes or more may have
        self.logs = Sorted(np.zeros(0, U), np.zeros((0, len(self.langs))))
        if not self.langs:
            return
        per = [counts[counts["lang"] == x] for x in self.langs]
        grams_, numbers = [x["gram"].to_numpy().astype(U) for x in per], [x["n"].to_numpy().astype(float) for x in per]
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = [list(zip(grams_, numbers, strict=True))]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: how many classes precede
            mask = U((1 << (16 * order)) - 1)
            levels.append([np.unique(g & mask, return_counts=True) for g, _ in levels[-1]])
        levels.reverse()  # orders 1 to ORDER
        L = len(self.langs)
        self.base = np.full((self.size, L), 1.0 / self.size)
        self.probs: list[Sorted] = []
        self.backs: list[Sorted] = []
        for order, level in enumerate(levels, 1):
            every = np.unique(np.concatenate([g for g, _ in level]))
            contexts = np.unique(every >> U(16))
            prob, back = np.zeros((len(every), L)), np.ones((len(contexts), L))
            for k, (g, n) in enumerate(level):
                n = n.astype(float)
                ones, twos = (n == 1).sum(), (n == 2).sum()
                d = ones / (ones + 2 * twos) if ones else 0.5
                own, at = np.unique(g >> U(16), return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                back[np.searchsorted(contexts, own), k] = d * kinds / total
                prob[np.searchsorted(every, g), k] = np.maximum(n - d, 0) / total[at]
            lower = self._below(order, every)
            at = np.searchsorted(contexts, every >> U(16))
            self.probs.append(Sorted(every, prob + back[at] * lower))
            self.backs.append(Sorted(contexts, back))
        top = self.probs[-1]
        self.logs.keys, self.logs.values = top.keys, np.log2(top.values).astype("f4")

    def _below(self, order: int, g: np.ndarray) -> np.ndarray:
        """Probabilities of the last class of g under the models of the orders below."""
        if order == 1:
            return np.full((len(g), len(self.langs)), 1.0 / self.size)
        return self._prob(order - 1, g & U((1 << (16 * (order - 1))) - 1))

    def _prob(self, order: int, g: np.ndarray) -> np.ndarray:
        at, found = self.probs[order - 1].find(g)
        out = self.probs[order - 1].values[at]
        if not found.all():
            rest = g[~found]
            lower = self._below(order, rest)
            c, seen = self.backs[order - 1].find(rest >> U(16))
            out[~found] = np.where(seen[:, None], self.backs[order - 1].values[c], 1.0) * lower
        return out

    def event_bits(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of rows: (bits of each class under each language, row of each, letters of each row)."""
        raw, at = text_buffers(column)
        L = len(self.langs)
        for i, j in slices(at, 250_000):
            n = j - i
            c, r = classes(*lowered(column, i, j), self.table, n)
            letters = np.bincount(r[c != GAP], minlength=n)
            g, r = grams(c, r, ORDER)
            place, found = self.logs.find(g)
            bits = -self.logs.values[place] if L else np.zeros((len(g), 0), "f4")
            if L and not found.all():
                few, back = np.unique(g[~found], return_inverse=True)
                bits[~found] = -np.log2(self._prob(ORDER, few))[back]
            yield bits, r, letters

    def entropies(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of rows: (bits a class under each language, classes that counted); no letters: 0 classes."""
        L = len(self.langs)
        for bits, r, letters in self.event_bits(column):
            n = len(letters)
            many = np.bincount(r, minlength=n)
            sums = np.stack([np.bincount(r, bits[:, k], n) for k in range(L)], 1) if L else np.zeros((n, 0))
            yield sums / np.maximum(many, 1)[:, None], np.where(letters > 0, many, 0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, list[bool], np.ndarray, np.ndarray]:
        """lang, score, rejected, bits, classes of each row. Without letters (or models): und, score 0, rejected."""
        names, scores, rejected, all_bits, all_n = [], [], [], [], []
        for bits, n in self.entropies(column):
            if not self.langs:
                names += ["und"] * len(n)
                scores += [0.0] * len(n)
                rejected += [True] * len(n)
                continue
            best = bits.argmin(1)
            low = bits[np.arange(len(n)), best]
            gap = np.minimum((bits - low[:, None]) * np.maximum(n, 1)[:, None], 60.0)
            p = 1.0 / np.exp2(-gap).sum(1)
            size = np.minimum(np.frexp(np.maximum(n, 1))[1] - 1, WINDOWS - 1)  # the power of two below n
            names += [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
            scores += list(np.where(n > 0, p, 0.0))
            rejected += list((n == 0) | (low > self.limit[best, size]))
            all_bits.append(low)
            all_n.append(n)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0)
        return names, np.array(scores), rejected, cat(all_bits), cat(all_n)


def train(docs: DataFrame, most_docs: int = 600, quantile: float = 0.99, spread: float = 6.0, most_windows: int = 64) -> Model:
    """Models from a bounded sample: about `most_docs` rows of each language with text, lang and not held out.

    A fifth of the sample is kept from the counts and calibrates rejection. Its texts are cut into windows of 1, 2, 4, ...
    classes (at most `most_windows` of each length in a text, evenly spread), and each language and window length gets
    the median and the `quantile` of the bits a class. A text is rejected if its bits a class exceed the median for the
    longest window that is no longer than itself by more than `spread` times the distance from there to the quantile.
    Lengths of which the sample has fewer than 100 windows take the limit of the next shorter ones.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = bounded_sample(rows, "lang", most_docs)
    part = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(5))
    fit, check = sample.where(part != 0), sample.where(part == 0)
    letters = letter_table()

    def seen(batches):
        for batch in batches:
            points, n = np.unique(np.frombuffer("".join((x or "").lower() for x in batch.column(0).to_pylist()).encode("utf-32-le"), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(points.astype("i4")), pa.array(n.astype("i8"))], ["p", "n"])

    counted = fit.select("text").mapInArrow(seen, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()  # at most all code points
    usual = sorted((r for r in counted if letters[r.p]), key=lambda r: (-r.n, r.p))[: 2**16 - 2]  # classes have 16 bits; rarer letters are OTHER
    table = np.where(letters, OTHER, GAP).astype(np.uint16)
    for k, p in enumerate(sorted(r.p for r in usual), OTHER + 1):
        table[p] = k
    model = Model(count_grams(fit, table).toPandas(), table)
    if not model.langs:
        return model

    def windows(batches):
        for batch in batches:
            langs, out = np.array(batch.column(0).to_pylist(), object), []
            begin = 0
            for bits, r, letters_ in model.event_bits(batch.column(1)):
                cuts = np.searchsorted(r, np.arange(len(letters_) + 1))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    sums = bits[a:b].sum(0)
                    if not letters_[i] or model.langs[sums.argmin()] != langs[begin + i]:
                        continue
                    total = np.r_[0.0, np.cumsum(bits[a:b, sums.argmin()], dtype=float)]
                    for k in range(min(WINDOWS, int(b - a).bit_length())):
                        at = np.unique(np.linspace(0, b - a - 2**k, min(most_windows, (b - a) >> k)).astype(int))
                        out += [(langs[begin + i], k, x) for x in (total[at + 2**k] - total[at]) / 2**k]
                begin += len(letters_)
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()), strict=True)], ["lang", "k", "bits"])

    cut = check.select("lang", "text").mapInArrow(windows, "lang string, k int, bits double").groupBy("lang", "k")
    got = {(r.lang, r.k): r for r in cut.agg(F.percentile("bits", F.array(F.lit(0.5), F.lit(quantile))).alias("q"), F.count(F.lit(1)).alias("n")).collect()}
    for i, lang in enumerate(model.langs):
        for k in range(WINDOWS):
            r = got.get((lang, k))
            if r is not None and r.n >= 100:
                model.limit[i, k] = r.q[0] + spread * (r.q[1] - r.q[0])
            elif k:
                model.limit[i, k] = model.limit[i, k - 1]
    return model


NEW = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, new: tuple[str, str, str] = NEW) -> DataFrame:
    """docs with the columns `new`: language, score (posterior of it), rejected. Whole texts; null, empty or without
    letters: und, 0, rejected. Ties go to the first language by name."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded sample

    def run(batches):
        for batch in batches:
            lang, score, rejected, _, _ = shared.value.predict(batch.column(len(names)))
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(x) for x in rejected], pa.bool_())], [f"c{i}" for i in range(len(names) + 3)])

    typed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").alias("_text"))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)) + f", c{len(names)} string, c{len(names) + 1} double, c{len(names) + 2} boolean"
    return typed.mapInArrow(run, schema).toDF(*names, *new)


def identify_documents(docs: DataFrame, most_docs: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    model = train(docs, most_docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def language_stage(docs: DataFrame, most_docs: int = 600) -> DataFrame:
    """The rows of docs that the models accept, with lang as predicted."""
    model = train(docs, most_docs)
    out = identify(docs, model, ("_lw_lang", "_lw_score", "_lw_rejected")).where("NOT _lw_rejected")
    return out.select(*(F.col("_lw_lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))
