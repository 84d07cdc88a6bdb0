"""Language models against a plain Kneser-Ney version; texts judged alone; rejection of what no model explains."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loamwork.llm.langid import ORDER, OTHER, Model, count_grams, identify, language_stage, letter_table, train

MEDIUM = "/root/testdata/sf0.01"
FOREIGN = (
    "Historia naszego miasta zaczyna się dawno temu, kiedy pierwsi mieszkańcy przybyli z gór i zbudowali swoje domy nad rzeką. "
    "Dzisiaj wiele osób odwiedza centrum, aby zobaczyć stare pałace i kościoły, ale także zjeść w małych restauracjach. "
    "Dzieci bawią się na placu, a starsi rozmawiają pod drzewami o pogodzie i o tym, co się wydarzyło w ostatnich latach."
)


def events(text, code):
    """Classes of a text with one gap at both ends and runs of gaps as one; all but the first are predicted."""
    out = [0]
    for c in text.lower():
        k = code(c)
        if k or out[-1]:
            out.append(k)
    return out if not out[-1] else [*out, 0]


class PlainKN:
    def __init__(self, texts, code, size):
        self.size, self.counts = size, [None] * (ORDER + 1)
        top = Counter()
        for t in texts:
            x = [0] * (ORDER - 1) + events(t, code)
            top.update(tuple(x[i - ORDER + 1 : i + 1]) for i in range(ORDER, len(x)))
        self.counts[ORDER] = top
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.totals, self.kinds, self.discount = {}, {}, {}
        for k in range(1, ORDER + 1):
            ones, twos = (sum(n == m for n in self.counts[k].values()) for m in (1, 2))
            self.discount[k] = ones / (ones + 2 * twos) if ones else 0.5
            for g, n in self.counts[k].items():
                self.totals[g[:-1]] = self.totals.get(g[:-1], 0) + n
                self.kinds[g[:-1]] = self.kinds.get(g[:-1], 0) + 1

    def p(self, g):
        if not g:
            return 1 / self.size
        total = self.totals.get(g[:-1])
        if not total:
            return self.p(g[1:])
        d = self.discount[len(g)]
        return max(self.counts[len(g)][g] - d, 0) / total + d * self.kinds[g[:-1]] / total * self.p(g[1:])

    def bits(self, text, code):
        x = [0] * (ORDER - 1) + events(text, code)
        return [-math.log2(self.p(tuple(x[i - ORDER + 1 : i + 1]))) for i in range(ORDER, len(x))]


def test_bits_are_those_of_plain_kneser_ney(spark):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("lang", "text").where("doc_id < 300 AND length(text) < 3000").collect()
    rows = [(r.lang, r.text) for r in rows]
    fit, rest = rows[:60], [t for _, t in rows[60:]][:200] + ["", "!", "a", FOREIGN, "ÿ ﬁ Ж"]
    letters = letter_table()
    known = sorted({c for _, t in fit for c in t.lower() if letters[ord(c)]})
    table = np.where(letters, OTHER, 0).astype(np.uint16)
    for k, c in enumerate(known, OTHER + 1):
        table[ord(c)] = k
    code = lambda c: int(table[ord(c)])
    model = Model(count_grams(spark.createDataFrame(fit, "lang string, text string").repartition(3), table).toPandas(), table)
    plain = [PlainKN([t for x, t in fit if x == lang], code, int(table.max()) + 1) for lang in model.langs]
    got = np.concatenate([b for b, _ in model.entropies(pa.array(rest))])
    count = np.concatenate([n for _, n in model.entropies(pa.array(rest))])
    for t, b, n in zip(rest, got, count, strict=True):
        want = [m.bits(t, code) for m in plain]
        if not n:
            assert not any(code(c) for c in t.lower())
            continue
        assert n == len(want[0])
        assert np.allclose(b, [sum(w) / n for w in want], rtol=1e-4), t[:60]


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet(f"{MEDIUM}/documents.parquet"))


def test_a_text_is_judged_alone(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text").limit(80).collect()]
    texts += ["un", "la", "", "die.", "!un", "un!", "is", None]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    alone = [model.predict(pa.array([t], pa.string())) for t in texts]
    together = model.predict(pa.array([texts[i] for i in order], pa.string()))
    for k, i in enumerate(order):
        a = alone[i]
        assert (a[0][0], a[1][0], bool(a[2][0]), a[3][0]) == (together[0][k], together[1][k], bool(together[2][k]), together[3][k]), texts[i]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = (sorted((r.doc_id, r.lang_pred, r.score, r.rejected) for r in identify(rows.repartition(n), model).collect()) for n in (1, 5))
    assert one == two


def test_what_no_model_explains_is_rejected(spark, model):
    rng = random.Random(2)
    strange = [FOREIGN[:n] for n in (60, 100, 200, len(FOREIGN))]
    strange += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (50, 100, 200, 500) for _ in range(5)]
    strange += ["История нашего города начинается давно", "12345 !!!", ""]
    assert all(model.predict(pa.array(strange))[2])
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), model)
    assert out.where("rejected").count() <= 1
    extra = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], docs.schema)
    kept = language_stage(docs.unionByName(extra))
    assert kept.where(f"doc_id >= {10**9}").count() == 0 and kept.count() >= docs.count() - 1
