"""Near-duplicates where ids clash, repeat or are null: rows link by their texts, and no text is lost."""

import random
from collections import Counter

import pytest

from loamwork.llm.minhash import dedup_stage, near_duplicates

from tests.llm.test_brute import shingle_set


def prose(rng, n=60):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n))


def brute(rows, k, percent=80):
    """(id, text, size): component_id, by the texts of all rows."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(s), low[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_one_id_on_two_texts(spark):
    rng = random.Random(1)
    a, b = prose(rng, 17), prose(rng, 17)
    rows = [(1, a), (1, b), (2, a + " q"), (4, a), (5, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, words=2).collect())
    assert got == brute(rows, 2)
    assert {r.component_id for r in near_duplicates(docs, words=2).collect() if r.doc_id in (2, 4)} == {1}


@pytest.mark.parametrize("seed", [2, 3])
def test_clashing_null_and_repeated_ids(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = prose(rng)
        for _ in range(rng.randrange(1, 5)):
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "x"
            rows += [(rng.choice([None, *range(9)]), " ".join(w))] * rng.choice([1, 1, 3])
    rows += [(3, None), (3, ""), (None, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, words=2).collect())
    assert got == brute(rows, 2)


def test_stage_drops_rows_not_ids(spark):
    rng = random.Random(4)
    a, z = prose(rng), prose(rng)
    for rows, want in [
        ([(1, a), (3, a), (3, z)], [(1, a), (3, z)]),
        ([(1, a), (3, a + " q"), (3, z)], [(1, a), (3, z)]),
        ([(1, a), (1, a), (1, z), (None, a)], [(1, a), (1, z), (None, a)]),
        ([(2, z), (2, z), (2, None), (2, None)], [(2, z), (2, None), (2, None)]),
    ]:
        docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, th int")
        out = dedup_stage(docs)
        assert out.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)
